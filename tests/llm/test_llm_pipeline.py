"""The pipeline: each stage on what the one before kept, by the stages' own rules."""

import random

import corpus_pipeline
from tidemark.llm import jaccard_join, toxicity


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(80)]
    bench = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(3)]
    texts += [t.replace(" ", "  ") for t in texts[:5]] + [t + " tail" for t in texts[5:10]] + [texts[11] + "\n" + bench[0], bench[1]]
    texts += [t + " dullard" for t in texts[12:52]]
    toxic = {i for i, t in enumerate(texts) if "dullard" in t}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, left = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    everything = set(range(len(texts)))
    rejected = {r.doc_id for r in toxicity.toxicity(df, spark.read.parquet(str(tmp_path / "labels.parquet"))).filter("predicted = 1").collect()}
    assert left["toxicity"] == everything - rejected and len(rejected & toxic) > 30 and len(rejected - toxic) <= 3
    # of equal texts the one with the most code points stays, here the spaced copy
    assert left["toxicity"] - left["exact_dedup"] == {i for i in range(5) if i in left["toxicity"] and 80 + i in left["toxicity"]}
    kept = df.filter(df.doc_id.isin(*left["exact_dedup"]))
    assert left["jaccard_join"] == {r.component_id for r in jaccard_join.jaccard_components(kept).collect()}
    assert left["jaccard_join"] - left["decontamination"] == {90, 91} & left["jaccard_join"]
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == left["decontamination"]


SCHEMA = "doc_id long, text string, lang string, __locator string, key int"


def test_stages_take_nulls_empty_texts_repeats_clashes_and_empty_tables(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(30)]
    rows = [(i, t, "en", "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "en", "x", 1), (None, texts[5], None, None, None), (40, None, "en", "x", 1), (41, "", "en", "x", 1), (None, " ", "en", "x", 1), (42, texts[7] + " " + " ".join(words) * 300, "en", "x", 1)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(0, texts[9]), (1, None)], "item_id long, text string")
    for name, df in (("labels", labels), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    left = sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").strip() == "") for r in docs.collect())
    # row 3 is there once, the row without an id is a copy of 5, of the empty texts the longest stays, 9 is a leak
    assert left == sorted([(False, i, False) for i in range(30) if i != 9] + [(True, 0, True), (False, 42, False)])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
