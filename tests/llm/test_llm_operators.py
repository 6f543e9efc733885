"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import common, decontam, exact_dedup, jaccard_join, line_dedup, packing, quality, suffix_dedup, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, node long, id long, unit int"
WORDS = ["the", "of", "Alpha", "beta,", "gamma", "delta.", "ünï", "zeta", "eta", "theta"]


def make(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(60)) if rng.random() < 0.7 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [make(rng, rng.randrange(3, 120)) for _ in range(30)]
    texts = list(base)
    for t in base[:12]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts += [t, t.replace(" ", "  \n"), " ".join(w)]
    passage = make(rng, 60)
    texts += [make(rng, 20) + "\n" + passage + "\n" + make(rng, 10) for _ in range(8)]
    texts += ["", " \n\t ", None, "one", "one two", "ONE two", "x" * 5000, make(rng, 4000), "İstanbul ΑΣ", "a b c d e"]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1, 2, 3) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# exact dedup ---------------------------------------------------------------------------------------------------------------


def wanted_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), i == min(g)[1], hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for _, i in g}


@pytest.mark.parametrize("digest_chars", [64, 1])
def test_exact_dedup(rows, docs, digest_chars):
    got = {i: (r.keep_id, r.group_size, r.kept, r.text_sha256) for i, r in by_id(exact_dedup.exact_dedup(docs, digest_chars)).items()}
    assert got == wanted_exact(rows)


def test_exact_dedup_stage_keeps_columns(rows, docs, none):
    kept = exact_dedup.keep_documents(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, w in wanted_exact(rows).items() if w[2]}
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_repeated_rows_and_null_id(spark):
    df = frame(spark, [(1, "a"), (1, "a"), (None, "a"), (0, "a")])
    got = sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == [("0", 0, 4, True), ("1", 0, 4, False), ("1", 0, 4, False), ("None", 0, 4, False)]


def test_exact_dedup_rows_that_share_an_id(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "a "), (None, "b"), (None, "c")]
    for digest_chars in (64, 0):
        got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256[:4]) for r in exact_dedup.exact_dedup(frame(spark, rows), digest_chars).collect()}
        sha = {t: hashlib.sha256(t.encode()).hexdigest()[:4] for t in "abc"}
        assert got == {(1, 2, 3, False, sha["a"]), (2, 2, 3, False, sha["a"]), (2, 2, 3, True, sha["a"]), (1, 1, 2, True, sha["b"]), (None, 1, 2, False, sha["b"]), (None, None, 1, True, sha["c"])}


def test_exact_dedup_state_outlives_a_call(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    first = exact_dedup.exact_dedup(frame(spark, [(5, "x y"), (6, "z"), (7, None)]), state=state).collect()
    assert all(r.kept for r in first)
    again = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, [(1, "xy"), (8, "new"), (9, "z"), (9, "new")]), state=state).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").filter("doc_id <> 9").collect()}
    assert (again[1].keep_id, again[1].group_size, again[1].kept) == (5, 2, False) and (again[8].keep_id, again[8].group_size, again[8].kept) == (8, 2, True)
    last = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, [(2, "x  y  "), (3, " ")]), state=state).collect()}
    assert (last[2].keep_id, last[2].group_size, last[2].kept) == (2, 3, True) and (last[3].keep_id, last[3].group_size) == (3, 2)


def test_exact_dedup_state_with_digests_that_different_bytes_share(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    exact_dedup.exact_dedup(frame(spark, [(5, "x y"), (6, "z")]), 0, state=state).collect()
    again = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, [(1, "xy"), (8, "new")]), 0, state=state).collect()}
    assert again == {1: (5, 2, False), 8: (8, 1, True)}


def test_exact_dedup_of_a_plan_without_files_and_clashing_names(spark, tmp_path):
    rows = [(i % 7, f"t{i % 5}", i) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, locator long").withColumnsRenamed({"locator": "__locator"})
    df.write.parquet(f"{tmp_path}/d")
    read = spark.read.parquet(f"{tmp_path}/d")
    want = sorted((min(i for i, x, _ in rows if x == t), t) for t in {x for _, x, _ in rows})
    for docs in (df, read, read.filter("doc_id >= 0"), read.union(read.limit(0))):
        kept = exact_dedup.keep_documents(docs)
        assert kept.columns == ["doc_id", "text", "__locator"] and sorted((r.doc_id, r.text) for r in kept.collect()) == want


def test_dedup_stages_keep_rows_not_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "x y"), (None, "xy"), (None, "q"), (0, "b"), (None, "b")]
    kept = sorted((str(r.doc_id), r.text) for r in exact_dedup.keep_documents(frame(spark, rows)).collect())
    assert kept == [("0", "b"), ("1", "a"), ("None", "q"), ("None", "x y")]
    rng = random.Random(1)
    one, two, three = (make(rng, 30) for _ in range(3))
    rows = [(1, one), (1, one), (None, two), (None, two), (0, three), (1, three), (None, three), (2, ""), (2, "")]
    kept = sorted((str(r.doc_id), r.text) for r in jaccard_join.one_of_each(frame(spark, rows)).collect())
    assert kept == sorted([("1", one), ("None", two), ("0", three), ("2", "")])


# line dedup ----------------------------------------------------------------------------------------------------------------


CUTS = {"line": r"(?<=\n)", "paragraph": r"(?<=\n\n)", "sentence": r"(?<=\n)|(?<=[.!?])(?=[\x20\x09\x0B-\x0D])"}


def wanted_lines(rows, by, min_words):
    """(row, unit, start, length, row that keeps, its unit, kept) in the order of rows."""
    every, where = {}, defaultdict(list)
    for i, (_, t) in enumerate(rows):
        at, every[i] = 0, []
        for part in re.split(CUTS[by], t or ""):
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in part)).strip(" ")
            if norm:
                where[norm].append((i, len(every[i])))
                every[i].append((norm, at, len(part) - part.endswith("\n")))
            at += len(part)
    places = defaultdict(list)
    for i, units in every.items():
        for _, run in itertools.groupby(enumerate(units), key=lambda u: (len(where[u[1][0]]) > 1) or -u[0] - 1):
            run = list(run)
            if len(where[run[0][1][0]]) > 1 and sum(n.count(" ") + 1 for _, (n, _, _) in run) >= min_words:
                for u, (norm, start, length) in run:
                    places[norm].append((i, u, start, length))
    return {(*p, *ps[0][:2], p == ps[0]) for ps in places.values() if len(ps) > 1 for p in ps}


@pytest.mark.parametrize(("by", "min_words"), [("sentence", 25), ("line", 5), ("line", 1), ("paragraph", 12)])
def test_line_dedup(spark, rows, docs, none, by, min_words):
    rng = random.Random(7)
    passage = [f"{make(rng, 6)}. {make(rng, 9)}!\n" for _ in range(6)]
    extra = [make(rng, 5) + ". " + "".join(passage[k : k + 4]) + "\n" + make(rng, 4) + ".\nAll rights reserved.\n" for k in range(3) for _ in range(2)] + ["a. b? " * 9, "ß.\r\n\u2003é. " * 3]
    rows = rows + [(len(rows) + k, t) for k, t in enumerate(extra)]
    docs = frame(spark, rows).repartition(3)
    want = wanted_lines(rows, by, min_words)
    assert {tuple(r) for r in line_dedup.repeats(docs, by, min_words).collect()} == want and any(not w[-1] for w in want)
    assert line_dedup.repeats(none, by, min_words).count() == 0
    cut = by_id(line_dedup.without_repeats(docs, by, min_words))
    gone = defaultdict(list)
    for i, _, start, length, *_, kept in sorted(want):
        if not kept:
            gone[i].append((start, length))
    for i, t in rows:
        assert [tuple(x) for x in cut[i].removed or ()] == gone[i]
        lost = {p for start, length in gone[i] for p in range(start, start + length + (t[start + length : start + length + 1] == "\n"))}
        assert cut[i].text == (t if t is None else "".join(c for p, c in enumerate(t) if p not in lost))


def test_line_dedup_rows_that_share_an_id_and_clashing_names(spark):
    line = "one line of rather more than a few words that several documents have"
    texts = [(4, line), (4, "x\n" + line), (4, line), (None, line), (None, "y"), (2, line + "!")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, __id int, removed int")
    got = {tuple(r) for r in line_dedup.repeats(df, "line", 5).collect()}
    assert {(i, u, start, kept) for i, u, start, _, _, _, kept in got} in ({(4, 0, 0, True), (4, 1, 2, False), (None, 0, 0, False)}, {(4, 0, 0, False), (4, 1, 2, True), (None, 0, 0, False)})
    out = line_dedup.without_repeats(df, "line", 5).collect()
    assert set(out[0].asDict()) == {"doc_id", "text", "__id", "removed"} and sum(line in r.text for r in out) in (2, 3)


# suffix dedup --------------------------------------------------------------------------------------------------------------


def wanted_suffix(rows):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        x = (t or "").encode()
        cover = np.zeros(len(x), bool)
        for p in range(len(x) - 49):
            s = x[p : p + 50]
            if first.setdefault(s, i) < i:
                cover[p : p + 50] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~cover])
        out[i] = (len(x), int(cover.sum()), int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(rows, docs, none):
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_dedup.remove_repeats(docs)).items()}
    assert got == wanted_suffix(rows)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_suffix_dedup_periodic_and_edges(spark):
    block = "abcdefghij" * 30
    rng = random.Random(2)
    body = "".join(rng.choice("abcd") for _ in range(400))
    rows = [(0, body), (1, body[:50]), (2, body[:49]), (3, "q" + body[100:151] + "q"), (4, block), (5, block + "z"), (6, "z" + block[3:]), (7, body[20:120] + body[200:260]), (8, "é" * 60), (9, "aé" + "é" * 60)]
    for shuffled in (rows, rows[::-1]):
        got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_dedup.remove_repeats(frame(spark, shuffled).repartition(3))).items()}
        assert got == wanted_suffix(rows)


def test_suffix_contexts_that_agree_on_36_bits_of_their_hash_stay_apart(spark):
    line = "a line that a great many documents of the corpus have in common, to its very end.\n"
    rows = [(i, line + f"{i:06d} {pow(3, i + 1000, 1 << 256):064x}") for i in (293935, 329408, 156649, 223033, 2064, 146414, 9283, 9573)]
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_dedup.remove_repeats(frame(spark, rows).repartition(3))).items()}
    assert got == wanted_suffix(rows)


def test_suffix_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(8)
    shared = make(rng, 20)
    texts = [(3, shared + make(rng, 9)), (3, make(rng, 6) + shared), (3, make(rng, 6) + shared), (None, shared), (None, make(rng, 5) + shared + "!"), (None, shared), (1, "short"), (7, make(rng, 15))]
    texts += texts[:1]
    order = sorted({(i is None, i or 0, np.uint64(xxhash.xxh64_intdigest(t.encode(), 42)).astype(np.int64), t) for i, t in texts})
    rank = {(None if none else i, t): k for k, (none, i, _, t) in enumerate(order)}
    want = wanted_suffix([(k, t) for (_, t), k in rank.items()])
    got = suffix_dedup.remove_repeats(frame(spark, texts).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((str(i), *want[rank[i, t]]) for i, t in texts)


def test_suffix_spans_and_kept_bytes(spark):
    rng = random.Random(4)
    a, b = make(rng, 30), make(rng, 30)
    rows = [(0, a), (1, "ü" + a + "-" + b), (2, b[:40] + a[:70] + b)]
    got = by_id(suffix_dedup.remove_repeats(frame(spark, rows), with_text=True))
    want = wanted_suffix(rows)
    for i, t in rows:
        x, r = t.encode(), got[i]
        cover = np.zeros(len(x), bool)
        for s, e in zip(r.starts, r.ends, strict=True):
            cover[s:e] = True
        assert bytes(np.frombuffer(x, np.uint8)[~cover]) == bytes(r.kept) and want[i] == (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)


def test_suffix_anchors_name_equal_strings_alike(monkeypatch):
    rng = np.random.default_rng(1)
    data = np.concatenate([np.tile(rng.integers(97, 99, 900), 3), rng.integers(97, 99, 900)]).astype(np.uint8)

    def named():
        out = {}
        for first, back, width, *_ in suffix_dedup.anchors(data):
            for f, k, w in zip(first.tolist(), back.tolist(), width.tolist(), strict=True):
                assert 0 <= k - w and k <= 34
                for x in range(w + 1):
                    assert out.setdefault(f + x, k - x) == k - x
        return out

    whole = named()
    assert sorted(whole) == list(range(len(data) - 49))
    steps = defaultdict(set)
    for x, k in whole.items():
        steps[data[x : x + 50].tobytes()].add(k)
    assert all(len(v) == 1 for v in steps.values())
    monkeypatch.setattr(suffix_dedup, "_CHUNK", 257)
    assert named() == whole
    data = np.concatenate([data, np.full(300, 97), np.tile(rng.integers(97, 99, 7), 60), data[:80]]).astype(np.uint8)
    found = [np.stack(x[:4], 1) for x in suffix_dedup.anchors(data)]
    covered = {x for f, _, w, extent in np.concatenate(found).tolist() for x in range(f, f + w + extent + 1)}
    assert covered == set(range(len(data) - 49)) and max(x[:, 3].max() for x in found) > 150


def test_suffix_grams_shared_by_chance_are_not_ranked(spark):
    rng = random.Random(12)
    make_ = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common, passage = [make_(30) for _ in range(4)], make_(49)
    rows = [(i, "".join(make_(60) + c for c in common) + make_(60)) for i in range(12)]

    def ranked(rows):
        docs = frame(spark, rows).repartition(3).selectExpr("doc_id AS id", "text")
        out = suffix_dedup.scan(docs, 2).groupBy("bucket").applyInArrow(suffix_dedup.group(2), suffix_dedup.PACKED)
        return sum(len(r.docs) // 8 for r in out.filter("kind = 2").collect())

    assert ranked(rows) == 0
    more = [*rows, *((i, make_(70) + passage + make_(i) + passage + "abcdefgh"[i % 8] + make_(30)) for i in range(12, 40)), (40, "x" + rows[3][1][40:140])]
    assert ranked(more) > 0
    got = {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in by_id(suffix_dedup.remove_repeats(frame(spark, more).repartition(3))).items()}
    assert got == wanted_suffix(more)


def test_suffix_anchors_of_texts_that_follow_each_other():
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 101, n).astype(np.uint8) for n in (0, 49, 50, 51, 400, 0, 7)] + [np.full(90, 97, np.uint8)] * 2
    ends = np.cumsum([len(x) for x in texts])

    def rows(before, start, *rest):
        back, width, *_, blocks = rest
        used = (back[:, None] >= suffix_dedup._FROM) & ((back - width)[:, None] <= suffix_dedup._TO)
        return list(zip((start + before).tolist(), *(c.tolist() for c in rest[:-1]), np.where(used, blocks, 0).tolist(), strict=True))

    (together,) = suffix_dedup.anchors(np.concatenate(texts), ends)
    alone = [r for x, e in zip(texts, ends.tolist(), strict=True) for found in suffix_dedup.anchors(x) for r in rows(e - len(x), *found)]
    assert len(alone) > 20 and rows(0, *together) == alone


# Jaccard join --------------------------------------------------------------------------------------------------------------


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def wanted_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def test_jaccard_components(rows, docs, none):
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(jaccard_join.jaccard_components(docs)).items()}
    assert got == wanted_components(rows)
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {v[1] for v in wanted_components(rows).values()}


def test_jaccard_second_round_finds_links_that_the_chain_misses(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for g in range(6):  # families at similarities around the threshold, all sharing a common start
        start = [f"w{g}x{k}" for k in range(30)]
        for m in range(14):
            cut = rng.randrange(0, 9)
            rows.append((len(rows), " ".join(start[: 30 - cut] + [f"t{len(rows)}y{k}" for k in range(rng.randrange(0, 6))])))
    monkeypatch.setattr(jaccard_join, "BLOCK", 90)
    monkeypatch.setattr(jaccard_join, "BUCKET", 500)
    got = {i: (r.n_shingles, r.component_id) for i, r in by_id(jaccard_join.jaccard_components(frame(spark, rows))).items()}
    assert got == wanted_components(rows)


def test_rtree_loses_nothing():
    rng = np.random.default_rng(3)
    base = rng.poisson(2, (20, jaccard_join.GROUPS))
    points = np.concatenate([np.maximum(0, base + rng.integers(-1, 2, base.shape) * (rng.random(base.shape) < 0.05)) for _ in range(12)])
    n, comp, twice = points.sum(1), rng.integers(0, 40, len(points)), rng.random(len(points)) < 0.3
    tree, got = jaccard_join.RTree(points, n, comp, twice), set()
    for a, b in tree.leaves():
        for i, j in zip(*np.nonzero(tree.allowed(a, b, tree.comp)), strict=True):
            x, y = int(tree.order[a[i]]), int(tree.order[b[j]])
            assert (min(x, y), max(x, y)) not in got
            got.add((min(x, y), max(x, y)))
    want = {(i, j) for i in range(len(n)) for j in range(i + 1, len(n)) if comp[i] != comp[j] and not (twice[i] and twice[j]) and np.minimum(points[i], points[j]).sum() >= jaccard_join.need(n[i], n[j])}
    assert got == want and len(want) > 50


def families(rng, count, size):
    sets = []
    for _ in range(count):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for _ in range(9):
            keep = base[rng.random(size) < rng.uniform(0.75, 1)]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 63, rng.integers(0, size // 6), dtype=np.uint64)])))
    return sets


@pytest.mark.parametrize("size", [40, 270, 1100])
def test_second_round_groups_find_every_link_and_send_few_rows(size):
    rng = np.random.default_rng(size)
    sets = families(rng, 12, size)
    n, comp = np.array([len(x) for x in sets]), np.arange(len(sets)) // 2
    overlap = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    links = {(i, j) for i in range(len(sets)) for j in range(i) if comp[i] != comp[j] and 100 * overlap[i][j] >= 80 * (n[i] + n[j] - overlap[i][j])}
    table = {"a": pa.array(np.arange(len(sets))), "n": pa.array(n), "comp": pa.array(comp)}
    maybe = jaccard_join._maybe(pa.table(table | {"point": pa.array([jaccard_join.point(x) for x in sets])})).to_pylist()
    active, union = {r["a"] for r in maybe if r["kind"]}, common.Union()
    assert links and {i for pair in links for i in pair} <= active and all(comp[r["a"]] == r["b"] for r in maybe if r["kind"])
    assert len(maybe) < 2 * len(sets) and all(union.join(r["a"], r["b"]) for r in maybe if not r["kind"])
    assert all(union.find(int(comp[i])) == union.find(int(comp[j])) for i, j in links)
    exact = jaccard_join._exact(pa.table(table | {"items": pa.array([jaccard_join._items(x) for x in sets])})).to_pylist()
    union = common.Union()
    assert {(r["b"], r["a"]) for r in exact} <= links and all(union.join(int(comp[r["a"]]), int(comp[r["b"]])) for r in exact)
    assert all(union.find(int(comp[i])) == union.find(int(comp[j])) for i, j in links)


@pytest.mark.parametrize("links", [1 << 17, 9])
def test_components(spark, monkeypatch, links):
    monkeypatch.setattr(common, "LINKS", links)
    chain = [(i, i + 1) for i in range(0, 24)] + [(100, 105), (105, 101), (200, 200)]
    random.Random(1).shuffle(chain)
    edges = spark.createDataFrame(chain, "a long, b long").repartition(7)
    got = {r.node: r.component for r in common.components(edges).collect()}
    assert got == {**{i: 0 for i in range(25)}, 100: 100, 101: 100, 105: 100}
    assert common.components(edges.limit(0)).count() == 0


# packing -------------------------------------------------------------------------------------------------------------------


def test_packing(rows, docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = {}
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[i, k] = (s, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    got = packing.pack(docs).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    assert_packed(got, 4096)
    assert len({r.sequence_id for r in got}) == -(-sum(v[1] for v in want.values()) // 4096)
    assert packing.pack(none).count() == 0


def assert_packed(rows, capacity):
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= capacity


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randrange(1, 101), 100, 50, 34, 33]) for _ in range(rng.randrange(1, 600)))
    plan = packing.plan(dict(counts), 100)
    used = Counter()
    for lengths, k in plan:
        assert sum(lengths) <= 100 and k > 0
        for x in lengths:
            used[x] += k
    assert used == counts
    assert sum(k for _, k in plan) <= 1.1 * -(-sum(x * c for x, c in counts.items()) // 100) + 2 + counts[100] + sum(c for x, c in counts.items() if x > 50)


def test_exact_complements_are_not_missed():
    left = np.zeros(21, np.int64)
    left[[13, 9, 8, 3, 2]] = 1
    assert packing._exact(left, 20) == (9, 8, 3)
    rng = random.Random(12)
    for _ in range(400):
        have = Counter(rng.randrange(1, 30) for _ in range(rng.randrange(1, 9)))
        gap = rng.randrange(3, 61)
        left = np.array([have[x] for x in range(gap + 1)], np.int64)
        lengths = sorted(have.elements())
        want = {sum(c) for k in (1, 2, 3) for c in itertools.combinations(lengths, k)}
        got = packing._exact(left, gap)
        assert (got is not None) == (gap in want) and (got is None or (sum(got) == gap and not Counter(got) - have))


def test_words_encode_like_texts():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["it's A.B ü.x <|endoftext|> foo", "", "x²! É́. don't've 12a.3 l'é", "<|ENDOFTEXT|>  a b \x1cq  \n ", "ΑΣ. ΣΑΣ, İi ǅ. a̸≠", None]
    offsets, ids = packing.WordTokens(packing.default_tokenizer()).encode(pa.array(texts))
    for k, x in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 1]


# decontamination -----------------------------------------------------------------------------------------------------------


def edit_region(text, item):
    """Least edit distance of item to any region of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination(spark, none):
    rng = random.Random(4)
    items = [make(rng, n) for n in (12, 25, 40, 40)]

    def edited(t, k):
        t = list(t)
        for _ in range(k):
            p = rng.randrange(3, len(t) - 3)
            match rng.randrange(3):
                case 0:
                    t[p] = "#"
                case 1:
                    del t[p]
                case _:
                    t.insert(p, "~")
        return "".join(t)

    rows = [(i, make(rng, 80)) for i in range(12)]
    for it in items:
        b = decontam.budget(len(decontam.normal(it)))
        for k in (0, 1, b, b + 1, 3 * b + 3):
            rows.append((len(rows), make(rng, 30) + " " + edited(it, k) + "\n" + make(rng, 30)))
    rows += [(900, items[1]), (901, items[1].upper()), (902, "x " + items[2] + " mid " + items[3]), (903, ""), (904, None), (905, items[0][: len(items[0]) // 2])]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, "short")], "item_id long, text string")
    df = frame(spark, rows)
    got = {(r.doc_id, r.item_id): r for r in decontam.leaks(df, bench).collect()}
    want = {}
    for i, t in rows:
        for k, it in enumerate(items):
            a, b = decontam.normal(t).decode("latin1"), decontam.normal(it).decode("latin1")
            d = edit_region(a, b)
            if d <= decontam.budget(len(b)):
                want[i, k] = d
    assert {k: r.edits for k, r in got.items()} == want and len(want) >= 16
    clean = decontam.clean_documents(df, bench)
    assert clean.columns == df.columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.leaks(none, bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def test_benchmark_in_chunks(spark):
    rng = random.Random(8)
    bench = spark.createDataFrame([(k, make(rng, 30)) for k in range(9)], "item_id long, text string")
    parts = list(decontam.chunks(bench, 500))
    assert len(parts) > 2 and sorted(i for p in parts for i, _ in p) == list(range(9))


def test_leaks_of_a_benchmark_of_several_chunks(spark, monkeypatch):
    rng = random.Random(9)
    items = [make(rng, 25) for _ in range(5)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = frame(spark, [(0, make(rng, 30)), (1, items[0] + " " + items[4]), (2, make(rng, 9) + items[2]), (3, None), (3, "")])
    monkeypatch.setattr(decontam.chunks, "__defaults__", (300,))
    assert len(list(decontam.chunks(bench))) > 2
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(df, bench).collect()} == {(1, 0), (1, 4), (2, 2)}
    assert sorted(r.doc_id for r in decontam.clean_documents(df, bench).collect()) == [0, 3, 3]


def test_every_region_and_items_of_any_length(spark):
    item = "what is the capital of the country between the two lakes and the sea"
    rows = [(0, f"{item} and then {item.replace('lakes', 'lokes')}"), (1, "Yes. yes, yes YES"), (2, "yesterday"), (3, "so it is forty-two, really"), (4, "x forty-tw0 x"), (5, ""), (6, None), (1, "yes")]
    bench = spark.createDataFrame([(1, item), (2, "yes"), (3, "forty-two"), (4, " \n"), (5, None)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in decontam.leaks(frame(spark, rows), bench).collect())
    n = len(item)
    assert got == [(0, 1, 0, n, 0), (0, 1, n + 10, 2 * n + 10, 1), (1, 2, 0, 3, 0), (1, 2, 10, 13, 0), (1, 2, 14, 17, 0), (3, 3, 9, 18, 0)]


# WARC ----------------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, refers_to long, archive string"


def pages(spark):
    rows = [(5, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (9, "http://c", None), (1, "http://d", ""), (7, "http://e", "é" * 3000), (8, "http://f", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (4, "http://e", "é" * 3000)]
    return rows, spark.createDataFrame([(*r, 1, "z") for r in rows], PAGES).repartition(2)


@pytest.mark.parametrize("least", [0, 100])
def test_warc_round_trip(spark, least):
    rows, df = pages(spark)
    want = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == raw]
        first = min(same)
        again = len(raw) >= least and i != first
        want[i] = (len(raw), warc.digest(raw), "revisit" if again else "response", first if again else None)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df, least).collect()}
    assert got == want
    assert warc.round_trip(df.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    rng = random.Random(3)
    payloads = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 3000))) for _ in range(12)]
    parts = [warc.record(i, f"http://x/{i}", p) for i, p in enumerate(payloads)]
    parts = [warc.member(p) for p in parts] if packed else parts
    starts = np.cumsum([0, *map(len, parts)]).tolist()
    whole = b"".join(parts)
    assert [f["warc-record-id"] for _, _, f, _, _ in warc.salvage(whole)] == [f"<urn:page:{i}>" for i in range(12)]
    bad = bytearray(whole)
    for k in (3, 7):  # bytes of these records are overwritten
        at = starts[k] + (len(parts[k]) * 2 // 3)
        bad[at : at + 4] = bytes(255 - x for x in bad[at : at + 4])
    bad = bytes(bad[: starts[9]]) + b"junk" * 10 + bytes(bad[starts[9] : starts[11] + 20])  # garbage between, the last is cut off
    got = list(warc.salvage(bad))
    ids = [int(re.findall(r"\d+", f["warc-record-id"])[0]) for _, _, f, _, _ in got if f]
    assert ids == [0, 1, 2, 4, 5, 6, 8, 9, 10]
    gaps = [(a, n) for a, n, f, _, _ in got if f is None]
    assert [a for a, _ in gaps] == [starts[3], starts[7], starts[9], starts[11] + 40]
    assert gaps[0][1] == len(parts[3]) and gaps[2][1] == 40
    assert all(f is None or c == payloads[int(re.findall(r"\d+", f["warc-record-id"])[0])] for _, _, f, c, _ in got)
    assert list(warc.salvage(b"")) == []


def foreign(i, content, *fields):
    return b"\r\n".join([b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <urn:page:%d>" % i, *fields, b"Content-Length: %d" % len(content)]) + b"\r\n\r\n" + content + b"\r\n\r\n"


def salvaged(data):
    return [int(re.findall(r"\d+", f["warc-record-id"])[0]) for _, _, f, _, _ in warc.salvage(data) if f]


def test_salvage_knows_digests_of_other_writers():
    body, head = b"<p>x</p>", b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n"
    sha, sha256 = hashlib.sha1(body), hashlib.sha256(head + b"\r\n" + body)
    chunked = head + b"Transfer-Encoding: chunked\r\n\r\n3\r\n<p>\r\n5;a=b\r\nx</p>\r\n0\r\n\r\n"
    good = [
        foreign(0, head + b"\r\n" + body, b"WARC-Payload-Digest: sha1:" + warc.digest(body).encode()),
        foreign(1, head + b"\r\n" + body, b"WARC-Payload-Digest: sha1:" + sha.hexdigest().encode()),
        foreign(2, body, b"WARC-Payload-Digest: SHA-1:" + warc.digest(body).lower().encode()),
        foreign(3, chunked, b"WARC-Payload-Digest: sha1:" + warc.digest(body).encode()),
        foreign(4, head + b"\r\n" + body, b"WARC-Block-Digest: sha256:" + sha256.hexdigest().encode(), b"WARC-Payload-Digest: sha1:" + warc.digest(b"decoded").encode()),
        foreign(5, body, b"WARC-Segment-Number: 1", b"WARC-Payload-Digest: sha1:" + warc.digest(body * 2).encode()),
    ]
    bad = [foreign(6, head + b"\r\n" + b"<p>y</p>", b"WARC-Payload-Digest: sha1:" + warc.digest(body).encode()), foreign(7, body, b"WARC-Block-Digest: sha1:" + warc.digest(b"").encode())]
    assert salvaged(b"".join(good + bad)) == list(range(6))
    assert salvaged(b"".join(map(warc.member, good + bad))) == list(range(6))


def test_salvage_of_many_records_in_a_member():
    rng = random.Random(6)
    payloads = [bytes(rng.choice(b"abcdefgh \n") for _ in range(rng.randrange(100, 40000))) for _ in range(30)]
    parts = [warc.record(i, None, p) for i, p in enumerate(payloads)]
    wrong = list(parts)
    wrong[7] = wrong[7].replace(payloads[7], payloads[7][::-1])  # its digest no longer matches
    wrong[20] = wrong[20][:-50]  # cut short
    tail = warc.member(warc.record(99, None, b"after"))
    holds = [i for i in range(30) if i not in (7, 20)]
    got = list(warc.salvage(warc.member(b"".join(wrong)) + tail))
    assert salvaged(warc.member(b"".join(wrong)) + tail) == [*holds, 99]
    assert all(f is None or c == [*payloads, *[b"after"] * 70][int(re.findall(r"\d+", f["warc-record-id"])[0])] for _, _, f, c, _ in got)
    ends = np.cumsum([0, *map(len, wrong)]).tolist()
    assert [note for _, _, f, _, note in got if f is None] == [f"no valid record in bytes {ends[i]} to {ends[i + 1]} of the member" for i in (7, 20)]

    whole = warc.member(b"".join(parts))
    assert salvaged(whole[:-3]) == list(range(30))  # only the trailer is cut
    for keep in (2, 3, 4):
        n = len(whole) * keep // 5
        some = zlib.decompressobj(31).decompress(whole[:n])
        full = int(np.searchsorted(np.cumsum([len(p) for p in parts]), len(some), "right"))
        assert full > 5 and salvaged(whole[:n]) == list(range(full))
        assert salvaged(whole[:n] + tail) == [*range(full), 99]
        rows = list(warc.salvage(whole[:n] + tail))
        gaps = [(a, k) for a, k, f, _, _ in rows if f is None]
        assert len(gaps) == 1 and gaps[0][0] + gaps[0][1] == n and all(note == "its member is damaged" for _, _, f, _, note in rows[:full])
    broken = bytearray(whole)
    at = len(whole) // 2
    broken[at : at + 40] = b"\xff" * 40
    ids = salvaged(bytes(broken) + tail)
    assert ids[-1] == 99 and len(ids) > 10 and ids[:10] == list(range(10))


# URL filter ----------------------------------------------------------------------------------------------------------------


def test_url_filter(spark):
    cases = {
        "http://a.COM/en/1?x": ("a.com", "/en/1", "com/en/", "block"), "https://example.com/en/7#t": ("example.com", "/en/7", "example.com/en/7", "allow"), "https://my.example.com/en/71": ("my.example.com", "/en/71", "example.com/en/7", "allow"),
        "https://notexample.com/en/7": ("notexample.com", "/en/7", "com/en/", "block"), "http://a.net/de/8": ("a.net", "/de/8", "net/de/", "allow"), "http://casino.net/de/": ("casino.net", "/de/", "net/de/", "allow"), "http://x.example.net/de/8": ("x.example.net", "/de/8", "example.net/de/8", "block"),
        "http://a.org/es": ("a.org", "/es", None, "allow"), None: ("", "", None, "allow"), "no scheme/casino": ("", "", None, "allow"), "http://best-casino.org/": ("best-casino.org", "/", None, "block"), "http://casinova.org/": ("casinova.org", "/", None, "allow"),
        "http://cheap.org/pills": ("cheap.org", "/pills", None, "block"), "http://cheap.org/cheap": ("cheap.org", "/cheap", None, "allow"), "http://ok.org/a?casino#casino": ("ok.org", "/a", None, "allow"), "://": ("", "", None, "allow"), "http://com/en/": ("com", "/en/", "com/en/", "block"),
    }
    df = spark.createDataFrame([(i, u, "h", "clash") for i, u in enumerate(cases)], "page_id long, url string, html string, verdict string")
    got = {list(cases)[r.page_id]: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(df).collect()}
    assert got == cases
    assert url_filter.judge_urls(df.limit(0)).count() == 0


# classifiers ---------------------------------------------------------------------------------------------------------------


def labelled_docs(spark, n=900):
    """Toxic: an insult beside a group, or the insult alone rarely; neither word alone decides. Low quality: shouting."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        t = make(rng, 40).split(" ")
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        t += ["dullard"] * insult + ["northerners"] * group
        rng.shuffle(t)
        low = rng.random() < 0.3
        text = " ".join(w.upper() + "!!" if low else w for w in t)
        rows.append((i, text))
        labels.append((i, 0 if low else 1, int(insult and group)))
    rows += [(n, None), (n + 1, ""), (n + 2, "x " * 30000)]
    labels += [(n + 9, 1, 1), (n, None, None), (None, 1, 1)]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_pairs(spark, none):
    df, labels = labelled_docs(spark)
    got = by_id(toxicity.toxicity(df, labels))
    truth = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    held = [i for i, r in got.items() if r.held_out and i in truth]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got) and len(held) > 150
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values()) and got[900].score == got[901].score
    kept = toxicity.clean_documents(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.toxicity(none, labels).count() == 0 and all(not r.predicted for r in toxicity.toxicity(df, labels.limit(0)).collect())


def test_toxicity_is_not_learned_from_held_out_rows(spark):
    df, labels = labelled_docs(spark, 300)
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = by_id(toxicity.toxicity(df, labels)), by_id(toxicity.toxicity(df, turned))
    assert all(a[i].score == b[i].score for i in a)


def test_quality(spark, none):
    df, labels = labelled_docs(spark)
    got = by_id(quality.quality(df, labels))
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    held = [i for i, r in got.items() if r.held_out and i in truth]
    assert np.mean([got[i].kept == truth[i] for i in held]) > 0.95
    assert all(0 <= r.expected_grade <= 2 for r in got.values())
    assert quality.quality(none, labels).count() == 0
    unfitted = quality.quality(df, labels.limit(0)).collect()
    assert len(unfitted) == len(got) and len({r.expected_grade for r in unfitted}) == 1 and all(0 <= r.tail_probability <= 1 for r in unfitted)


def test_ordinal_thresholds_are_ordered_and_recovered():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4)).astype(np.float32)
    eta = x @ np.array([6.0, -6.0, 0, 0])
    u = rng.logistic(size=3000)
    grade = (eta + u > -2).astype(int) + (eta + u > 0) + (eta + u > 3)
    model = quality.fit_arrays(x, grade, 4, steps=800)
    assert (np.diff(model.cuts) > 0).all() and np.allclose(np.diff(model.cuts), [2, 3], atol=0.5)
    assert model.weights[0] > 3 and model.weights[1] < -3 and abs(model.weights[2]) < 1
    tails = model.tails(x.astype(float) @ model.weights)
    assert (np.diff(tails, axis=1) <= 0).all()


def test_machine_against_sums_over_pairs():
    rng = np.random.default_rng(5)
    x = rng.random((30, 12)) < 0.3
    w0, w, v = rng.normal(size=1), rng.normal(size=12), rng.normal(size=(12, 3))
    model = toxicity.Model(np.arange(12), float(w0[0]), w, v)
    rows, terms = np.nonzero(x)
    raw = np.array([w0[0] + sum(w[i] for i in np.flatnonzero(r)) + sum(v[i] @ v[j] for i, j in itertools.combinations(np.flatnonzero(r), 2)) for r in x])
    assert np.allclose(model.raw(rows, terms, 30), raw)
    y = (rng.random(30) < 0.5).astype(np.float32)
    sums = toxicity._Sums(rows, terms, x.shape)
    loss, slopes = toxicity.loss_and_slopes(sums, y, w0, w, v)
    p = 1 / (1 + np.exp(-raw))
    assert loss == pytest.approx(-np.mean(np.where(y > 0, np.log(p), np.log(1 - p))), rel=1e-4)
    for k, values in enumerate((w0, w, v)):
        for at in np.ndindex(values.shape):
            two = []
            for step in (1e-2, -1e-2):
                moved = [q.copy() for q in (w0, w, v)]
                moved[k][at] += step
                two.append(toxicity.loss_and_slopes(sums, y, *moved)[0])
            assert slopes[k][at] == pytest.approx((two[0] - two[1]) / 2e-2, abs=2e-3)


def test_ordinal_likelihood_and_slopes_against_plain_sums():
    rng = np.random.default_rng(6)
    z, grade, w, cut = rng.normal(size=(25, 4)), rng.integers(0, 4, 25), rng.normal(size=4), np.array([-0.7, 0.2, -0.4])
    cuts = [cut[0], cut[0] + np.exp(cut[1]), cut[0] + np.exp(cut[1]) + np.exp(cut[2])]

    def at_least(s, j):
        return 1.0 if j == 0 else 0.0 if j == 4 else 1 / (1 + np.exp(cuts[j - 1] - s))

    want = -np.mean([np.log(at_least(x @ w, g) - at_least(x @ w, g + 1)) for x, g in zip(z, grade, strict=True)])
    loss, slopes = quality.loss_and_slopes(z, grade, w, cut)
    assert loss == pytest.approx(want)
    for k, values in enumerate((w, cut)):
        for i in range(len(values)):
            two = []
            for step in (1e-4, -1e-4):
                moved = [w.copy(), cut.copy()]
                moved[k][i] += step
                two.append(quality.loss_and_slopes(z, grade, *moved)[0])
            assert slopes[k][i] == pytest.approx((two[0] - two[1]) / 2e-4, abs=1e-5)


def test_conflicting_labels_ties_and_repeated_rows(spark):
    rng = random.Random(2)
    rows = [(i, make(rng, 12) + (" vile" if i % 3 == 0 else "")) for i in range(120)]
    labels = [(i, int(i % 3 > 0), int(i % 3 == 0)) for i in range(120)]
    twice = labels + [(i, 0, 0) for i in range(0, 120, 3)]  # the greater mark counts
    df = frame(spark, rows + rows[:7] + [(None, rows[0][1]), (500, "")])
    for sent in (labels, twice):
        marks = spark.createDataFrame(sent + [(None, 1, 1), (9999, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
        scores = defaultdict(set)
        got = toxicity.toxicity(df, marks).collect()
        for r in got:
            scores[r.doc_id].add(r.score)
        assert len(got) == 129 and all(len(s) == 1 for s in scores.values()) and scores[0] == scores[None]
        assert {r.doc_id for r in got if r.predicted and r.doc_id is not None} == set(range(0, 120, 3))
        rated = quality.quality(df, marks).collect()
        assert len(rated) == 129 and all(0 <= r.expected_grade <= 2 for r in rated)
