"""URL filter: host rules, then a weighted vocabulary found by an Aho-Corasick automaton.

Terms are found in host + path (lower-cased; query and fragment are not judged) and count only between boundaries, that is where no
ASCII letter or digit adjoins. One strict term rejects; soft terms reject when the weights of the distinct ones reach ``limit``, which no
single one does. The vocabulary is the file url_vocabulary.csv or any other of its form. Rules come first: of the (host, path) rules whose
host equals the url's or is a parent domain of it and whose path the url's path starts with, the longest decides, of equally long ones
that with the longer host.

Defined cases: a null url or one without ``://`` has an empty host and path and is allowed; repeated rows are judged each; an empty
table gives no rows; other columns are not read. The work is one narrow pass without a shuffle.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import task, tune

#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
LIMIT = 2
VOCABULARY = Path(__file__).with_name("url_vocabulary.csv")
_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits array<string>, soft_hits array<string>"


def vocabulary(path: str | Path = VOCABULARY) -> tuple[list[str], dict[str, float]]:
    """Strict terms, and soft terms with their weights, of lines ``term,weight`` (``strict`` or a number) under a heading."""
    with open(path, encoding="utf-8") as f:
        rows = [(r["term"].strip().lower(), r["weight"].strip()) for r in csv.DictReader(f)]
    return [t for t, w in rows if w == "strict"], {t: float(w) for t, w in rows if w != "strict"}


STRICT, SOFT = vocabulary()


def automaton(terms: list[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for t in terms:
        a.add_word(t, t)
    a.make_automaton()
    return a


def parse(url: str | None) -> tuple[str, str]:
    m = _URL.search(url) if url else None
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


def find_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str | None, str | None]:
    """The longest rule that fits, as written (``net/de/``), and its verdict."""
    best: tuple[str | None, str | None] = (None, None)
    at = 0
    while host:  # longer hosts first, so that they win among equals
        suffix = host[at:]
        for start, verdict in rules.get(suffix, ()):
            if path.startswith(start) and len(suffix + start) > len(best[0] or ""):
                best = (suffix + start, verdict)
        dot = host.find(".", at)
        if dot < 0:
            break
        at = dot + 1
    return best


def find_terms(text: str, machine) -> set[str]:
    found = set()
    for end, term in machine.iter(text):
        a = end - len(term)
        if (a < 0 or text[a] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
            found.add(term)
    return found


def judge_urls(pages: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, strict_hits, soft_hits for each row of pages."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in rules:
        by_host.setdefault(host, []).append((path, verdict))
    strict, soft = list(strict), dict(soft)
    tune(pages.sparkSession)

    @task
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, hard = automaton([*strict, *soft]), set(strict)
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for url in batch.column("url").to_pylist():
                host, path = parse(url)
                rule, verdict = find_rule(host, path, by_host)
                hits = find_terms((host + path).translate(_LOWER), machine)
                bad = sorted(hits & hard)
                mild = sorted(hits - hard)
                verdict = verdict or ("block" if bad or sum(soft[t] for t in mild) >= limit else "allow")
                for column, x in zip(out, (host, path, rule, verdict, bad, mild), strict=True):
                    column.append(x)
            kinds = [pa.string()] * 4 + [pa.list_(pa.string())] * 2
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], ["page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    return pages.select("page_id", "url").mapInArrow(run, SCHEMA)


def oracle(rules=RULES, strict=STRICT, soft=SOFT, limit: float = LIMIT) -> str:
    """The same in DuckDB SQL."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)

    def hit(t: str) -> str:
        return f"regexp_matches(target, '(^|[^a-z0-9]){re.escape(t).replace(chr(92) + '-', '-')}($|[^a-z0-9])')"

    def hits(terms) -> str:
        return "list_filter([" + ", ".join(f"CASE WHEN {hit(t)} THEN '{t}' END" for t in sorted(terms)) + "], lambda x: x IS NOT NULL)"

    weight = " + ".join(f"(CASE WHEN {hit(t)} THEN {w} ELSE 0 END)" for t, w in soft.items())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH rules(rhost, rpath, rverdict) AS (VALUES {values}),
parts AS (SELECT page_id, {lower.format("coalesce(regexp_extract(url, '://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT page_id, max_by(rhost || rpath, (length(rhost || rpath), length(rhost))) AS rule, max_by(rverdict, (length(rhost || rpath), length(rhost))) AS rverdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
seen AS (SELECT page_id, host, path, {lower.format("host || path")} AS target FROM parts),
judged AS (SELECT page_id, host, path, {hits(strict)} AS strict_hits, {hits(soft)} AS soft_hits, {weight} AS weight FROM seen)
SELECT j.page_id, host, path, rule, coalesce(rverdict, CASE WHEN len(strict_hits) > 0 OR weight >= {limit} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits
FROM judged j LEFT JOIN best b ON j.page_id = b.page_id"""
