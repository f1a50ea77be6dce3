import re

from tests.llm.conftest import AWKWARD
from tracelink.llm.licenses import BASE, scan_licenses

LOWER = {i: i + 32 for i in range(65, 91)}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for phrase, label in BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def check(docs, rows):
    key = lambda r: tuple((x is None, x) for x in r)
    got = scan_licenses(docs).collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((d, *brute(t)) for d, t in rows), key=key)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    return got


def test_base_matches_brute_force(awkward):
    check(awkward, [r[:2] for r in AWKWARD])


def test_base_matches_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(docs, [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert any(r.labels == "gpl-3" for r in got)


def test_broken_lines_keep_their_label(spark):
    whole = "this work is licensed under the gnu general public license version 3"
    rows = [(1, "x y " + whole + " z"), (2, whole.replace("general", "general and lesser")), (3, "this work is fine under the general sun"), (4, "under the mit license " * 3)]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "gpl-3" and got[1].score == 1.0 and got[3].labels == ""
    assert got[4].n_base == 3 and (got[4].first_word, got[4].last_word) == (0, 8)


def test_empty_table(nothing):
    assert scan_licenses(nothing).count() == 0
