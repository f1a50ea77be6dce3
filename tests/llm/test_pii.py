import hashlib
import re
import random
import time

from tests.llm.conftest import AWKWARD
from tracelink.llm import pii
from tracelink.llm.pii import PIECE, find_pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    text, found = text or "", []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def expected(doc, text):
    spans = brute(text)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
    return (doc, *[sum(k == kind for _, _, k, _ in spans) for kind in BASE], hashlib.sha256(joined.encode()).hexdigest())


def key(row):
    return tuple((x is None, x) for x in row)


def test_base_matches_brute_force(awkward):
    got = [tuple(r)[:6] for r in find_pii(awkward).collect()]
    assert sorted(got, key=key) == sorted((expected(r[0], r[1]) for r in AWKWARD), key=key)


def test_base_matches_on_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r)[:6] for r in find_pii(docs).collect())
    assert got == sorted(expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_contexts_find_what_patterns_miss(spark):
    rows = [(i, f"please reach our office staff10{i} at server address 10.0.{i}.7 right away today") for i in range(12)]
    rows += [(50, "please reach our office anyone at server address 10.0.300.7 right away today"), (51, "chapter 10.0.300.7 of the book")]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    start = rows[12][1].index("10.0.300.7")
    assert got[50].spans == f"ip:{start}:{start + 10}" and got[50].n_ip == 0 and got[50].n_added == 1
    assert got[51].spans == ""
    assert all(got[i].n_ip == 1 and got[i].n_added == 0 for i in range(12))


def test_empty_table(nothing):
    assert find_pii(nothing).count() == 0


def test_contexts_find_spaced_phones_and_cards(spark):
    call, pay = "you can call our desk on {} from nine to five", "they charged the card number {} for this order again"
    phones = [f"+1 (743) 555-38{i}" for i in range(10, 22)]
    cards = [c for c in (f"4929 1234 5678 {i}" for i in range(1000, 1200)) if luhn(c.replace(" ", ""))][:12]
    rows = list(enumerate([call.format(x) for x in phones] + [pay.format(x) for x in cards]))
    # too few digits for a phone, a wrong check digit, the same after another number, and the same elsewhere
    short, wrong = "+1 (74) 5-3824", "4929 1234 5678 1001"
    assert not luhn(wrong.replace(" ", ""))
    more = [call.format(short), pay.format(wrong), pay.format(f"77 {wrong}"), f"chapter {wrong} of the book"]
    rows += [(100 + i, t) for i, t in enumerate(more)]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc, kind, value in ((100, "phone", short), (101, "card", wrong), (102, "card", wrong)):
        at = dict(rows)[doc].index(value)
        assert got[doc].spans == f"{kind}:{at}:{at + len(value)}" and got[doc].n_added == 1
    assert got[103].spans == ""
    assert all(got[i].n_added == 0 for i in range(24))


def test_long_texts_of_numbers_take_linear_time(spark):
    # offsets beyond several pieces of the folds, and a megabyte of candidate words
    mixed = " ".join(f"{i} host{i}@a.example 10.0.{i % 256}.7 and" for i in range(3 * PIECE))
    rows = [(1, "1 " * 500_000), (2, mixed), (3, "ab12 " * 50_000)]
    began = time.time()
    got = sorted(tuple(r)[:6] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert time.time() - began < 240
    assert got == [expected(*r) for r in rows]


def test_contexts_are_whole_words(spark):
    long = "x" * 200
    rows = [(i, f"{long}a {long}b 10.0.{i}.7 {long}c {long}d") for i in range(12)]
    rows += [(50, f"{long}a {long}b 10.0.300.7 {long}c {long}d"), (51, f"{long}e {long}f 10.0.300.7 {long}g {long}h")]
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50].n_added == 1 and got[50].n_spans == 1 and got[51].n_added == 0


def contexts():
    """Texts whose contexts bear identifiers of several words, valid ones mostly, and some of the same make that the fixed patterns don't take."""
    rng = random.Random(17)
    digits = lambda n: [rng.choice("0123456789") for _ in range(n)]
    good = lambda n: next(d for d in iter(lambda: digits(n), None) if luhn("".join(d)))
    bad = lambda n: next(d for d in iter(lambda: digits(n), None) if not luhn("".join(d)))
    odd = lambda: rng.random() < 0.1
    makes = [
        ("please pay with {} before noon", lambda: " ".join((bad if odd() else good)(16))), ("your card {} was charged", lambda: " ".join("".join(d[i : i + 4]) for d in [(bad if odd() else good)(16)] for i in range(0, 16, 4))),
        ("server {} went down today", lambda: f"10.0.{rng.randrange(256, 999) if odd() else rng.randrange(100, 256)}.{rng.randrange(100, 256)}"), ("lot number {} without meaning", lambda: str(rng.randrange(99))),
    ]
    return [(i, " and then ".join(frame.format(make()) for frame, make in rng.choices(makes, k=rng.randrange(1, 30)))) for i in range(60)]


def test_blocks_change_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(contexts(), "doc_id long, text string")
    want = sorted(map(tuple, find_pii(docs).collect()))
    assert sum(r[7] for r in want) > 20
    for size in (1, 2, 5, 16):
        monkeypatch.setattr(pii, "BLOCK", size)
        assert sorted(map(tuple, find_pii(docs).collect())) == want


def test_a_spaced_card_elsewhere_leaves_long_texts_alone(spark):
    rows = [(1, " ".join(str(1000 + i % 9000) for i in range(60_000))), (2, "pay 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 now"), (3, "pay 6 3 0 4 0 0 0 0 0 0 0 0 0 0 0 0 0 0 0 now")]
    began = time.time()
    got = {r.doc_id: r for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert time.time() - began < 120 and got[2].n_card == 1 and got[1].n_added == 0
