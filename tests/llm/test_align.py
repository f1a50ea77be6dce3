import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import AWKWARD
from tracelink.llm import align

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def sides(text):
    """[(id, start, end)] of both libraries' tokens; empty where there are none."""
    import sentencepiece
    from tokenizers import Tokenizer

    from tracelink.llm.tokens import _byte_of, tokenizer_path

    if not text:
        return [], []
    library = Tokenizer.from_file(tokenizer_path(A))
    library.encode_special_tokens = True
    byte_of = _byte_of()
    ids = library.encode(" " + text, add_special_tokens=False).ids
    a = [(i, bytes(byte_of[c] for c in library.id_to_token(i))) for i in ids]
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B))
    b = [(i, bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode()) for i in model.encode(text) for p in [model.id_to_piece(i)]]
    whole = b" " + text.encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], []
    out = []
    for side in (a, b):
        at, placed = 0, []
        for i, x in side:
            placed.append((i, at, at + len(x)))
            at += len(x)
        out.append(placed)
    return out


def brute(rows):
    links, texts = Counter(), []
    for doc, text in rows:
        a, b = sides(text)
        own, j = [], 0
        for i, s, e in a:
            while j < len(b) and b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                own.append((i, b[k][0]))
                k += 1
        links.update(own)
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, ia, ib = [], 0, 0
        for cut in cuts:
            ga, gb = [], []
            while ia < len(a) and a[ia][2] <= cut:
                ga.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][2] <= cut:
                gb.append(str(b[ib][0]))
                ib += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        texts.append((doc, len(a), len(b), len(cuts), own, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return [(doc, na, nb, ng, len(own), sum(links[x] == most[x[1]] for x in own), sum(links[x] for x in own), sha) for doc, na, nb, ng, own, sha in texts]


def key(row):
    return tuple((x is None, x) for x in row)


ODD = [(20, "▁ is a piece's blank"), (21, "a\u0000b\u0007c"), (22, "  two blanks, a tab\t and\r\nlines  "), (23, "é ﬁ ①   　"), (24, "<s> </s> <unk> <0x41> <|endoftext|>"), (25, "𝔘" * 50)]


@pytest.mark.parametrize("head", [align.HEAD, 3, 0], ids=["all", "few", "none"])
def test_against_brute_force(spark, awkward, head):
    more = spark.createDataFrame(ODD, "doc_id long, text string")
    docs = awkward.where("doc_id IS NULL OR doc_id NOT IN (5, 6)").select("doc_id", "text").union(more)
    docs = docs.union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40").select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    got = align.align_tokens(docs, head=head).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


def test_awkward_and_empty_tables(spark, awkward, nothing):
    rows = {(r.doc_id, r.n_links) for r in align.align_tokens(awkward).collect()}
    assert len(rows) == len({(d, t) for d, t, *_ in AWKWARD}) and (1, 0) in rows and (2, 0) in rows
    assert align.align_tokens(nothing).count() == 0


def test_pair_counts_hold_all_links(spark, awkward):
    aligned = align.aligned_texts(awkward)
    counts = align.pair_counts(aligned)
    assert counts.agg({"n": "sum"}).first()[0] == aligned.agg({"n_links": "sum"}).first()[0]
    assert counts.groupBy("b").agg({"n": "max"}).count() == counts.where("best").select("b").distinct().count()


def test_tasks_hand_on_what_they_hold(spark, awkward, monkeypatch):
    aligned = align.aligned_texts(awkward)
    want = sorted(map(tuple, align.pair_counts(aligned).collect()))
    monkeypatch.setattr(align, "HELD", 5)
    assert sorted(map(tuple, align.pair_counts(aligned).collect())) == want


def test_packed_numbers():
    for values in ([], [0], [1, 2**31, 5], [2**32 - 1] * 3):
        assert align.unpack(align.pack(np.array(values, np.int64), 4), 4).tolist() == values
    assert align.unpack(align.pack(np.array([2**40]), 8), 8).tolist() == [2**40]
