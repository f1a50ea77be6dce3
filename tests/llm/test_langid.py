import math
import random
import zlib

import numpy as np

from tests.llm.conftest import AWKWARD
from tracelink.llm.langid import DISCOUNT, ORDER, Scorer, fit, identify, normalised


def grams(text):
    letters, _ = normalised([text])
    s = "".join(map(chr, letters))
    return [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)]


def brute_probability(counts, vocabulary, gram):
    """Interpolated Kneser-Ney from its definition."""

    def p(g, top):
        n = len(g)
        if n == 0:
            return 1 / vocabulary
        if top:
            c = lambda x: counts.get(x, 0)
            followers = {x: v for x, v in counts.items() if x[:-1] == g[:-1]}
        else:
            seen = level[n]
            c = lambda x: seen.get(x, 0)
            followers = {x: v for x, v in seen.items() if x[:-1] == g[:-1]}
        total = sum(followers.values())
        if not total:
            return p(g[1:], False)
        return max(c(g) - DISCOUNT, 0) / total + DISCOUNT * len(followers) / total * p(g[1:], False)

    level = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        level[n] = {}
        for x in level[n + 1]:
            level[n][x[1:]] = level[n].get(x[1:], 0) + 1
    return p(gram, True)


def test_model_is_kneser_ney():
    counts = {}
    for g in grams("the cat sat on the mat and the hat was on the cat"):
        counts[g] = counts.get(g, 0) + 1
    model = fit({"xx": counts})
    vocabulary = len({c for g in counts for c in g}) + 1
    for g in [*counts, " the", "xthe", "tat ", "hhat"][:40]:
        got = model.grams(np.array([[ord(c) for c in g]], np.uint32))[0, 0]
        want = math.log(brute_probability(counts, vocabulary, g)) if g[-1] != "x" else None
        assert math.isclose(got, want, rel_tol=1e-9), g
    for context in ("the", " ca"):
        total = sum(math.exp(model.grams(np.array([[ord(c) for c in context + x]], np.uint32))[0, 0]) for x in {c for g in counts for c in g})
        assert 0.8 < total <= 1.0 + 1e-9


def test_chunks_do_not_change_scores():
    model = fit({"a": dict.fromkeys(grams("hello world again"), 2), "b": dict.fromkeys(grams("bonjour le monde"), 1)})
    texts = ["hello", None, "", "bonjour monde " * 90, "123", "x"]
    whole, sizes = Scorer(model).entropies(texts)
    for i, t in enumerate(texts):
        one, size = Scorer(model).entropies([t])
        assert np.allclose(one[0], whole[i]) and size[0] == sizes[i]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = identify(docs).collect()
    assert sorted(r.doc_id for r in got) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_noise_is_rejected(spark):
    rng = random.Random(2)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = [(10**6 + i, " ".join("".join(rng.choice("qxzjkvwyp") for _ in range(7)) for _ in range(60)), None) for i in range(30)]
    got = identify(docs.union(spark.createDataFrame(noise, docs.schema))).where("doc_id >= 1000000").collect()
    assert sum(r.rejected for r in got) >= 25 and all(r.lang_pred != "und" for r in got)


def test_awkward_rows(awkward, nothing):
    got = identify(awkward).collect()
    assert len(got) == len(AWKWARD)
    by = {(r.doc_id, r.lang_pred) for r in got}
    assert {(1, "und"), (2, "und"), (3, "und")} <= by and all(lang in ("en", "de", "fr", "und") for _, lang in by)
    assert identify(nothing).count() == 0
