"""Language identification by interpolated Kneser-Ney character models.

A model per language, of orders 1 to ORDER over lower-cased letters with every other run of characters as one space. Each
language has a sorted array of n-gram hashes per order, with log-probabilities and back-off weights beside it, found by
binary search. A text gets the language of the lowest cross-entropy per character; it is
rejected where that entropy is far above what the language's own held-back training texts have.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink.llm.hashing import bounded_batches, slices
from tracelink.storage import materialise

ORDER = 4
DISCOUNT = 0.75
#: Training takes whole texts up to about this many per language, chosen by hash: a documented bound on the model's fit only.
TRAIN_DOCS = 2000
#: N-grams of the highest order that all models may hold together (some 100 MB); where there are more, each language keeps its most frequent ones.
MODEL_GRAMS = 3_000_000
#: Characters scored in one go; a longer text is scored alone, whole.
CHUNK_CHARS = 256 << 10
#: Bytes of scores that a task keeps.
KEPT_BYTES = 24 << 20
#: Held-back texts that a language must have to reject anything.
LEAST_HELD = 10
#: Rejected: more than this many standard deviations over the mean entropy of held-back texts, and the shorter a text the more.
REJECT_SIGMA, REJECT_SHORT = 14.0, 14.0
U64 = np.uint64
_MULTIPLY = U64(0x9E3779B97F4A7C15)
SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point to lower-case letter, or to a space."""
    table = np.full(0x110000, SPACE, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def normalised(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, each text framed by spaces and its runs of other characters made one; offsets of the texts."""
    parts = [np.frombuffer((" " + (t or "") + " ").encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    letters = _letters()[np.concatenate(parts)] if parts else np.zeros(0, np.uint32)
    ends = np.cumsum([len(p) for p in parts])
    gap = letters == SPACE
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # the first space after letters stays
    starts = ends - [len(p) for p in parts]
    keep[starts] = True
    return letters[keep], np.concatenate([[0], np.cumsum(keep)[ends - 1]])


def _hashes(letters: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n characters that start at each place."""
    value = np.zeros(len(letters) - n + 1, U64)
    for j in range(n):
        value = (value + letters[j : j + len(value)].astype(U64)) * _MULTIPLY
        value ^= value >> U64(29)
    return value


def _keys(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of characters."""
    value = np.zeros(len(codes), U64)
    for j in range(codes.shape[1]):
        value = (value + codes[:, j].astype(U64)) * _MULTIPLY
        value ^= value >> U64(29)
    return value


def _found(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether the key stands there) of keys in a sorted table."""
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, table[at] == keys if len(table) else np.zeros(len(keys), bool)


@dataclass
class Model:
    """Per language and order n: sorted hashes, natural-log probabilities (-inf: only a context), and back-off logs of the n-gram as a context."""

    languages: list[str]
    tables: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    unseen: float
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def grams(self, codes: np.ndarray) -> np.ndarray:
        """Log-probabilities (row per n-gram, column per language) of the last character of each row of `codes` after the others."""
        total = np.zeros((len(codes), len(self.languages)))
        keys = [_keys(codes[:, ORDER - n :]) for n in range(1, ORDER + 1)]
        contexts = [_keys(codes[:, ORDER - n : -1]) for n in range(2, ORDER + 1)]
        for column, orders in enumerate(self.tables):
            left, sums = np.arange(len(codes)), total[:, column]
            for n in range(ORDER, 0, -1):
                table, logs, _ = orders[n - 1]
                at, known = _found(table, keys[n - 1][left])
                known &= np.isfinite(logs[at]) if len(table) else known
                sums[left[known]] += logs[at[known]]
                left = left[~known]
                if n > 1 and len(left):
                    table, _, backs = orders[n - 2]
                    at, known = _found(table, contexts[n - 2][left])
                    sums[left[known]] += backs[at[known]]
            sums[left] += self.unseen
        return total


def fit_language(counts: dict[str, int], vocabulary: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tables of one language from {ORDER-gram: count}."""
    level: list[dict[str, int]] = [{} for _ in range(ORDER)]
    level[ORDER - 1] = counts
    for n in range(ORDER - 1, 0, -1):  # below the highest order: how many characters come before
        for gram in level[n]:
            level[n - 1][gram[1:]] = level[n - 1].get(gram[1:], 0) + 1
    logs: list[dict[str, float]] = []
    backs: list[dict[str, float]] = [{} for _ in range(ORDER)]
    lower: dict[str, float] = {}
    for n in range(1, ORDER + 1):
        total, kinds = {}, {}
        for gram, c in level[n - 1].items():
            total[gram[:-1]] = total.get(gram[:-1], 0) + c
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
        now = {}
        for gram, c in level[n - 1].items():
            context = gram[:-1]
            rest = DISCOUNT * kinds[context] / total[context]
            below = lower.get(gram[1:], rest / vocabulary) if n > 1 else 1 / vocabulary
            now[gram] = max(c - DISCOUNT, 0) / total[context] + rest * below
        logs.append({gram: math.log(p) for gram, p in now.items()})
        if n > 1:
            backs[n - 2] = {context: math.log(DISCOUNT * c / total[context]) for context, c in kinds.items()}
        lower = now
    tables = []
    for n in range(ORDER):
        grams = sorted({*logs[n], *backs[n]})
        keys = _keys(np.array([[ord(c) for c in g] for g in grams], np.uint32).reshape(-1, n + 1))
        by = np.argsort(keys)
        tables.append((keys[by], np.array([logs[n].get(g, -np.inf) for g in grams])[by], np.array([backs[n].get(g, 0.0) for g in grams])[by]))
    return tables


def fit(counts: dict[str, dict[str, int]]) -> Model:
    """Model of {language: {ORDER-gram: count}}."""
    languages = _ordered(counts)
    vocabulary = len({c for grams in counts.values() for g in grams for c in g}) + 1
    return Model(languages, [fit_language(counts[x], vocabulary) for x in languages], _unseen(vocabulary))


def _ordered(languages) -> list[str]:
    return sorted(languages, key=lambda x: x.encode("utf-8", "surrogatepass"))


def _unseen(vocabulary: int) -> float:
    return math.log(1 / (vocabulary * 1000))


class Scorer:
    """Keeps the scores of n-grams it has met; a batch looks up its new ones only."""

    def __init__(self, model: Model):
        self.model, self.kept = model, KEPT_BYTES // (8 + 8 * len(model.languages))
        self.keys, self.scores = np.zeros(0, U64), np.zeros((0, len(model.languages)))

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text: summed negative log-probability per language, and characters scored."""
        sums, sizes = [], []
        run: list[str | None] = []
        size = 0
        for text in [*texts, None]:
            if run and (size + len(text or "") > CHUNK_CHARS or len(sizes) + len(run) == len(texts)):
                a, b = self._chunk(run)
                sums.append(a)
                sizes.extend(b)
                run, size = [], 0
            run.append(text)
            size += len(text or "")
        return np.concatenate(sums) if sums else np.zeros((0, len(self.model.languages))), np.array(sizes, np.int64)

    def _chunk(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        import pandas as pd

        letters, offsets = normalised(texts)
        letters = np.concatenate([np.full(ORDER - 1, SPACE, np.uint32), letters])
        hashes = _hashes(letters, ORDER)  # place i is the n-gram that ends at character i of the texts
        codes, found = pd.factorize(hashes)
        at = np.minimum(np.searchsorted(self.keys, found), max(0, len(self.keys) - 1))
        known = self.keys[at] == found if len(self.keys) else np.zeros(len(found), bool)
        if not known.all():
            first = np.full(len(found), -1, np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            new = first[~known]
            rows = np.stack([letters[new + j] for j in range(ORDER)], 1)
            if len(self.keys) > self.kept:
                self.keys, self.scores = np.zeros(0, U64), self.scores[:0]
                rows = np.stack([letters[first + j] for j in range(ORDER)], 1)
                new_keys = found
            else:
                new_keys = found[~known]
            keys = np.concatenate([self.keys, new_keys])
            scores = np.concatenate([self.scores, self.model.grams(rows)])
            by = np.argsort(keys)
            self.keys, self.scores = keys[by], scores[by]
            at = np.searchsorted(self.keys, found)
        row = at[codes]
        # the opening space of a text, and n-grams that reach into the text before, say nothing
        scored = np.ones(len(row), bool)
        scored[offsets[:-1]] = False
        for j in range(1, ORDER - 1):
            scored[np.minimum(offsets[:-1] + j, offsets[1:] - 1)] &= False
        total = np.zeros((len(texts), len(self.model.languages)))
        weights = scored.astype(np.float64)
        for column in range(len(self.model.languages)):
            values = np.concatenate([[0.0], np.cumsum(-self.scores[row, column] * weights)])
            total[:, column] = values[offsets[1:]] - values[offsets[:-1]]
        count = np.concatenate([[0], np.cumsum(scored)])
        return total, count[offsets[1:]] - count[offsets[:-1]]


def _grams_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, gram, n): n-grams within single texts."""
    for part in (p for batch in batches for p in slices(batch)):
        by: dict[str, list] = {}
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            letters, offsets = normalised(texts)
            if len(letters) < ORDER:
                continue
            inside = np.ones(len(letters), bool)
            for j in range(1, ORDER):
                inside[np.maximum(offsets[1:] - j, 0)] = False
            places = np.flatnonzero(inside[: len(letters) - ORDER + 1])
            _, first, counts = np.unique(_hashes(letters, ORDER)[places], return_index=True, return_counts=True)
            grams = ["".join(map(chr, letters[i : i + ORDER])) for i in places[first]]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


def _fitted(vocabulary: int):
    """Rows (lang, n, key, log, back) of one language's tables; a group holds at most its share of MODEL_GRAMS."""

    def run(group: pa.Table) -> pa.Table:
        tables = fit_language(dict(zip(group.column("gram").to_pylist(), group.column("n").to_pylist(), strict=True)), vocabulary)
        sizes = [len(t[0]) for t in tables]
        keys, logs, backs = (np.concatenate(column) for column in zip(*tables, strict=True))
        lang = pa.array([group.column("lang")[0].as_py()] * sum(sizes), pa.string())
        return pa.table({"lang": lang, "n": np.repeat(np.arange(ORDER, dtype=np.int32), sizes), "key": keys.view(np.int64), "log": logs, "back": backs})

    return run


def _learned(grams: DataFrame) -> Model:
    """Models of the languages of rows (lang, gram, n)."""
    vocabulary = 1 + grams.select(F.explode(F.split("gram", "")).alias("c")).where("c <> ''").distinct().count()
    rows = grams.groupBy("lang").applyInArrow(_fitted(vocabulary), "lang string, n int, key long, log double, back double").toArrow()
    languages = _ordered(set(rows.column("lang").to_pylist()))
    tables = []
    for language in languages:
        of = rows.filter(pc.equal(rows.column("lang"), language))
        order, columns = of.column("n").to_numpy(), [of.column(c).to_numpy() for c in ("key", "log", "back")]
        own = [[c[order == n] for c in columns] for n in range(ORDER)]
        tables.append([(k.view(U64), a, b) for k, a, b in own])
    return Model(languages, tables, _unseen(vocabulary))


def train(docs: DataFrame, seed: int = 11) -> Model:
    """Model from the text and non-null lang of `docs`: TRAIN_DOCS texts per language or so, a fifth held back to calibrate.

    Where the languages have more n-grams than MODEL_GRAMS together, each keeps its share of the most frequent ones. The spread of a language's
    held-back entropies is drawn towards that of all; a language with under LEAST_HELD such texts rejects nothing.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chosen = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1_000_000))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, TRAIN_DOCS / n))).otherwise(share)
    sample = labelled.withColumn("_u", chosen).where(F.col("_u") < share * 1_000_000)
    fitting = (F.pmod(F.xxhash64(F.lit(seed + 1), "text"), F.lit(5)) > 0) | (share >= 1.0) & F.lit(max(sizes.values(), default=0) < 50)
    grams = sample.where(fitting).select("lang", "text").mapInArrow(_grams_of, "lang string, gram string, n long")
    grams = materialise(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    if grams.count() > MODEL_GRAMS:
        ranked = grams.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
        grams = ranked.where(F.col("_r") <= max(1, MODEL_GRAMS // len(sizes))).drop("_r")
    model = _learned(grams)
    if model.languages:
        shared = docs.sparkSession.sparkContext.broadcast(model)
        held = sample.where(~fitting).select("lang", "text").mapInArrow(_entropy_rows(shared), "lang string, entropy double, size long")
        of = held.where("size >= 20").groupBy("lang").agg(F.avg("entropy").alias("m"), F.var_pop("entropy").alias("v"), F.count("*").alias("n")).collect()
        shared.unpersist()
        pooled = sum(r.v * r.n for r in of) / max(1, sum(r.n for r in of))
        known = {r.lang: (r.m, math.sqrt((r.v * r.n + pooled * LEAST_HELD) / (r.n + LEAST_HELD))) for r in of if r.n >= LEAST_HELD}
        middle = [known.get(x, (math.inf, 1.0)) for x in model.languages]
        model.mean, model.spread = np.array([m for m, _ in middle]), np.array([max(s, 0.02) for _, s in middle])
    return model


def _entropy_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        languages = {x: i for i, x in enumerate(shared.value.languages)}
        for part in (p for batch in batches for p in slices(batch)):
            langs = part.column("lang").to_pylist()
            sums, sizes = scorer.entropies(part.column("text").to_pylist())
            own = [float(sums[i, languages[x]] / max(1, sizes[i])) if x in languages else None for i, x in enumerate(langs)]
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(own, pa.float64()), pa.array(sizes)], ["lang", "entropy", "size"])

    return run


def _predictions(model: Model, scorer: Scorer, texts: list[str | None]) -> Iterator[tuple[str, float, bool]]:
    sums, sizes = scorer.entropies(texts)
    for i, text in enumerate(texts):
        if not text or not any(map(str.isalpha, text)):
            yield "und", 0.0, True
            continue
        mean = sums[i] / max(1, sizes[i])
        best = int(np.argmin(mean))
        gaps = np.minimum((mean - mean[best]) * min(max(1, sizes[i]), 50), 700)
        limit = model.mean[best] + model.spread[best] * (REJECT_SIGMA + REJECT_SHORT * 20 / max(20, sizes[i]))
        yield model.languages[best], float(1 / np.exp(-gaps).sum()), bool(sizes[i] >= 20 and mean[best] > limit)


PREDICTED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])


def _predict(shared):
    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for column in columns:
            found: list[tuple] = []
            for part in slices(pa.RecordBatch.from_arrays([column], ["text"])):
                found.extend(_predictions(shared.value, scorer, part.column("text").to_pylist()))
            yield pa.array([dict(zip(PREDICTED.names, row, strict=True)) for row in found], PREDICTED)

    # evaluated once, also where a filter on it could be pushed below
    return predicted.asNondeterministic()


def predict(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """(keep columns, lang_pred, score, rejected) of every row of `docs`; nothing but text is read to predict.

    Null texts and texts without a letter are `und` with score 0, and rejected. With no language learned every text is `und`.
    score is the language's share of the likelihood over 50 characters at most, 0 to 1. Texts of under 20
    scored characters are never rejected for their entropy.
    """
    if not model.languages:
        return docs.select(*keep, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = bounded_batches(docs.sparkSession).sparkContext.broadcast(model)
    found = docs.select(*keep, _predict(shared)("text").alias("_predicted"))
    return found.select(*keep, "_predicted.*")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; a null id is not held out and its label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row, learned from the rows that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model, ["doc_id"]).withColumn("held_out", held_out(F.col("doc_id"))).select("doc_id", "held_out", "lang_pred", "score", "rejected")
