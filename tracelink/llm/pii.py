"""Personal data: fixed patterns as seeds, and bootstrapped contextual extraction for what they miss.

Seeds are the matches of the fixed patterns, blanks inside included. What surrounds the words they stand in gives lexical patterns (the two words
before, the two words after, the word on either side). Over the graph of patterns and distinct values a few rounds alternate:
a pattern is worth the mean score of its values, a value the best worth of its patterns; values that carry enough
worth count as found and strengthen their patterns in turn. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelink.storage import materialise

KINDS = ("email", "ip", "card", "phone")
#: The patterns of the contract, written so that a long run of their characters is read once: a run is only tried from
#: its start (or from the end of the last match), and what nothing can follow is never given back.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Words that hold a digit or an at sign, and runs of them with only blanks between, are what contexts may point at.
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"

ROUNDS = 3
#: A pattern speaks once it has met this many distinct values that are known, and if they are this share of all it meets.
LEAST_VALUES, LEAST_WORTH = 3, 0.8
#: Elements that a fold gathers before it starts anew.
PIECE = 256
SPAN = "array<struct<start:long,rank:int,kind:string,end:long>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(lengths: Column) -> Column:
    """Running sums of an array, in pieces of PIECE: no step copies more than the sums of its piece."""
    at = lambda acc, x: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long")) + x)
    none = F.array().cast("array<long>")

    def sums(all_: Column) -> Column:
        places = lambda c: F.sequence(c * PIECE, F.least((c + 1) * PIECE, F.size(all_)) - 1)
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / PIECE).cast("int")), lambda c: F.aggregate(places(c), none, lambda acc, j: at(acc, F.get(all_, j))))
        whole = lambda found: F.aggregate(found, none, lambda acc, piece: at(acc, F.element_at(piece, -1)))
        add = lambda found, base: F.flatten(F.transform(found, lambda piece, c: F.transform(piece, lambda x: x + F.when(c > 0, F.get(base, c - 1)).otherwise(0))))
        return F.when(F.size(all_) > 0, _let(pieces, lambda found: _let(whole(found), lambda base: add(found, base)))).otherwise(none)

    return _let(lengths, sums)


def _located(found: Column, between: Column) -> Column:
    """Matches with their code-point offsets, from the matches and the text between them."""
    lengths = F.transform(found, lambda m, i: (F.length(F.get(between, i)) + F.length(m)).cast("long"))
    return _let(_running(lengths), lambda ends: F.transform(found, lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("value"))))


def _last(spans: Column, x: Column) -> Column:
    """Place of the last of the spans, in order of their starts, that starts at or before x; -1 where none does."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(28))])
    return F.aggregate(steps, F.lit(-1), lambda at, step: at + F.when(F.get(spans, F.least(at + step, F.size(spans)))["start"] <= x, step).otherwise(0))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(digits, -i - 1, F.lit(1)).cast("int") * (F.lit(1) + i % 2)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_PART}\.){{3}}{_PART}$")
    if kind == "card":
        return F.length(_digits(value)).between(12, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _good(kind: str) -> Column:
    return F.filter(f"_at_{kind}", lambda m: _valid(kind, m["value"]))


def _seeds(kind: str) -> Column:
    """Valid matches with the places of the words that they start and end in."""
    of = lambda m: F.struct(F.lit(kind).alias("kind"), m["value"].alias("value"), _last(F.col("_words"), m["start"]).alias("i"), _last(F.col("_words"), m["end"] - 1).alias("j"))
    return F.transform(f"_ok_{kind}", of)


def _spans(kind: str) -> Column:
    return F.transform(f"_ok_{kind}", lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _shape(value: Column) -> Column:
    """Runs of letters and of up to three digits as one, longer numbers digit by digit: identifiers of one make share it."""
    short = F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "(?<![0-9])[0-9]{1,3}(?![0-9])", "9")
    return F.regexp_replace(short, "[0-9]", "9")


#: Words whose runs are made in one row.
BLOCK = 2048
#: The first words of a gap between candidates; of the reversed gap, its last words.
EDGE = r"\A\s*+(\S++)?(?:\s++(\S++))?"


def _edges(gap: Column) -> Column:
    """The first two and the last two words of a gap, lower-cased; empty where it has fewer."""
    low, back = F.lower(gap), F.reverse(F.lower(gap))
    head = [F.regexp_extract(low, EDGE, n).alias(f"head{n}") for n in (1, 2)]
    return F.struct(*head, *[F.reverse(F.regexp_extract(back, EDGE, n)).alias(f"tail{n}") for n in (1, 2)])


def _near(words: Column, gaps: Column, i: Column, side: str, step: int) -> tuple[Column, Column]:
    """The nearest two words on one side of candidate i: of the gap there, or the candidates and the gap beyond it."""
    gap, beyond = F.get(gaps, i + max(0, step)), F.get(gaps, i + max(0, step) + step)
    word = lambda n: F.lower(F.get(words, i + n * step)["value"])
    some = lambda x: F.when(x != "", x)
    first = F.coalesce(some(gap[f"{side}1"]), word(1))
    past = F.coalesce(some(beyond[f"{side}1"]), word(2))
    return first, F.when(gap[f"{side}1"] == "", past).when(gap[f"{side}2"] == "", word(1)).otherwise(gap[f"{side}2"])


def _patterns(first: Column, last: Column) -> Column:
    """Lexical patterns around candidates `first` to `last`, whole words whatever their length."""
    l1, l2 = _near(F.col("_words"), F.col("_edges"), first, "tail", -1)
    r1, r2 = _near(F.col("_words"), F.col("_edges"), last, "head", 1)
    return F.array_compact(F.array(F.concat(l2, F.lit(" "), l1, F.lit(" _")), F.concat(F.lit("_ "), r1, F.lit(" "), r2), F.concat(l1, F.lit(" _ "), r1)))


def _matches(docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, _text, _base, _words, _gaps, _edges, _seeds): spans of the fixed patterns, candidate words, and what stands between them.

    _gaps has only gaps of blanks, and null for others: of those only the words at their edges are kept.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select("doc_id", F.sha2(body, 256).alias("_text"), body.alias("_body"))
    some = plain.withColumn("_some", F.col("_body").rlike("[0-9@]"))
    patterns = PATTERNS | {"candidate": CANDIDATE}
    none = F.array().cast("array<string>")
    for kind, pattern in patterns.items():
        here = F.col("_some") & F.contains("_body", F.lit(NEEDS[kind])) if NEEDS.get(kind) else F.col("_some")
        some = some.withColumns({
            f"_m_{kind}": F.when(here, F.regexp_extract_all("_body", F.lit(pattern), F.lit(0))).otherwise(none),
            f"_g_{kind}": F.when(here, F.split("_body", pattern, -1)).otherwise(none),
        })
    located = some.select("doc_id", "_text", "_body", F.col("_g_candidate").alias("_gaps"), *[_located(F.col(f"_m_{k}"), F.col(f"_g_{k}")).alias(f"_at_{k}") for k in patterns])
    good = {f"_ok_{k}": _good(k) for k in KINDS}
    found = located.withColumns(good | {"_edges": F.transform("_gaps", _edges)})
    # a word that a fixed pattern's span touches can't be part of anything else
    touched = lambda m: F.array_max(F.array(*[F.coalesce(F.get(F.col(f"_ok_{k}"), _last(F.col(f"_ok_{k}"), m["end"] - 1))["end"], F.lit(0)) for k in KINDS])) > m["start"]
    words = F.transform("_at_candidate", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["value"].alias("value"), touched(m).alias("taken")))
    base = F.array_sort(F.concat(*[_spans(k) for k in KINDS])).cast(SPAN)
    joints = F.transform("_gaps", lambda g: F.when(g.rlike(r"\A\x20++\z"), g))
    found = found.select("doc_id", "_text", "_body", joints.alias("_gaps"), "_edges", words.alias("_words"), base.alias("_base"), *good)
    return found.select("doc_id", "_text", "_base", "_words", "_gaps", "_edges", F.concat(*map(_seeds, KINDS)).alias("_seeds"))


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows with up to BLOCK words each, and the words around these that their runs and contexts need: (doc_id, _text, _first, _own, _words, _gaps, _edges), the block's own words from _first on."""
    n = F.size("_words")
    part = lambda c, low, high: F.transform(F.sequence(low, high - 1), lambda i: F.get(c, i))

    def block(number: Column) -> Column:
        first = number * BLOCK
        low, high = F.greatest(first - 3, F.lit(0)), F.least(n, first + BLOCK + most + 3)
        return F.struct((first - low).alias("_first"), F.least(n - first, F.lit(BLOCK)).alias("_own"), part("_words", low, high).alias("_words"), part("_gaps", low, high + 1).alias("_gaps"), part("_edges", low, high + 1).alias("_edges"))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), block)
    return rows.where(n > 0).select("doc_id", "_text", F.explode(blocks).alias("b")).select("doc_id", "_text", "b.*")


def _runs(rows: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc_id, _text, start, end, value, patterns): words with digits and runs of as many of them as `sizes` names, with blanks between, outside the fixed patterns' spans.

    Runs are made block by block, so a task holds those of BLOCK words however long a text is.
    """
    most = max(sizes)
    # the blanks before word i, where they are all that parts it from the word before
    joint = lambda i: F.when((i > 0) & ~F.get("_words", i)["taken"], F.get("_gaps", i))
    more = lambda acc, j: F.when(
        (F.size(acc) > 0) & F.element_at(acc, -1)["open"],
        F.array_append(acc, F.struct(j.alias("j"), F.concat(F.element_at(acc, -1)["whole"], joint(j), F.get("_words", j)["value"]).alias("whole"), joint(j + 1).isNotNull().alias("open"))),
    ).otherwise(acc)
    begun = lambda w, i: F.array(F.struct(i.alias("j"), w["value"].alias("whole"), joint(i + 1).isNotNull().alias("open")))
    sized = lambda w, i: F.filter(F.aggregate(F.sequence(i + 1, i + most - 1), begun(w, i), more) if most > 1 else begun(w, i), lambda r: (r["j"] - i + 1).isin(sizes))
    owned = lambda i: (i >= F.col("_first")) & (i < F.col("_first") + F.col("_own"))
    of = lambda w, i: F.when(
        owned(i) & ~w["taken"], F.transform(sized(w, i), lambda r: F.struct(i.alias("i"), r["j"].alias("j"), w["start"].alias("at"), r["whole"].alias("whole")))
    ).otherwise(F.array())
    one = _blocks(rows, most).withColumn("_runs", F.flatten(F.transform("_words", of)))
    one = one.withColumn("_runs", F.transform("_runs", lambda r: F.struct(r["at"].alias("at"), r["whole"].alias("whole"), _patterns(r["i"], r["j"]).alias("patterns"))))
    one = one.select("doc_id", "_text", F.explode("_runs").alias("r")).select("doc_id", "_text", "r.*")
    # a word's edges often hold punctuation that isn't part of the identifier
    lead = F.length(F.regexp_extract("whole", r"^[\"'(\[{<,;:=]*", 0))
    value = F.regexp_replace("whole", r"^[\"'(\[{<,;:=]+|[\"')\]}>,;:.!?]+$", "")
    one = one.select("doc_id", "_text", (F.col("at") + lead).alias("start"), value.alias("value"), "patterns")
    return one.where(F.length("value") > 0).withColumn("end", F.col("start") + F.length("value"))


def _outer(found: DataFrame) -> DataFrame:
    """Without spans inside a longer one of the same text."""
    same = found.groupBy("doc_id", "_text", "start", "end").agg(F.collect_set("kind").alias("kinds"))
    before = Window.partitionBy("doc_id", "_text").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    same = same.withColumn("reach", F.max("end").over(before)).where("reach IS NULL OR reach < end")
    return same.select("doc_id", "_text", "start", "end", F.explode("kinds").alias("kind"))


def _discovered(rows: DataFrame) -> DataFrame:
    """(doc_id, _text, spans): spans that contexts give and the fixed patterns don't."""
    of = F.transform("_seeds", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value"), _patterns(s["i"], s["j"]).alias("patterns")))
    seeds = rows.where(F.size("_seeds") > 0).select(F.explode(of).alias("s")).select("s.*", _shape(F.col("s.value")).alias("shape"))
    seeds = materialise(seeds, "pii-seeds")
    # a value can only be of a kind whose seeds have its shape, so runs have as many words as some of these
    words = F.size(F.regexp_extract_all("shape", F.lit(CANDIDATE), F.lit(0)))
    sizes = sorted(r[0] for r in seeds.select(words.alias("n")).where("n > 0").distinct().collect())  # a fixed pattern matches at most 19 digits
    shapes = seeds.select("kind", "shape").distinct()
    typed = _runs(rows, sizes or [1]).withColumn("shape", _shape(F.col("value"))).join(shapes, "shape")
    typed = materialise(typed.select("doc_id", "_text", "start", "end", "kind", "value", "patterns"), "pii-mentions")
    edges = seeds.select("kind", "value", "patterns", F.lit(1.0).alias("known")).unionByName(typed.select("kind", "value", "patterns", F.lit(0.0).alias("known")))
    edges = edges.select("kind", "value", "known", F.explode("patterns").alias("pattern"))
    edges = edges.groupBy("kind", "pattern", "value").agg(F.max("known").alias("known"))
    # a pattern that meets fewer distinct values can never speak
    wide = edges.groupBy("kind", "pattern").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_VALUES)
    edges = materialise(edges.join(wide.drop("n"), ["kind", "pattern"]), "pii-edges")
    seeds = edges.groupBy("kind", "value").agg(F.max("known").alias("score"))
    scores = materialise(seeds, "pii-scores")
    for _ in range(ROUNDS):
        scored = edges.join(scores, ["kind", "value"])
        worth = scored.groupBy("kind", "pattern").agg(F.sum("score").alias("mass"), F.count("*").alias("n"))
        worth = worth.where(F.col("mass") >= LEAST_VALUES).withColumn("worth", F.col("mass") / F.col("n")).where(F.col("worth") >= LEAST_WORTH)
        best = edges.join(worth.select("kind", "pattern", "worth"), ["kind", "pattern"]).groupBy("kind", "value").agg(F.max("worth").alias("best"))
        scores = scores.join(best, ["kind", "value"], "left").select("kind", "value", F.greatest("score", F.coalesce("best", F.lit(0.0))).alias("score"))
        scores = materialise(scores, "pii-scores")
    # the last worths place the spans: a mention counts where one of its own patterns speaks
    speaking = materialise(worth.select("kind", "pattern"), "pii-patterns")
    fresh = typed.select("doc_id", "_text", "start", "end", "kind", F.explode("patterns").alias("pattern"))
    fresh = _outer(fresh.join(speaking, ["kind", "pattern"]).select("doc_id", "_text", "start", "end", "kind"))
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)])
    span = F.struct("start", rank.alias("rank"), "kind", "end")
    return fresh.groupBy("doc_id", "_text").agg(F.collect_list(span).cast(SPAN).alias("_more"))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans), a row for every row of `docs`.

    Offsets count code points, ends are exclusive. Counts and base_sha256 cover the fixed patterns; spans has these and what
    the contexts add (n_added; n_spans: of both). Work grows in proportion to the text and its matches. Null text counts as empty: no spans. Rows alike in id and text get the same
    result; the same id with other text, or a null id, is searched for itself. Other columns of `docs` are not read.
    """
    rows = materialise(_matches(docs, text), "pii-rows")
    more = _discovered(rows).withColumnsRenamed({"doc_id": "_id", "_text": "_of"})
    joined = rows.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_of")), "left")
    every = F.array_sort(F.concat("_base", F.coalesce("_more", F.array().cast(SPAN))))
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return joined.select(
        "doc_id", *[count(k) for k in KINDS], F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(every).alias("spans"),
        F.size(F.coalesce("_more", F.array().cast(SPAN))).cast("long").alias("n_added"), F.size(every).cast("long").alias("n_spans"),
    )
