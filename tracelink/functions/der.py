"""Time-stamp replies in DER, read by the lengths that their headers state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of RFC 3161 and RFC 2510.
STATUSES = {0: "granted", 1: "grantedWithMods", 2: "rejection", 3: "waiting", 4: "revocationWarning", 5: "revocationNotification"}
FAILURES = {0: "badAlg", 2: "badRequest", 5: "badDataFormat", 14: "timeNotAvailable", 15: "unacceptedPolicy", 16: "unacceptedExtension", 17: "addInfoNotAvailable", 25: "systemFailure"}
#: Failures that name the request as the problem: sending it again changes nothing.
PERMANENT = ["badAlg", "badRequest", "badDataFormat", "unacceptedPolicy", "unacceptedExtension"]

SEQUENCE, INTEGER, BITS = 0x30, 0x02, 0x03
REPLY = "struct<status:bigint,status_text:string,status_string:string,fail_info:string,has_token:boolean>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _part(data: Column, at: Column, n: Column) -> Column:
    return F.substring(data, at + 1, n)


def _number(data: Column, at: Column, n: Column) -> Column:
    """An unsigned big-endian number; of more than seven bytes the first seven."""
    return F.coalesce(F.conv(F.hex(_part(data, at, F.least(n, F.lit(7)))), 16, 10).cast("bigint"), F.lit(0).cast("bigint"))


def element(data: Column, at: Column, end: Column) -> Column:
    """struct<ok, tag, start, length, next> of the element at byte `at`; not ok where its header or value goes beyond `end`, or has a length of another form than one byte or one to four more."""
    zero, one = F.lit(0), F.lit(1)
    first = _number(data, at + 1, one)
    more = F.when(first >= 128, first - 128).otherwise(zero)
    length = F.when(first >= 128, _number(data, at + 2, more.cast("int"))).otherwise(first)

    def made(x: Column) -> Column:
        ok = (at + 2 <= end) & ((x["first"] < 128) | x["more"].between(1, 4)) & (x["start"] + x["length"] <= end)
        return F.struct(ok.alias("ok"), x["tag"].alias("tag"), x["start"].alias("start"), F.when(ok, x["length"].cast("int")).otherwise(0).alias("length"), F.when(ok, (x["start"] + x["length"]).cast("int")).otherwise(0).alias("next"))

    return _let(F.struct(_number(data, at, one).alias("tag"), first.alias("first"), more.alias("more"), (at + 2 + more).cast("int").alias("start"), length.alias("length")), made)


def _walk(data: Column, start: Column, end: Column, zero: Column, take: Callable[[Column, Column], Column]) -> Column:
    """struct<ok, at, held>: `take` folds the elements from `start` to `end` into `held`; not ok where one of them isn't."""
    # every element takes two bytes at least
    turns = F.when(end > start, F.sequence(F.lit(1), F.floor((end - start) / 2) + 1)).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, _: Column) -> Column:
        return F.when(~acc["ok"] | (acc["at"] >= end), acc).otherwise(_let(element(data, acc["at"], end), lambda e: F.struct(e["ok"].alias("ok"), F.when(e["ok"], e["next"]).otherwise(acc["at"]).alias("at"), F.when(e["ok"], take(acc["held"], e)).otherwise(acc["held"]).alias("held"))))

    return F.aggregate(turns, F.struct(F.lit(True).alias("ok"), start.cast("int").alias("at"), zero.alias("held")), step)


def failure_names(bits: Column) -> Column:
    """Names of the set bits of a BIT STRING's value, comma-separated; the first byte says how many bits of the last don't count."""
    unused = _number(bits, F.lit(0), F.lit(1))
    n = (F.octet_length(bits) - 1) * 8 - F.when(unused < 8, unused).otherwise(0)
    known = F.create_map(*[F.lit(x) for pair in FAILURES.items() for x in pair])
    is_set = lambda i: _number(bits, (F.floor(i / 8) + 1).cast("int"), F.lit(1)) % F.pow(F.lit(2), 8 - i % 8).cast("int") >= F.pow(F.lit(2), 7 - i % 8).cast("int")
    name = lambda i: F.coalesce(F.try_element_at(known, i.cast("int")), F.concat(F.lit("bit"), i.cast("string")))
    return F.when((F.octet_length(bits) >= 2) & (n > 0), F.array_join(F.transform(F.filter(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), is_set), name), ",")).otherwise("")


def timestamp_reply(content: Column) -> Column:
    """REPLY of SEQUENCE { SEQUENCE { INTEGER status, SEQUENCE OF texts, BIT STRING failures }, token }; null for bytes that are none. `content` should be a plain column."""
    held = F.struct(F.lit("").alias("texts"), F.lit("").alias("failures"))
    text = lambda e: F.make_valid_utf8(_part(content, e["start"], e["length"]).cast("string"))

    def take(acc: Column, e: Column) -> Column:
        end = e["start"] + e["length"]
        texts = _walk(content, e["start"], end, F.array().cast("array<string>"), lambda a, x: F.concat(a, F.array(text(x))))
        joined = _let(texts, lambda w: F.when(w["ok"], F.array_join(w["held"], " ")))
        # texts that break off make the reply none
        return F.struct(F.when(e["tag"] == SEQUENCE, joined).otherwise(acc["texts"]).alias("texts"), F.when(e["tag"] == BITS, failure_names(_part(content, e["start"], e["length"]))).otherwise(acc["failures"]).alias("failures"))

    def status_of(outer: Column, info: Column) -> Column:
        end = info["start"] + info["length"]
        first = element(content, info["start"], end)

        def reply(s: Column) -> Column:
            unsigned, n = _number(content, s["start"], s["length"]), s["length"]
            status = F.when(unsigned >= F.pow(F.lit(2), 8 * n - 1).cast("bigint"), unsigned - F.pow(F.lit(2), 8 * n).cast("bigint")).otherwise(unsigned)
            known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in STATUSES.items() for x in (float(k), v)]), status.cast("double")), F.concat(F.lit("unknown("), status.cast("string"), F.lit(")")))
            rest = _walk(content, s["next"], end, held, take)
            good = s["ok"] & (s["tag"] == INTEGER) & n.between(1, 7)
            made = lambda w: F.when(w["ok"] & w["held"]["texts"].isNotNull(), F.struct(status.alias("status"), known.alias("status_text"), w["held"]["texts"].alias("status_string"), w["held"]["failures"].alias("fail_info"), (info["next"] < outer["next"]).alias("has_token")))
            return F.when(good, _let(rest, made))

        return _let(first, reply)

    size = F.octet_length(content)
    inner = lambda o: F.when(o["ok"] & (o["tag"] == SEQUENCE), _let(element(content, o["start"], o["next"]), lambda i: F.when(i["ok"] & (i["tag"] == SEQUENCE), status_of(o, i))))
    return F.when(content.isNotNull(), _let(element(content, F.lit(0), size), inner)).cast(REPLY)


def is_transient(fail_info: Column) -> Column:
    """Whether sending the request again may help."""
    return ~F.arrays_overlap(F.split(fail_info, ","), F.array(*map(F.lit, PERMANENT)))
