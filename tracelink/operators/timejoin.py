"""Joins in time: the last row at or before a moment, and the intervals that hold it.

Spark has neither. The first is a union of both sides in order of time within a key, with the last right row carried along; keys with many rows are cut at
quantiles of their times, so that a cut is walked through by itself and what it inherits comes from a much smaller table of cuts. The second is an equi-join on
buckets as long as the interval, one length per power of two, so that no interval touches more than two buckets however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelink.storage import materialise

#: Rows of a key that are walked through in one go, about; a larger key is cut into PIECES.
PIECE_ROWS = 500_000
PIECES = 256
#: So many cut keys at most go to all tasks (2 KB each); more are joined.
BROADCAST_KEYS = 20_000


def _clock(df: DataFrame, time: str) -> Column:
    """Times as whole numbers: microseconds of a timestamp, days of a date, others as they are."""
    kind = df.schema[time].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(time).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(time).cast("long")
    return F.col(time).cast("long")


def latest_before(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, into: str = "found", within: int | None = None, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Every row of `left` with a column `into`: the row of `right` with the same `on` columns and the largest time at or before its own, as a struct; null for none.

    within: the most that may lie between the two times (microseconds, days or units). Of right rows with one time the largest, column by column, stands. Rows with a null key
    or time find nothing and are found by nothing. Repeated left rows come as often; times of both sides have to be of one kind. `piece_rows` changes the work of a task, not the result.
    """
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(on)]
    names = [f"_k{i}" for i in range(len(on))]
    row = F.struct(*[F.col(c) for c in left.columns])
    found = F.struct(*[F.col(c) for c in right.columns])
    usable = lambda df, time: df.where(known & F.col(time).isNotNull())
    asks = usable(left, left_time).select(*keys, _clock(left, left_time).alias("_t"), F.lit(1).alias("_side"), row.alias("_row"), F.lit(None).cast(right.schema).alias("_found"))
    has = usable(right, right_time).select(*keys, _clock(right, right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema).alias("_row"), found.alias("_found"))
    # one right row for each moment
    has = has.groupBy(*names, "_t", "_side").agg(F.max("_found").alias("_found")).select(*names, "_t", "_side", F.lit(None).cast(left.schema).alias("_row"), "_found")
    both = asks.unionByName(has)

    counted = both.groupBy(*names).agg(F.count("*").alias("_n"), F.percentile_approx("_t", [i / PIECES for i in range(1, PIECES)]).alias("_cuts")).where(F.col("_n") > piece_rows)
    large = materialise(counted.select(*names, F.array_distinct("_cuts").alias("_cuts")), "large-keys")
    cuts = F.broadcast(large) if large.count() <= BROADCAST_KEYS else large
    both = both.join(cuts, names, "left").withColumn("_piece", F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_t"))), F.lit(0))).drop("_cuts")
    walk = Window.partitionBy(*names, "_piece").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    moment = F.struct("_t", "_found")
    walked = both.withColumn("_last", F.last(F.when(F.col("_side") == 0, moment), ignorenulls=True).over(walk)).where("_side = 1")

    # what a piece inherits: the last right row of the pieces before, of keys with several only
    ends = both.join(cuts.select(*names), names, "left_semi").groupBy(*names, "_piece").agg(F.max_by(F.when(F.col("_side") == 0, moment), F.when(F.col("_side") == 0, F.col("_t"))).alias("_end"))
    before = Window.partitionBy(*names).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    inherited = ends.select(*names, "_piece", F.last("_end", ignorenulls=True).over(before).alias("_carried")).where("_carried IS NOT NULL")
    joined = walked.join(inherited, [*names, "_piece"], "left").withColumn("_last", F.coalesce("_last", "_carried"))
    near = F.lit(True) if within is None else F.col("_t") - F.col("_last._t") <= within
    matched = joined.select("_row.*", F.when(near, F.col("_last._found")).alias(into))
    others = left.where(~F.coalesce(known & F.col(left_time).isNotNull(), F.lit(False))).withColumn(into, F.lit(None).cast(right.schema))
    return matched.unionByName(others)


def within_intervals(points: DataFrame, intervals: DataFrame, on: list[str], time: str, start: str, end: str) -> DataFrame:
    """All pairs of a point and an interval with the same `on` columns whose start <= time < end; columns of both, those of `on` once.

    Intervals that are empty, reversed, or lack a bound or a key hold nothing. The lengths of intervals are told apart by powers of two, at most 63 of them; each point meets each length that occurs.
    """
    low, high = _clock(intervals, start), _clock(intervals, end)
    sized = intervals.withColumns({"_low": low, "_high": high}).where("_low < _high")
    level = F.ceil(F.log2((F.col("_high") - F.col("_low")).cast("double"))).cast("int")
    # beyond 2^53 a logarithm may be one too small
    sized = sized.withColumn("_level", F.least(F.when(F.call_function("shiftleft", F.lit(1).cast("long"), level) < F.col("_high") - F.col("_low"), level + 1).otherwise(level), F.lit(62)))
    levels = [r[0] for r in sized.select("_level").distinct().collect()]  # at most 63 numbers
    bucket = lambda t: F.call_function("shiftright", t, F.col("_level"))
    cut = sized.withColumn("_bucket", F.explode(F.array_distinct(F.array(bucket(F.col("_low")), bucket(F.col("_high") - 1)))))
    each = points.withColumn("_at", _clock(points, time)).where("_at IS NOT NULL").withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    each = each.withColumn("_bucket", bucket(F.col("_at")))
    pairs = each.join(cut, [*on, "_level", "_bucket"]).where((F.col("_low") <= F.col("_at")) & (F.col("_at") < F.col("_high")))
    return pairs.drop("_level", "_bucket", "_at", "_low", "_high")

