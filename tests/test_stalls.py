import datetime as dt
import random

from tracelink.streaming import stalls

BASE = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
SCHEMA = "batch string, at timestamp, ok boolean"


def replay(spark, tmp_path, files, cap, delay):
    """Each list of (batch, second, ok) comes as one file."""
    folder = tmp_path / "in"
    for i, rows in enumerate(files):
        part = tmp_path / f"part{i}"
        spark.createDataFrame([(b, s if s is None else BASE + dt.timedelta(seconds=s), ok) for b, s, ok in rows], SCHEMA).coalesce(1).write.parquet(str(part))
        folder.mkdir(exist_ok=True)
        for f in part.glob("part-*.parquet"):
            f.rename(folder / f"{i:03d}-{f.name}")
    stalls.in_name_order(spark, f"file://{folder}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(f"file://{folder}")
    stalls.write_stalls(stalls.stalls(stream, cap, delay), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    found = stalls.read_stalls(spark, f"file://{tmp_path}/out").selectExpr("batch", "position", "ok", "failed", "unix_seconds(last_at) AS last", "unix_seconds(stalled_at) AS stalled").collect()
    return sorted((r.batch, r.position, r.ok, r.failed, r.last - int(BASE.timestamp()), r.stalled - int(BASE.timestamp())) for r in found)


def brute(rows, cap, until):
    out = []
    for batch in {r[0] for r in rows if r[0] is not None}:
        times = sorted((s, bool(ok)) for b, s, ok in rows if b == batch and s is not None)
        for i, (at, _) in enumerate(times):
            after = times[i + 1][0] if i + 1 < len(times) else None
            if (after is None or after - at > cap) and at + cap < until:
                good = sum(ok for _, ok in times[: i + 1])
                out.append((batch, i + 1, good, i + 1 - good, at, at + cap))
    return sorted(out)


def test_silences_match_a_walk_through_all_reports(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for b in "abcd":
        at = rng.randrange(50)
        for _ in range(40):
            at += rng.choice([0, 1, 5, 20, 61, 100, 300])
            rows.append((b, at, rng.choice([True, True, False, None])))
    end = max(r[1] for r in rows)
    rows += [("e", 10, True), (None, 20, True), ("f", None, True), ("g", end, True)]
    # reports arrive up to half a minute late, in five files
    order = sorted(rows, key=lambda r: ((r[1] or 0) + rng.randrange(30), str(r)))
    files = [order[i * len(order) // 5 : (i + 1) * len(order) // 5] for i in range(5)]
    got = replay(spark, tmp_path, files, 60, "40 seconds")
    assert got == brute(rows, 60, end - 40) and ("e", 1, 1, 0, 10, 70) in got and len(got) > 20


def test_a_silence_is_told_once_and_ends_with_the_next_report(spark, tmp_path):
    files = [[("a", 0, True), ("a", 5, False)], [("x", 200, True)], [("x", 400, True)], [("a", 500, True), ("x", 500, True)], [("x", 900, True)]]
    assert [r for r in replay(spark, tmp_path, files, 100, "1 second") if r[0] == "a"] == [("a", 2, 1, 1, 5, 105), ("a", 3, 2, 1, 500, 600)]


def test_a_report_at_the_cap_goes_on_and_one_behind_the_watermark_is_left_out(spark, tmp_path):
    # b reports again just at its cap; a's report at 950 comes when the watermark is at 999, though a silence since then could not be told yet
    files = [[("a", 0, True), ("b", 0, True), ("b", 100, False), ("b", 201, True)], [("x", 1000, True)], [("x", 1001, True)], [("a", 950, True), ("x", 1002, True)], [("x", 2000, True)]]
    found = replay(spark, tmp_path, files, 100, "1 second")
    assert [r for r in found if r[0] != "x"] == [("a", 1, 1, 0, 0, 100), ("b", 2, 1, 1, 100, 200), ("b", 3, 2, 1, 201, 301)]


def test_keyed_state_is_called_for_silences_only(spark, tmp_path):
    rows = [(f"b{b}", s, True) for s in range(0, 300, 10) for b in range(20)] + [("quiet", 5, True), ("quiet", 150, True)]
    for i in range(3):
        part = [r for r in rows if i * 100 <= r[1] < i * 100 + 100]
        spark.createDataFrame([(b, BASE + dt.timedelta(seconds=s), ok) for b, s, ok in part], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("maxFileAge", "36500d").parquet(f"file://{tmp_path}/in")
    query = stalls.write_stalls(stalls.stalls(stream, 60, "1 second"), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    query.awaitTermination()
    keyed = [op["numRowsUpdated"] for progress in query.recentProgress for op in progress["stateOperators"] if op["operatorName"].startswith("transformWithState")]
    assert sum(keyed) == stalls.read_stalls(spark, f"file://{tmp_path}/out").count() == 2


def test_cap():
    assert stalls.stall_cap(30, 30) == int((2 * (30 + 6 + 8 + 40) + 60) * 1.5) + 60 and stalls.stall_cap(30, 30, True) == int((30 + 25 + 8 + 40 + 7) * 1.5) + 60
