"""Stored pins, the incremental index and joins in time."""

import bisect
import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_signals import case
from tracelink.operators import incremental, index, infra, layout, pins, timejoin
from tracelink.plans import projections as p
from tracelink.schema import DDL

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def stored(spark):
    t = p.case_tables(spark, SF)
    s = layout.store_pins(t, buckets=5)
    yield t, s
    s.drop()


def test_operators_read_stored_pins(stored):
    t, s = stored
    for f in (infra.asn_clusters, infra.shared_tracking_ids, infra.ad_tracking_platforms, infra.shared_endpoints, lambda x: infra.certificates(x), pins.latest_snapshot, pins.pending_snapshots):
        assert rows(f(t)) == rows(f(s))
    for pin, how in (("url_any", "left"), ("own_done", "inner"), ("url_done", "left")):
        assert rows(pins.pinned(t, pin, "final_url", "status", how=how)) == rows(pins.pinned(s, pin, "final_url", "status", how=how))


def test_artifacts_without_scan_or_post(spark):
    t = case(spark, [{"url_artifact_id": 1, "final_url": "https://a.test/"}], [{"id": 1, "scan_run_id": 10}, {"id": 2, "scan_run_id": None}], urls=[{"id": i, "message_id": i, "case_id": 1, "original_url": f"u{i}"} for i in (1, 2, 3)], posts=[{"id": i, "case_id": 1} for i in (1, 2)])
    s = layout.store_pins(t)
    for posts in (True, False):
        for how in ("inner", "left"):
            assert rows(pins.pinned(t, "url_done", "final_url", how=how, posts=posts)) == rows(pins.pinned(s, "url_done", "final_url", how=how, posts=posts))
    assert s.snapshots.count() == 1
    s.drop()


def test_joins_of_stored_pins_do_not_shuffle(spark, stored):
    _, s = stored
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = infra.tracking_rows(s)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        for found in (infra.shared_tracking_ids(s), infra.asn_clusters(s)):
            text = found._jdf.queryExecution().executedPlan().toString()
            # every exchange stands above a partial aggregate, is the last sort, or joins what is aggregated
            scans = [line for line in text.splitlines() if "Scan parquet" in line]
            assert scans and all("Bucketed: true" in line for line in scans)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# the incremental index


def signal_rows(spark, seed, dbs=3, cases=4, n=400):
    rng = random.Random(seed)
    out = {}
    for _ in range(n):
        db, case_id, scan = f"{rng.randrange(dbs)}", rng.randrange(cases), rng.randrange(30)
        value = f"v{min(rng.randrange(40), rng.randrange(40))}"
        out["t", value, db, case_id, scan] = ("t", value, rng.choice([None, "p", "q"]), db, case_id, f"case {case_id}", scan, rng.choice([None, *(f"d{i}" for i in range(6))]), "o", "i")
    return spark.createDataFrame(list(out.values()), DDL["signals"])


def test_rewritten_cases_give_what_all_rows_give(spark, tmp_path):
    store = incremental.SignalStore(spark, f"file://{tmp_path}/index")
    assert store.recurring().count() == 0 and store.signals().count() == 0 and store.snapshots() == []
    first, again = signal_rows(spark, 1), signal_rows(spark, 2)
    store.commit(first)
    state = first
    for turn, (db, case_id) in enumerate([("0", 1), ("2", 3), ("0", 1)], 1):
        fresh = again.where((F.col("source_db") == db) & (F.col("case_id") == case_id) & (F.col("scan_run_id") % (turn + 1) == 0))
        assert store.commit(fresh) == turn + 1
        state = state.where(~((F.col("source_db") == db) & (F.col("case_id") == case_id))).union(fresh)
        assert rows(store.signals()) == rows(state)
        for least in ((2, 1), (3, 2), (1, 1)):
            assert rows(store.recurring(*least)) == rows(index.recurring_signals(state, *least))
    before = rows(store.recurring())
    store.commit(first.limit(0), spark.createDataFrame([("1", 2), ("none", 9)], "source_db string, case_id long"))
    left = state.where("NOT (source_db = '1' AND case_id = 2)")
    assert rows(store.recurring()) == rows(index.recurring_signals(left)) and rows(store.recurring(snapshot=4)) == before
    store.compact()
    assert rows(store.recurring()) == rows(index.recurring_signals(left)) and rows(store.signals()) == rows(left)
    assert store.counters().where("n <= 0").isEmpty()
    store.vacuum()
    assert store.snapshots() == [6] and rows(store.recurring()) == rows(index.recurring_signals(left)) and rows(store.signals()) == rows(left)
    with pytest.raises(LookupError):
        store.manifest(1)


def test_work_follows_the_rewritten_case(spark, tmp_path):
    store = incremental.SignalStore(spark, f"file://{tmp_path}/index")
    first = signal_rows(spark, 3, n=2000)
    store.commit(first)
    one = first.where("source_db = '1' AND case_id = 2")
    store.commit(one.withColumn("final_domain", F.lit("new")))
    last = spark.read.text(f"file://{tmp_path}/index/snapshots/{2:012d}").first()[0]
    added = {r.folder for r in spark.read.parquet(f"file://{tmp_path}/index/manifests/{last}").where("kind = 'counters'").collect()} - {r.folder for r in store.manifest(1).collect()}
    delta = spark.read.parquet(f"file://{tmp_path}/index/counters/{added.pop()}")
    # the case's hits and platforms are as before, its domains aren't
    assert {r.kind for r in delta.select("kind").distinct().collect()} == {"domain"} and delta.count() < one.count() * 3
    live = store.manifest().where("kind = 'case' AND source_db = '1' AND case_id = 2")
    named = (F.col("source_db") == "1") & (F.col("case_id") == 2)
    plan = store._rows(live, named)._jdf.queryExecution().executedPlan().toString()
    filters = [m for m in re.findall(r"PartitionFilters: \[(.*?), PushedFilters", plan) if "source_db" in m]
    assert filters and all(re.search(r"source_db#\d+ = 1\b", m) for m in filters), plan


def test_half_a_commit_is_not_seen_and_two_writers_do_not_mix(spark, tmp_path, monkeypatch):
    store = incremental.SignalStore(spark, f"file://{tmp_path}/index")
    first, other = signal_rows(spark, 4), signal_rows(spark, 5)
    store.commit(first)
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            store.commit(other)
    assert store.snapshots() == [1] and rows(store.signals()) == rows(first)
    with pytest.raises(incremental.Conflict):
        store._publish(1, "x")
    # another writer commits between reading the snapshot and publishing
    rival, real, turns = incremental.SignalStore(spark, store.path), store._finish, []

    def late(number, manifest):
        if not turns:
            turns.append(1)
            rival.commit(other.where("source_db = '0'"))
        return real(number, manifest)

    monkeypatch.setattr(store, "_finish", late)
    assert store.commit(other.where("source_db = '1'")) == 3
    want = first.join(other.where("source_db IN ('0', '1')").select("source_db", "case_id").distinct(), ["source_db", "case_id"], "left_anti").select(*first.columns).union(other.where("source_db IN ('0', '1')"))
    assert rows(store.signals()) == rows(want) and rows(store.recurring()) == rows(index.recurring_signals(want))


# joins in time


def test_latest_before_matches_a_search(spark):
    rng = random.Random(8)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(500)] + [(999, "only left", 5), (1, "a", 7)]
    right = [(key(), rng.choice([None, *range(0, 60, 3)]), rng.randrange(9)) for _ in range(200)]
    held: dict = {}
    for k, at, v in right:
        if k is not None and at is not None:
            held.setdefault(k, {})[at] = max(v, held.get(k, {}).get(at, -1))
    want = []
    for i, k, at in left:
        times = sorted(held.get(k, {})) if at is not None else []
        n = bisect.bisect_right(times, at) if times else 0
        want.append((i, k, at, (times[n - 1], held[k][times[n - 1]]) if n else None))
    a, b = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int")
    for piece in (timejoin.PIECE_ROWS, 10, 0):
        got = [(r.i, r.k, r.t, r.found and (r.found.t, r.found.v)) for r in timejoin.latest_before(a, b, ["k"], "t", "t", piece_rows=piece).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    near = {(r.i, r.found is not None) for r in timejoin.latest_before(a, b, ["k"], "t", "t", within=1, piece_rows=10).collect()}
    assert near == {(i, f is not None and at - f[0] <= 1) for i, _, at, f in want}
    assert timejoin.latest_before(a.limit(0), b, ["k"], "t", "t").count() == 0
    assert timejoin.latest_before(a, b.limit(0), ["k"], "t", "t").where("found IS NOT NULL").isEmpty()


def test_intervals_match_all_pairs(spark):
    rng = random.Random(9)
    base = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    at = lambda x: base + dt.timedelta(seconds=x)
    points = [(i, rng.choice("ab"), at(rng.randrange(10_000))) for i in range(80)] + [(900, "a", None), (901, None, at(5))]
    spans = []
    for j in range(60):
        start = rng.randrange(10_000)
        spans.append((j, rng.choice("ab"), at(start), at(start + rng.choice([-5, 0, 1, 2, 3, 100, 5_000, 10**7]))))
    spans += [(800, "a", None, at(9)), (801, "a", at(1), None), (802, None, at(0), at(10))]
    want = sorted((i, j) for i, k, x in points for j, m, s, e in spans if k == m and k and x and s and e and s <= x < e)
    got = timejoin.within_intervals(spark.createDataFrame(points, "i int, k string, x timestamp"), spark.createDataFrame(spans, "j int, k string, s timestamp, e timestamp"), ["k"], "x", "s", "e")
    assert sorted((r.i, r.j) for r in got.collect()) == want and got.columns == ["k", "i", "x", "j", "s", "e"]
    numbers = spark.createDataFrame([(1, 0, 2**53 + 1), (2, 5, 6)], "j int, s long, e long")
    values = spark.createDataFrame([(0, 2**53), (1, 5), (2, 2**53 + 1)], "i int, x long")
    assert sorted((r.i, r.j) for r in timejoin.within_intervals(values, numbers, [], "x", "s", "e").collect()) == [(0, 1), (1, 1), (1, 2)]
