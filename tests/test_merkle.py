import hashlib

from pyspark.sql import functions as F

from tracelink.operators import merkle

SHA = lambda x: hashlib.sha256(x.encode()).hexdigest()
ROWS = [(c, f"f{i}", SHA(f"{c}/{i}")) for c, n in ((1, 300), (2, 1), (3, 17)) for i in range(n)] + [(1, "twice", SHA("a")), (1, "twice", SHA("b"))]


def root(rows, levels):
    at = {}
    for name, sha in rows:
        at.setdefault(SHA(name)[:levels], []).append(SHA(f"leaf:{sha}  {name}"))
    nodes = {p: SHA("node:" + "".join(sorted(x))) for p, x in at.items()}
    for level in range(levels - 1, -1, -1):
        above = {}
        for p in sorted(nodes):
            above.setdefault(p[:level], []).append(nodes[p])
        nodes = {p: SHA("node:" + "".join(x)) for p, x in above.items()}
    return nodes[""]


def frame(spark, rows):
    return spark.createDataFrame(rows, "case_id long, arcname string, sha256 string").repartition(5)


def test_roots_match_and_do_not_depend_on_order(spark):
    for levels in (0, 1, 3):
        got = {r.case_id: r.root for r in merkle.roots(merkle.tree(frame(spark, ROWS[::-1]), levels)).collect()}
        assert got == {c: root([(n, s) for d, n, s in ROWS if d == c], levels) for c in (1, 2, 3)}
    assert [merkle.levels_for(n) for n in (0, 16, 17, 256, 257, 70_000)] == [0, 0, 1, 1, 2, 4]
    assert merkle.tree(frame(spark, ROWS).limit(0), 2).isEmpty()


def test_proofs(spark):
    members, levels = frame(spark, ROWS), 2
    nodes = merkle.tree(members, levels)
    tops = merkle.roots(nodes)
    shown = merkle.proofs(nodes, members, levels)
    assert shown.count() == len(ROWS) and merkle.verified(shown, tops).where("NOT ok").isEmpty()
    assert shown.where("size(path) <> 3").isEmpty() and shown.select(F.max(F.size(F.element_at("path", -1)))).first()[0] <= 16
    # another content, another name, another case's root and a shortened path don't verify
    forged = frame(spark, [(1, "f7", SHA("forged")), (1, "unknown", SHA("1/7"))])
    assert merkle.verified(merkle.proofs(nodes, forged, levels), tops).where("ok").isEmpty()
    assert merkle.verified(shown.where("case_id = 1"), tops.where("case_id = 3").withColumn("case_id", F.lit(1).cast("long"))).where("ok").isEmpty()
    assert merkle.verified(shown.withColumn("path", F.slice("path", 1, 2)), tops).where("ok AND case_id = 1").isEmpty()
    assert merkle.verified(shown.withColumn("path", F.array().cast("array<array<string>>")), tops).where("ok").isEmpty()
    assert merkle.verified(shown, tops.limit(0)).where("ok").isEmpty()


def test_many_members_are_verified_as_by_their_proofs(spark):
    forged = frame(spark, [(1, "f7", SHA("forged")), (1, "unknown", SHA("1/7")), (4, "f0", SHA("4/0"))])
    members = frame(spark, ROWS).union(forged)
    for levels in (0, 1, 2):
        nodes = merkle.tree(frame(spark, ROWS), levels)
        tops = merkle.roots(nodes)
        # a bucket without its first leaf, and another root for a case
        cut = nodes.withColumn("children", F.when((F.col("case_id") == 1) & F.col("prefix").startswith("a") & (F.col("level") == levels), F.slice("children", 2, 999)).otherwise(F.col("children")))
        other = tops.withColumn("root", F.when(F.col("case_id") == 3, F.lit("x")).otherwise(F.col("root")))
        for n, t in ((nodes, tops), (cut, tops), (nodes, other), (nodes, tops.limit(0))):
            got = sorted(tuple(r) for r in merkle.verified_members(n, members, t, levels).collect())
            shown = sorted(tuple(r) for r in merkle.verified(merkle.proofs(n, members, levels), t).where("ok").collect())
            assert len(got) == len(ROWS) + 3 and [r for r in got if r[2]] == shown
    assert [tuple(r) for r in merkle.verified_members(nodes, forged, tops, 2).where("ok").collect()] == []


def test_any_change_changes_the_root(spark):
    base = root([(n, s) for c, n, s in ROWS if c == 1], 2)
    for changed in (ROWS[1:], [(1, "f0", SHA("x")), *ROWS[1:]], [(1, "g0", ROWS[0][2]), *ROWS[1:]], [*ROWS, ROWS[0]]):
        assert merkle.roots(merkle.tree(frame(spark, changed), 2)).where("case_id = 1").first().root != base
