import pytest

from tracelink.functions import suffixes as s
from tracelink.operators import ads, discovery
from tracelink.sources import readers

LIST = """// ===BEGIN ICANN DOMAINS===
com
uk
co.uk   // the registry's own
*.ck
!www.ck
jp
*.kobe.jp
!city.kobe.jp
食狮.com.cn
de
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
github.io
blogspot.com
*.compute.example.com
// ===END PRIVATE DOMAINS===
late.example
"""


@pytest.fixture(scope="module")
def listed(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("psl") / "list.dat"
    path.write_text(LIST)
    return readers.suffix_list(spark, str(path))


def found(spark, rules, hosts):
    rows = spark.createDataFrame(list(enumerate(hosts)), "i int, host string")
    return [r.apex for r in sorted(rules.with_apexes(rows, apex="host").collect())]


def test_list_file(listed):
    rows = {(r.rule, r.private) for r in listed.collect()}
    assert ("co.uk", False) in rows and ("*.compute.example.com", True) in rows and ("late.example", False) in rows and ("!www.ck", False) in rows and len(rows) == 14


#: host, apex by all rules, apex without the private section
CASES = [
    ("www.google.com", "google.com", None), ("google.com", "google.com", None), ("com", "com", None), ("", "", None), (None, None, None), ("localhost", "localhost", None),
    ("a.b.co.uk", "b.co.uk", None), ("co.uk", "co.uk", None), ("b.uk", "b.uk", None), ("a.b.uk", "b.uk", None), ("x.y.ck", "x.y.ck", None), ("w.x.y.ck", "x.y.ck", None), ("y.ck", "y.ck", None),
    ("www.ck", "www.ck", None), ("a.www.ck", "www.ck", None), ("ck", "ck", None), ("a.b.c.kobe.jp", "b.c.kobe.jp", None), ("c.kobe.jp", "c.kobe.jp", None), ("kobe.jp", "kobe.jp", None), ("a.city.kobe.jp", "city.kobe.jp", None),
    ("alice.github.io", "alice.github.io", "alice.github.io"), ("www.alice.github.io", "alice.github.io", "www.alice.github.io"), ("a.blogspot.com", "a.blogspot.com", "blogspot.com"),
    ("v.eu.compute.example.com", "v.eu.compute.example.com", "example.com"), ("a.v.eu.compute.example.com", "v.eu.compute.example.com", "example.com"), ("compute.example.com", "example.com", "example.com"),
    ("10.0.0.1", "10.0.0.1", None), ("2001:db8::1", "2001:db8::1", None), ("WWW.Google.COM.", "google.com", None), ("a.b.unlisted", "a.b.unlisted", None), ("a.b.xn--85x722f.com.cn", "b.xn--85x722f.com.cn", None),
]


def test_precedence(spark, listed):
    hosts = [c[0] for c in CASES]
    assert found(spark, s.SuffixRules(listed), hosts) == [c[1] for c in CASES]
    assert found(spark, s.SuffixRules(listed, private=False), hosts) == [c[2] if c[2] is not None else c[1] for c in CASES]
    assert found(spark, s.SuffixRules(listed, unlisted=True), ["a.b.unlisted", "b.unlisted", "unlisted"]) == ["b.unlisted", "b.unlisted", "unlisted"]


def brute(rules, host):
    labels = host.split(".")
    hits = []
    for rule in rules:
        own = rule.lstrip("!").split(".")
        if len(own) <= len(labels) and all(a in ("*", b) for a, b in zip(own, labels[-len(own) :], strict=True)):
            hits.append((rule.startswith("!"), len(own)))
    if not hits:
        return host
    exception, n = max(hits)
    n -= exception
    return host if len(labels) <= n else ".".join(labels[-n - 1 :])


def test_against_brute_force_and_a_shuffled_join(spark, monkeypatch):
    import itertools
    import random

    names = [".".join(x) for n in (1, 2, 3, 4, 5) for x in itertools.product("ab", repeat=n)]
    rnd = random.Random(5)
    for turn in range(3):
        rules = [rnd.choice(["", "", "*.", "!"]) + rnd.choice(names[:30]) for _ in range(8)]
        monkeypatch.setattr(s, "BROADCAST_SUFFIXES", 0 if turn == 2 else 10**6)
        made = s.SuffixRules(spark.createDataFrame([(r, False) for r in rules], "rule string, private boolean"))
        assert made.small == (turn != 2)
        assert found(spark, made, names) == [brute(rules, n) for n in names]


def test_no_rules_and_several_columns(spark):
    none = s.SuffixRules(spark.createDataFrame([], "rule string, private boolean"))
    assert found(spark, none, ["a.b.c", None]) == ["a.b.c", None]
    rules = s.SuffixRules(spark.createDataFrame([("io", False), ("github.io", True), (None, None), ("", False), ("// x", False)], "rule string, private boolean"))
    rows = spark.createDataFrame([("a.b.github.io", "x.y.io", 1)], "h string, g string, apex int")
    assert tuple(rules.with_apexes(rows, apex="h", other="g").first()) == ("a.b.github.io", "x.y.io", "b.github.io", "y.io")


def test_facts_are_not_shuffled(spark, listed):
    rows = spark.createDataFrame([("a.b.co.uk",)], "host string").repartition(3)
    plan = s.SuffixRules(listed).with_apexes(rows, apex="host")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 3


def test_tenants_are_owners_of_their_own(spark):
    rules = s.SuffixRules(spark.createDataFrame([("io", False), ("github.io", True)], "rule string, private boolean"))
    files = spark.createDataFrame([(d, "ok", [("ads", "1", "DIRECT", None)]) for d in ("alice.github.io", "bob.github.io")], "domain string, status string, records array<struct<adsystem:string,seller_id:string,relationship:string,cert_authority_id:string>>")
    count = lambda r: ads.account_footprint(ads.direct_accounts(s.apexes(files, r, apex="domain"))).first().global_apex_count
    assert (count(None), count(rules)) == (1, 2)
    left = discovery.without_scanned(files.select("domain"), spark.createDataFrame([("alice.github.io",)], "apex string"), rules)
    assert [r.domain for r in left.collect()] == ["bob.github.io"]
