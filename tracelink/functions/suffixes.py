"""Registrable domains by public-suffix rules that are read as a table.

A rule is a suffix (`co.uk`), a wildcard (`*.ck`: any one label before the rest is part of the suffix) or an exception (`!www.ck`: the name itself is registrable).
An exception goes before all others, then the rule with most labels. Rules of the private section name suffixes of hosting providers, so that
two tenants of one provider are two owners.

The rules are a small table and the rows may be many: each suffix length is one map-side join of the rows' last labels with the same
broadcast table, so rows are neither exploded nor shuffled for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelink.functions.urls import ascii_host, is_direct_ip
from tracelink.storage import materialise

#: So many suffixes at most go to all tasks (some 40 bytes each); beyond it the join shuffles.
BROADCAST_SUFFIXES = 500_000


def parsed_rules(rules: DataFrame) -> DataFrame:
    """(suffix, plain, wildcard, exception): what the rules (rule) say of a name, one row per name. Blank rules and comments are left out."""
    text = F.regexp_extract(F.coalesce(F.col("rule"), F.lit("")), r"^\s*(\S*)", 1)
    body = ascii_host(F.lower(F.regexp_replace(text, r"^(?:!|\*\.|\.)|\.$", "")))
    kind = F.when(text.startswith("!"), "exception").when(text.startswith("*."), "wildcard").otherwise("plain")
    rows = rules.where((text != "") & ~text.startswith("//")).select(body.alias("suffix"), kind.alias("kind"))
    return rows.groupBy("suffix").agg(*[F.max(F.col("kind") == k).alias(k) for k in ("plain", "wildcard", "exception")])


class SuffixRules:
    """Rules (rule, private) as they are matched: written once, with their number and the most labels that one has.

    private=False leaves the private section out. unlisted=True takes a top-level name that no rule lists for a suffix; else hosts under it stay whole.
    Of repeated rules one counts; a name may be plain, wildcard and exception at once.
    """

    def __init__(self, rules: DataFrame, private: bool = True, unlisted: bool = False):
        rules = rules if private else rules.where(~F.coalesce(F.col("private"), F.lit(False)))
        self.unlisted = unlisted
        self.table = materialise(parsed_rules(rules), "suffix-rules")
        size = self.table.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(F.split("suffix", r"\."))), F.lit(0)).alias("depth")).first()
        self.depth, self.small = size.depth, size.n <= BROADCAST_SUFFIXES

    def with_apexes(self, df: DataFrame, **columns: str) -> DataFrame:
        """`df` with a new column per keyword: the registrable domain of the host column it names.

        Hosts come as `hostname` makes them; case, blanks around and a last dot don't count. Addresses, names that are suffixes themselves, and null stay as they are.
        """
        columns_before = [c for c in df.columns if c not in columns]
        hosts = {name: F.lower(F.rtrim(F.trim(F.col(host)), F.lit("."))) for name, host in columns.items()}
        df = df.select("*", *[F.struct(h.alias("host"), F.split(h, r"\.").alias("labels")).alias(f"_h_{i}") for i, h in enumerate(hosts.values())])
        for i in range(len(hosts)):
            for k in range(1, self.depth + 1):
                labels = F.col(f"_h_{i}.labels")
                last = F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), "."))
                table = self.table.select(F.col("suffix").alias(f"_s_{i}_{k}"), *[F.col(c).alias(f"_{c}_{i}_{k}") for c in ("plain", "wildcard", "exception")])
                df = df.join(F.broadcast(table) if self.small else table, last == F.col(f"_s_{i}_{k}"), "left")
        return df.select(*columns_before, *[self._apex(i).alias(name) for i, name in enumerate(hosts)])

    def _apex(self, i: int) -> Column:
        host, labels = F.col(f"_h_{i}.host"), F.col(f"_h_{i}.labels")
        n = F.size(labels)
        none = F.lit(None).cast("int")
        best = lambda found: reduce(lambda a, b: F.greatest(a, b), found, none) if len(found) > 1 else (found[0] if found else none)
        exception = best([F.when(F.col(f"_exception_{i}_{k}"), k - 1) for k in range(1, self.depth + 1)])
        listed = best([x for k in range(1, self.depth + 1) for x in (F.when(F.col(f"_plain_{i}_{k}"), k), F.when(F.col(f"_wildcard_{i}_{k}") & (n > k), k + 1))])
        suffix = F.coalesce(exception, listed, F.lit(1) if self.unlisted else none)
        whole = is_direct_ip(host) | suffix.isNull() | (n <= suffix)
        return F.when(host.isNull(), F.lit(None)).when(whole, host).otherwise(F.array_join(F.slice(labels, -(suffix + 1), suffix + 1), "."))


def apexes(df: DataFrame, rules: SuffixRules | None, **columns: str) -> DataFrame:
    """`df` with registrable domains, by `rules` or, without any, by the fixed list of two-label suffixes."""
    from tracelink.functions.urls import registrable_domain

    return rules.with_apexes(df, **columns) if rules is not None else df.withColumns({name: registrable_domain(host) for name, host in columns.items()})
