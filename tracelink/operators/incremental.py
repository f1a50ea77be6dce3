"""The cross-case index kept up to date case by case.

What `recurring_signals` tells of a value are counts of rows per case, per landing domain and per platform. These counters add up, and a case that is written again
takes back its old ones: a commit writes the counters of the new rows less those of the rows they replace, so its work follows the rewritten cases alone,
and a reader adds up all commits since the last compaction.

Layout below a path: `data/commit=<id>/source_db=<db>/case_id=<id>` holds rows, `counters/<id>` what a commit adds, `manifests/<id>` which folder of rows each case
lives in and which counters count, and `snapshots/<n>` names a manifest. Folders are never changed. A snapshot's file appears by one rename that fails if it is there
already: readers see a case whole or not at all, and of two writers one starts over.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelink.operators.index import COLUMNS, last_write
from tracelink.operators.infra import sorted_set
from tracelink.schema import DDL

KEY = ["signal_type", "signal_value", "kind", "source_db", "case_id", "label"]
COUNTERS = "signal_type STRING, signal_value STRING, kind STRING, source_db STRING, case_id BIGINT, label STRING, n BIGINT"
MANIFEST = "kind STRING, source_db STRING, case_id BIGINT, folder STRING"
#: So many rewritten cases at most are named in the filter that finds their old rows; more are joined.
NAMED_CASES = 500


class Conflict(RuntimeError):
    """Another writer has committed meanwhile."""


def counters(rows: DataFrame, sign: int = 1) -> DataFrame:
    """COUNTERS of signal rows: how many rows each value has per case, domain, and platform of a case."""
    none = lambda kind: F.lit(None).cast(kind)
    one = lambda kind, label, here: F.struct(F.lit(kind).alias("kind"), (F.col("source_db") if here else none("string")).alias("source_db"), (F.col("case_id") if here else none("bigint")).alias("case_id"), F.col(label).alias("label"))
    each = rows.select("signal_type", "signal_value", F.explode(F.array(one("case", "case_title", True), one("domain", "final_domain", False), one("platform", "platform", True))).alias("c"))
    counted = each.where("c.kind = 'case' OR c.label IS NOT NULL").select("signal_type", "signal_value", "c.*").groupBy(*KEY)
    return counted.agg((F.count("*") * sign).alias("n"))


def summed(parts: DataFrame) -> DataFrame:
    """COUNTERS added up; those that are taken back vanish."""
    return parts.groupBy(*KEY).agg(F.sum("n").alias("n")).where("n <> 0")


def recurring(parts: DataFrame, min_cases: int = 2, min_domains: int = 1) -> DataFrame:
    """The rows of `index.recurring_signals`, from COUNTERS."""
    kind = lambda name: F.col("kind") == name
    per = summed(parts).groupBy("signal_type", "signal_value").agg(
        F.count_distinct(F.when(kind("case"), F.struct("source_db", "case_id"))).alias("case_count"), F.count_if(kind("domain")).alias("domain_count"), F.sum(F.when(kind("case"), F.col("n"))).alias("hit_count"),
        F.min_by("label", F.when(kind("platform"), F.struct("source_db", "case_id", "label"))).alias("platform"),
        sorted_set(F.when(kind("case"), F.struct("source_db", "case_id", F.col("label").alias("case_title")))).alias("cases"),
    )
    per = per.where((F.col("case_count") >= min_cases) & (F.col("domain_count") >= min_domains))
    return per.orderBy(F.desc("domain_count"), F.desc("case_count"), F.desc("hit_count"), "signal_type", "signal_value")


class SignalStore:
    """An index of signals in a folder that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # snapshots

    def _hadoop(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        return jvm, conf, target, target.getFileSystem(conf)

    def _names(self, folder: str) -> list[str]:
        _, _, target, files = self._hadoop(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []

    def snapshots(self) -> list[int]:
        """Numbers of the commits so far, ascending."""
        return sorted(int(name) for name in self._names("snapshots") if name.isdigit())

    def _publish(self, number: int, manifest: str) -> None:
        """Names the manifest of a snapshot, or raises Conflict where that snapshot is there."""
        jvm, conf, draft, files = self._hadoop(f"{self.path}/snapshots/.{uuid.uuid4().hex}")
        out = files.create(draft, True)
        out.write(bytearray(manifest.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else files.getUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(f"{self.path}/snapshots/{number:012d}"), options)
        except Exception as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"snapshot {number} of {self.path} is there already") from None
            raise

    def manifest(self, snapshot: int | None = None) -> DataFrame:
        """MANIFEST rows of a snapshot, the newest by default: kind `case` names the folder a case lives in, `counters` the counters that count."""
        numbers = self.snapshots()
        snapshot = numbers[-1] if snapshot is None and numbers else snapshot
        if snapshot is None:
            return self.spark.createDataFrame([], MANIFEST)
        if snapshot not in numbers:
            raise LookupError(f"no snapshot {snapshot} of {self.path}")
        name = self.spark.read.text(f"{self.path}/snapshots/{snapshot:012d}").first()[0]
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifests/{name}")

    # reading

    def _rows(self, cases: DataFrame, named: Column | None = None) -> DataFrame:
        """Rows of live cases (source_db, case_id, folder)."""
        folders = [r.folder for r in cases.select("folder").distinct().collect()]  # at most one per commit
        if not folders:
            return self.spark.createDataFrame([], DDL["signals"])
        paths = [f"{self.path}/data/commit={f}" for f in folders]
        rows = self.spark.read.schema(DDL["signals"] + ", commit STRING").option("basePath", f"{self.path}/data").parquet(*paths)
        rows = rows if named is None else rows.where(named)
        live = cases.select(F.col("folder").alias("commit"), "source_db", "case_id")
        return rows.join(live, ["commit", "source_db", "case_id"], "left_semi").select(*COLUMNS)

    def signals(self, snapshot: int | None = None) -> DataFrame:
        """All rows of a snapshot, the newest by default."""
        return self._rows(self.manifest(snapshot).where("kind = 'case'"))

    def counters(self, snapshot: int | None = None) -> DataFrame:
        """COUNTERS of a snapshot, not yet added up."""
        folders = [r.folder for r in self.manifest(snapshot).where("kind = 'counters'").collect()]
        return self.spark.read.schema(COUNTERS).parquet(*[f"{self.path}/counters/{f}" for f in folders]) if folders else self.spark.createDataFrame([], COUNTERS)

    def recurring(self, min_cases: int = 2, min_domains: int = 1, snapshot: int | None = None) -> DataFrame:
        """What `index.recurring_signals` gives for all rows, from the counters alone."""
        return recurring(self.counters(snapshot), min_cases, min_domains)

    # writing

    def commit(self, signals: DataFrame, cases: DataFrame | None = None, attempts: int = 5) -> int:
        """Replaces the cases that `signals` holds, and those of `cases` (source_db, case_id), which go if they have no signals; returns the snapshot's number.

        Of rows with one key the last by domain stays. A commit that another one overtakes is tried again on what that left.
        """
        folder = uuid.uuid4().hex
        rows = last_write(signals.select(*COLUMNS))
        rows.hint("rebalance", "source_db", "case_id").sortWithinPartitions("source_db", "case_id", "signal_type", "signal_value").write.partitionBy("source_db", "case_id").parquet(f"{self.path}/data/commit={folder}")
        fresh = self.spark.read.schema(DDL["signals"]).parquet(f"{self.path}/data/commit={folder}")
        written = fresh.select("source_db", "case_id").distinct()
        rewritten = written if cases is None else written.union(cases.select("source_db", "case_id")).distinct()
        for _ in range(attempts):
            number = max(self.snapshots(), default=0)
            try:
                return self._commit(number, folder, fresh, written, rewritten)
            except Conflict:
                continue
        raise Conflict(f"{self.path}: {attempts} commits were overtaken")

    def _commit(self, number: int, folder: str, fresh: DataFrame, written: DataFrame, rewritten: DataFrame) -> int:
        before = self.manifest(number or None)
        live = before.where("kind = 'case'")
        replaced = live.join(rewritten, ["source_db", "case_id"], "left_semi").select("source_db", "case_id", "folder")
        some = replaced.limit(NAMED_CASES + 1).collect()
        named = reduce(lambda a, b: a | b, [(F.col("commit") == r.folder) & F.col("source_db").eqNullSafe(r.source_db) & F.col("case_id").eqNullSafe(r.case_id) for r in some], F.lit(False)) if len(some) <= NAMED_CASES else None
        change = counters(fresh)
        if some:
            change = change.unionByName(counters(self._rows(replaced, named), -1))
        name = uuid.uuid4().hex
        summed(change).write.parquet(f"{self.path}/counters/{name}")
        kept = live.join(rewritten, ["source_db", "case_id"], "left_anti").select("kind", "source_db", "case_id", "folder")
        now = written.select(F.lit("case").alias("kind"), "source_db", "case_id", F.lit(folder).alias("folder"))
        counting = before.where("kind = 'counters'").union(self.spark.createDataFrame([("counters", None, None, name)], MANIFEST))
        return self._finish(number, kept.union(now).union(counting))

    def _finish(self, number: int, manifest: DataFrame) -> int:
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        self._publish(number + 1, name)
        return number + 1

    def compact(self) -> int:
        """Adds up all counters into one folder; rows stay where they are."""
        number = max(self.snapshots(), default=0)
        before, name = self.manifest(number or None), uuid.uuid4().hex
        summed(self.counters(number or None)).write.parquet(f"{self.path}/counters/{name}")
        return self._finish(number, before.where("kind = 'case'").union(self.spark.createDataFrame([("counters", None, None, name)], MANIFEST)))

    def vacuum(self, keep: int = 1) -> None:
        """Deletes what only snapshots before the last `keep` use, and what no commit has named. Not while a commit is under way."""
        numbers = self.snapshots()
        last = numbers[-keep:]
        names = {self.spark.read.text(f"{self.path}/snapshots/{n:012d}").first()[0] for n in last}
        used = [r for n in last for r in self.manifest(n).select("kind", "folder").distinct().collect()]
        wanted = {"manifests": names, "counters": {r.folder for r in used if r.kind == "counters"}, "data": {f"commit={r.folder}" for r in used if r.kind == "case"}, "snapshots": {f"{n:012d}" for n in last}}
        for folder, kept in wanted.items():
            for name in self._names(folder):
                if name not in kept:
                    _, _, target, files = self._hadoop(f"{self.path}/{folder}/{name}")
                    files.delete(target, True)
