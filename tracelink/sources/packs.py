"""Evidence packs as ZIP files, written by tasks and committed as a whole.

Each task writes the members it gets to ZIP files of its own, one per case, or several where a case is large, under hidden names. When all tasks have ended, the
commit renames them and then writes one manifest that names every file with its members' number and its digest; a reader opens only what manifests name.
A job that fails leaves no manifest, and its abort deletes what its tasks wrote. A task that runs twice leaves a hidden file that no manifest names.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MEMBER = "case_id BIGINT, arcname STRING, content BINARY"
#: A ZIP file ends with the member that brings it to so many bytes.
VOLUME_BYTES = 512 << 20
#: Members have the time of the format's epoch: packs of the same members are the same bytes.
EPOCH = (1980, 1, 1, 0, 0, 0)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class _Digesting:
    """A stream that hashes and counts what is written to it."""

    def __init__(self, out):
        self.out, self.sha, self.size = out, hashlib.sha256(), 0

    def write(self, data) -> int:
        data = bytes(data)
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        return len(data)

    def flush(self) -> None:
        pass


@dataclass
class _Written(WriterCommitMessage):
    """Files of a task: (hidden name, case, members, bytes, sha256)."""

    files: list[tuple[str, int, int, int, str]]


class _PackWriter(DataSourceArrowWriter):
    def __init__(self, path: str, volume_bytes: int):
        self.path, self.volume_bytes, self.job = path, volume_bytes, uuid.uuid4().hex

    def write(self, iterator) -> _Written:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        done: list[tuple[str, int, int, int, str]] = []
        rows = (row for batch in iterator for row in zip(*[batch.column(c).to_pylist() for c in ("case_id", "arcname", "content")], strict=True))
        for case_id, members in groupby(rows, key=lambda r: r[0]):
            members = iter(members)
            first = next(members, None)
            while first is not None:
                first = self._volume(store, base, case_id, first, members, done)
        return _Written(done)

    def _volume(self, store, base: str, case_id: int, first: tuple, members: Iterator[tuple], done: list) -> tuple | None:
        """Writes one file; returns the member that the next one begins with."""
        name, count = f".{self.job}-{uuid.uuid4().hex}.zip", 0
        with store.open_output_stream(f"{base}/{name}", compression=None) as raw:
            out = _Digesting(raw)
            # the stream can't be sought, so sizes follow each member
            with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as pack:
                member: tuple | None = first
                while member is not None and (not count or out.size < self.volume_bytes):
                    if member[2] is None or not member[1]:
                        raise ValueError(f"case {case_id}: a member without a name or content")
                    pack.writestr(zipfile.ZipInfo(member[1], EPOCH), member[2], zipfile.ZIP_DEFLATED)
                    count += 1
                    member = next(members, None)
        done.append((name, case_id, count, out.size, out.sha.hexdigest()))
        return member

    def commit(self, messages: list[_Written | None]) -> None:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        lines = []
        for number, (hidden, case_id, members, size, sha) in enumerate(f for m in messages if m for f in m.files):
            name = f"case-{case_id}-{self.job[:8]}-{number:05d}.zip"
            store.move(f"{base}/{hidden}", f"{base}/{name}")
            lines.append(json.dumps({"file": name, "case_id": case_id, "members": members, "bytes": size, "sha256": sha}))
        draft = f"{base}/.{self.job}.manifest"
        with store.open_output_stream(draft, compression=None) as out:
            out.write("".join(line + "\n" for line in lines).encode())
        store.move(draft, f"{base}/{self.job}.manifest")

    def abort(self, messages: list[_Written | None]) -> None:
        from pyarrow import fs

        store, base = _store(self.path)
        # tasks that failed sent no message: all hidden files of this job go
        for found in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if found.base_name.startswith(f".{self.job}"):
                store.delete_file(found.path)


class _PackFile(InputPartition):
    def __init__(self, file: str, case_id: int, sha256: str):
        self.file, self.case_id, self.sha256 = file, case_id, sha256


def manifest_rows(path: str) -> list[dict]:
    """What the manifests of committed jobs name."""
    from pyarrow import fs

    store, base = _store(path)
    found = sorted(f.path for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.base_name.endswith(".manifest") and not f.base_name.startswith("."))
    rows = []
    for file in found:
        with store.open_input_stream(file, compression=None) as stream:
            rows += [json.loads(line) for line in stream.read().decode().splitlines()]
    return rows


class _PackReader(DataSourceReader):
    def __init__(self, path: str, verify: bool):
        self.path, self.verify = path, verify

    def partitions(self) -> list[InputPartition]:
        return [_PackFile(r["file"], r["case_id"], r["sha256"]) for r in manifest_rows(self.path)] or [_PackFile("", 0, "")]

    def read(self, partition: _PackFile) -> Iterator[tuple]:
        if not partition.file:
            return
        store, base = _store(self.path)
        with store.open_input_file(f"{base}/{partition.file}") as file:
            if self.verify:
                sha = hashlib.sha256()
                while piece := file.read(1 << 20):
                    sha.update(piece)
                if sha.hexdigest() != partition.sha256:
                    raise ValueError(f"{partition.file} isn't what its manifest says")
                file.seek(0)
            with zipfile.ZipFile(file) as pack:
                for info in pack.infolist():
                    yield partition.case_id, info.filename, pack.read(info)


class PackSource(DataSource):
    """ZIP packs in a folder that the driver and all executors reach: format("evidence_pack"), with options path, volume_bytes and verify."""

    @classmethod
    def name(cls) -> str:
        return "evidence_pack"

    def schema(self) -> str:
        return MEMBER

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("packs are evidence: they are added to, not overwritten")
        return _PackWriter(self.options["path"], int(self.options.get("volume_bytes", VOLUME_BYTES)))

    def reader(self, schema) -> DataSourceReader:
        return _PackReader(self.options["path"], self.options.get("verify", "true") == "true")


def write_zip_packs(members: DataFrame, path: str, volume_bytes: int = VOLUME_BYTES) -> None:
    """Packs of (case_id, arcname, content), by case and in order of names within a file; all of them or none.

    A member without a case, a name or content stops the job. A name that a case has twice is there twice. A large case is written by several tasks, to files of their own.
    """
    members.sparkSession.dataSource.register(PackSource)
    rows = members.select(F.col("case_id").cast("bigint").alias("case_id"), F.col("arcname").cast("string").alias("arcname"), F.col("content").cast("binary").alias("content"))
    dealt = rows.hint("rebalance", "case_id").sortWithinPartitions("case_id", "arcname")
    dealt.write.format("evidence_pack").mode("append").option("volume_bytes", volume_bytes).save(path)


def read_zip_packs(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """MEMBER rows of all committed packs; verify compares each file with its manifest's digest first."""
    spark.dataSource.register(PackSource)
    return spark.read.format("evidence_pack").option("verify", str(verify).lower()).load(path)
