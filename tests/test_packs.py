import zipfile

import pytest
from pyspark.sql import functions as F

from tracelink.sources import packs

MEMBERS = [(c, f"m/{c}/{i}.html", f"body {c} {i} ".encode() * (i + 1)) for c in (1, 2, -3) for i in range(40)] + [(1, "ü/ñ.txt", b""), (1, "twice", b"a"), (1, "twice", b"b")]


def rows(df):
    return sorted((r.case_id, r.arcname, bytes(r.content)) for r in df.collect())


def made(spark, members=None):
    return spark.createDataFrame(members or MEMBERS, packs.MEMBER).repartition(5).withColumn("extra", F.lit(1))


@pytest.mark.parametrize("volume", [packs.VOLUME_BYTES, 1, 2000])
def test_round_trip(spark, tmp_path, volume):
    path = f"file://{tmp_path}/packs"
    packs.write_zip_packs(made(spark), path, volume)
    assert rows(packs.read_zip_packs(spark, path)) == sorted(MEMBERS)
    named = packs.manifest_rows(path)
    assert sum(r["members"] for r in named) == len(MEMBERS) and len({r["file"] for r in named}) == len(named) == len(list((tmp_path / "packs").glob("*.zip")))
    assert volume != 1 or len(named) == len(MEMBERS)
    for r in named:
        with zipfile.ZipFile(tmp_path / "packs" / r["file"]) as pack:
            assert pack.testzip() is None and len(pack.infolist()) == r["members"] and pack.namelist() == sorted(pack.namelist())


def test_packs_are_added_to(spark, tmp_path):
    path = f"file://{tmp_path}/packs"
    assert rows(packs.read_zip_packs(spark, path)) == []
    packs.write_zip_packs(made(spark), path)
    packs.write_zip_packs(made(spark, [(9, "later", b"x")]), path)
    assert rows(packs.read_zip_packs(spark, path)) == sorted([*MEMBERS, (9, "later", b"x")])
    packs.write_zip_packs(made(spark).limit(0), path)
    assert len(rows(packs.read_zip_packs(spark, path))) == len(MEMBERS) + 1
    with pytest.raises(Exception, match="not overwritten"):
        made(spark).drop("extra").write.format("evidence_pack").mode("overwrite").save(path)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/packs"
    packs.write_zip_packs(made(spark, [(9, "kept", b"x")]), path)
    before = sorted(f.name for f in (tmp_path / "packs").iterdir())
    for bad in ((1, "z/last", None), (1, None, b"x")):
        with pytest.raises(Exception, match="without a name or content"):
            packs.write_zip_packs(made(spark, [*MEMBERS, bad]), path, 500)
        assert sorted(f.name for f in (tmp_path / "packs").iterdir() if not f.name.endswith(".crc")) == before
    assert rows(packs.read_zip_packs(spark, path)) == [(9, "kept", b"x")]


def test_files_without_a_manifest_are_not_read_and_changed_ones_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/packs"
    packs.write_zip_packs(made(spark), path)
    with zipfile.ZipFile(tmp_path / "packs" / "case-1-other.zip", "w") as pack:
        pack.writestr("stray", b"x")
    assert rows(packs.read_zip_packs(spark, path)) == sorted(MEMBERS)
    file = tmp_path / "packs" / packs.manifest_rows(path)[0]["file"]
    file.write_bytes(file.read_bytes() + b"x")
    with pytest.raises(Exception, match="what its manifest says"):
        rows(packs.read_zip_packs(spark, path))
