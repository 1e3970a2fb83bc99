import hashlib
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from siltworks.sources import archives


def test_members_by_ranges(spark, tmp_path):
    """One archive over several tasks, each member once, labels paired with images."""
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i in range(40):
            z.writestr(f"set/{('train', 'valid')[i % 2]}/images/i{i}.png", bytes([i]) * 1000)
            if i % 4:
                z.writestr(f"set/{('train', 'valid')[i % 2]}/labels/i{i}.txt", f"0 {i}")
        z.writestr("set/train/labels/only.txt", "1")
        z.writestr("set/train/../images/up.png", b"x")
        z.writestr("readme.txt", b"x")
    found = archives.members(spark, str(tmp_path), target=5000)
    assert found.rdd.getNumPartitions() > 4
    rows = found.collect()
    assert len(rows) == len({(r.split, r.kind, r.name) for r in rows}) == 40 + 30 + 1
    assert {r.split for r in rows} == {"train", "val"}
    pairs = {(r.split, r.stem): (r.image and bytes(r.image), r.label) for r in archives.paired(found).collect()}
    assert len(pairs) == 41 and pairs["train", "only"] == (None, "1") and pairs["train", "i0"] == (bytes(1000), None) and pairs["val", "i5"] == (bytes([5]) * 1000, "0 5")
    with pytest.raises(Exception, match="too large"):
        archives.members(spark, str(tmp_path / "z.zip"), most=10).collect()
    os.makedirs(tmp_path / "none")
    assert archives.members(spark, str(tmp_path / "none")).count() == 0


def packaged(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("train/images/"), "id", F.lit(".bin")).alias("name"), F.when(F.col("id") % 10 != 3, F.concat(F.lit("c"), "id").cast("binary")).alias("content"), F.col("id").alias("source"))
    return rows.withColumn("sha256", F.when(F.col("source") % 10 == 4, "other").otherwise(F.sha2("content", 256)))


def test_package_round_trip(spark, tmp_path):
    path = str(tmp_path / "package")
    archives.write_package(packaged(spark, 50).repartition(4), path)
    got = {r.name: bytes(r.content) for r in archives.members(spark, path).collect()}
    assert got == {f"{i}.bin": f"c{i}".encode() for i in range(50) if i % 10 not in (3, 4)}
    records, manifest = archives.package_list(spark, path, "name string, source long, skipped string, bytes long, sha256 string")
    assert manifest["members"] == 40 and manifest["skipped"] == {"missing": 5, "changed": 5} and manifest["status"] == "complete"
    assert {(r.source, r.skipped) for r in records.where("skipped IS NOT NULL").collect()} == {(i, "missing" if i % 10 == 3 else "changed") for i in range(50) if i % 10 in (3, 4)}
    assert all(hashlib.sha256(got[os.path.basename(r.name)]).hexdigest() == r.sha256 for r in records.where("skipped IS NULL").collect())
    with pytest.raises(Exception, match="already"):
        archives.write_package(packaged(spark, 5), path)
    # what no manifest names is not read
    with zipfile.ZipFile(f"{path}/part-stray.zip", "w") as z:
        z.writestr("train/images/stray.bin", b"x")
    assert archives.members(spark, path).count() == 40


def test_failed_task_leaves_nothing_visible(spark, tmp_path):
    path = str(tmp_path / "package")
    broken = packaged(spark, 40).repartition(4).withColumn("source", F.when(F.col("source") == 17, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("source")))
    with pytest.raises(Exception, match="lost"):
        archives.write_package(broken, path)
    assert not os.path.exists(f"{path}/manifest.json") and json.loads(open(f"{path}/failure.json").read())["status"] == "failed"
    with pytest.raises(ValueError, match="no package"):
        archives.package_list(spark, path, "name string")
    archives.write_package(packaged(spark, 40), path)
    assert archives.members(spark, path).count() == 32


def test_archives_without_members(spark, tmp_path):
    """Tasks without rows, or whose rows are all skipped, leave archives that have no member."""
    path = str(tmp_path / "package")
    archives.write_package(packaged(spark, 5).where("source % 10 < 5").repartition(1).union(packaged(spark, 5).where("source = 3")).union(packaged(spark, 5).where("source < 0")), path)
    assert sorted(r.name for r in archives.members(spark, path).collect()) == ["0.bin", "1.bin", "2.bin"]
    assert archives.package_list(spark, path, "name string, skipped string")[0].where("skipped = 'missing'").count() == 2
    none = str(tmp_path / "empty")
    archives.write_package(packaged(spark, 5).where("source < 0"), none)
    assert archives.members(spark, none).count() == 0
