"""Snapshot histories: what a read returns, and which files it opens."""

from __future__ import annotations

import glob

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import levels as LV
from corpusloom.sources import tables as ST

SCHEMA = "repo string, path string, sha256 string"


def at(day: int):
    return F.lit(f"2024-01-{day:02} 00:00:00").cast("timestamp")


def write(spark, path, day, rows):
    ST.write_manifest(spark.createDataFrame(rows, SCHEMA), path, at(day))


def state(df):
    return {(r["repo"], r["path"]): r["sha256"] for r in df.collect()}


def spoil(path: str, level: str) -> None:
    """Make the files of a level unreadable."""
    files = glob.glob(f"{path}/{level}/**/*.parquet", recursive=True)
    assert files
    for name in files:
        with open(name, "wb") as f:
            f.write(b"no parquet file")


def test_reads_open_the_newest_state_and_later_deltas_only(spark, tmp_path):
    path = str(tmp_path / "manifest")
    write(spark, path, 1, [("r", "a", "1"), ("r", "b", "1"), ("s", "a", "1")])
    write(spark, path, 2, [("r", "a", "2")])
    ST.compact_manifest(spark, path)
    write(spark, path, 5, [("r", "b", "5"), ("t", "x", "5")])
    now = {("r", "a"): "2", ("r", "b"): "5", ("s", "a"): "1", ("t", "x"): "5"}
    assert state(ST.read_manifest(spark, path)) == now
    assert state(ST.read_manifest(spark, path, at(1))) == {("r", "a"): "1", ("r", "b"): "1", ("s", "a"): "1"}
    spoil(path, "kind=delta/at=2024-01-01T00-00-00.000000")
    spoil(path, "kind=delta/at=2024-01-02T00-00-00.000000")
    assert state(ST.read_manifest(spark, path)) == now
    assert state(ST.read_manifest(spark, path, at(3))) == {("r", "a"): "2", ("r", "b"): "1", ("s", "a"): "1"}
    assert state(ST.read_manifest(spark, path, repos=["t"])) == {("t", "x"): "5"}
    with pytest.raises(Exception, match="(?i)parquet"):
        ST.read_manifest(spark, path, at(1)).collect()
    spoil(path, "kind=delta/at=2024-01-05T00-00-00.000000")
    assert state(ST.read_manifest(spark, path, at(4))) == {("r", "a"): "2", ("r", "b"): "1", ("s", "a"): "1"}


def test_repos_read_their_bucket_only(spark, tmp_path):
    path = str(tmp_path / "manifest")
    write(spark, path, 1, [(f"r{k}", "a", str(k)) for k in range(40)])
    own = spark.createDataFrame([("r7",)], "repo string").select(LV.bucket_of(F.col("repo"))).first()[0]
    for folder in glob.glob(f"{path}/kind=delta/at=*/bucket=*"):
        if not folder.endswith(f"bucket={own}"):
            spoil(path, folder.removeprefix(path + "/"))
    assert state(ST.read_manifest(spark, path, repos=["r7"])) == {("r7", "a"): "7"}


def test_plain_appends_and_an_empty_history(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.createDataFrame([("r", "a", "1")], SCHEMA).withColumn("snapshot_ts", at(1)).write.parquet(path)
    spark.createDataFrame([("r", "a", "2")], SCHEMA).withColumn("snapshot_ts", at(2)).write.mode("append").parquet(path)
    assert state(ST.read_manifest(spark, path)) == {("r", "a"): "2"}
    none = str(tmp_path / "none")
    write(spark, none, 1, [])
    ST.compact_manifest(spark, none)
    assert state(ST.read_manifest(spark, none)) == {}
