"""The folder for intermediate tables."""

import os
import re

import pytest

from cloudtally import runtime
from cloudtally.streaming import ingest


class Elsewhere:
    """A session on a cluster without the setting."""

    class conf:
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:
        master = "local-cluster[3,2,1024]"


def test_a_cluster_without_the_setting_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Elsewhere)


def test_shuffles_begin_with_partitions_in_proportion_to_the_input(spark, tmp_path):
    assert runtime.partitions_for(6 << 30, 12) == 384 and runtime.partitions_for(1 << 20, 12) == 12
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (tmp_path / "a.parquet").write_bytes(b"")
    os.truncate(tmp_path / "a.parquet", (least + 5) * runtime.INPUT_PER_PART)
    try:
        runtime.size_shuffles(spark, str(tmp_path))
        plan = spark.range(9).selectExpr("id % 3 AS k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(k" in plan and f", {least + 5})" in plan
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == least
    finally:
        runtime.size_shuffles(spark, None)
    plan = spark.range(9).selectExpr("id % 3 AS k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert f", {least})" in plan


def test_rows_of_a_large_input_are_dealt_to_more_partitions(spark, tmp_path):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.range(9).selectExpr("id % 3 AS k", "id")
    own = lambda: runtime.dealt(rows, "k").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "a.parquet").write_bytes(b"")
    os.truncate(tmp_path / "a.parquet", (least + 5) * runtime.INPUT_PER_PART)
    try:
        runtime.size_shuffles(spark, str(tmp_path))
        assert f", {runtime.FINER * (least + 5)}), REPARTITION_BY_NUM" in own()
        os.truncate(tmp_path / "a.parquet", 1)
        runtime.size_shuffles(spark, str(tmp_path))
        assert f", {least}), REPARTITION_BY_COL" in own()  # coalesced by adaptive execution
    finally:
        runtime.size_shuffles(spark, None)
    assert f", {least}), REPARTITION_BY_COL" in own() and own().count("Exchange") == 1
    assert sorted(map(tuple, runtime.dealt(rows, "k").groupBy("k").count().collect())) == [(0, 3), (1, 3), (2, 3)]


def test_scanned_rows_are_dealt_to_few_partitions_first(spark, tmp_path):
    rows = spark.range(9).selectExpr("id % 3 AS k", "id")
    own = lambda: runtime.dealt(rows, "k", scanned=True).groupBy("k").count()
    parts = lambda: [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*, (\d+)\), REPARTITION_BY", own()._jdf.queryExecution().executedPlan().toString())]
    few = int(spark.sparkContext.getConf().get(runtime.STREAMED, "200"))
    (tmp_path / "a.parquet").write_bytes(b"")
    try:
        # from the last shuffle to the first; a task that writes to more holds its rows, up to a whole file
        for begin, want in ((few // runtime.FINER, [few]), (few // runtime.FINER + 1, [runtime.FINER * (few // runtime.FINER + 1), few])):
            os.truncate(tmp_path / "a.parquet", begin * runtime.INPUT_PER_PART)
            runtime.size_shuffles(spark, str(tmp_path))
            assert parts() == want
            assert sorted(map(tuple, own().collect())) == [(0, 3), (1, 3), (2, 3)]
    finally:
        runtime.size_shuffles(spark, None)
    assert parts() == [int(spark.conf.get("spark.sql.shuffle.partitions"))]


def test_released_folders_are_gone(spark):
    runtime.release(spark)
    stored = runtime.durable(spark.range(5))
    folder = runtime.shared_dir(spark).removeprefix("file:")
    assert stored.count() == 5
    mine = [n for n in os.listdir(folder) if n.startswith("cloudtally-")]
    assert runtime.release(spark) == 1
    assert set(mine) - set(os.listdir(folder)) and not runtime._FOLDERS


def test_repeats_are_found_across_batches(spark, tmp_path):
    schema = "organization_id string, row_id string, resource_id string, date date, cost double"
    days = [("o", "a", "vm-1"), ("p", "b", "vm-1"), ("o", "c", "vm-2"), ("o", "c2", "vm-2")], [("o", "d", "vm-1"), ("o", "e", "vm-3")], [("o", "f", "vm-1"), ("p", "g", "vm-9")]
    for k, rows in enumerate(days):
        part = spark.createDataFrame([(o, i, r, "2024-01-01", 1.0) for o, i, r in rows], schema.replace("date date", "date string"))
        part.selectExpr("organization_id", "row_id", "resource_id", "cast(date as date) as date", "cost").coalesce(1).write.parquet(f"{tmp_path}/in/{k}.d")
        for name in os.listdir(f"{tmp_path}/in/{k}.d"):
            if name.endswith(".parquet"):
                os.rename(f"{tmp_path}/in/{k}.d/{name}", f"{tmp_path}/in/rows-{k}.parquet")
                os.utime(f"{tmp_path}/in/rows-{k}.parquet", (k, k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "rows-*").parquet(f"{tmp_path}/in")
    _, failures = ingest.ingest_validated(stream, lambda b: b, path=f"{tmp_path}/out")
    got = sorted(r.row_id for r in spark.read.parquet(failures).collect())
    assert got == ["a", "c", "c2", "d", "f"]


def test_a_batch_reads_the_keys_of_its_own_months_only(spark, tmp_path, monkeypatch):
    schema = "organization_id string, row_id string, resource_id string, date date, cost double"
    read = []
    own = ingest._of_periods
    monkeypatch.setattr(ingest, "_of_periods", lambda s, f, c, days: read.append(sorted(days)) or own(s, f, c, days))
    for k in range(6):
        rows = [("o", f"r{k}", "vm-1", f"2024-0{k + 1}-01", 1.0), ("o", f"n{k}", f"vm-{k}", None, 1.0)] + ([("o", "again", "vm-1", "2024-02-01", 1.0)] if k == 5 else [])
        part = spark.createDataFrame(rows, schema.replace("date date", "date string")).selectExpr("organization_id", "row_id", "resource_id", "cast(date as date) as date", "cost")
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}.d")
        for name in os.listdir(f"{tmp_path}/in/{k}.d"):
            if name.endswith(".parquet"):
                os.rename(f"{tmp_path}/in/{k}.d/{name}", f"{tmp_path}/in/rows-{k}.parquet")
                os.utime(f"{tmp_path}/in/rows-{k}.parquet", (k, k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "rows-*").parquet(f"{tmp_path}/in")
    _, failures = ingest.ingest_validated(stream, lambda b: b, path=f"{tmp_path}/out")
    repeated = sorted(r.row_id for r in spark.read.parquet(failures).filter("rule = 'duplicated_resource_id'").collect())
    assert repeated == ["again", "r1"]
    assert [len(d) for d in read] == [2, 2, 2, 2, 2, 3]


def test_late_rows_are_kept_and_days_issued_again(spark, tmp_path):
    schema = "vm_id string, ts timestamp, cpu_usage_pct double, disk_read_kbps double"
    batches = [
        [("a", "2024-01-01 01:00", 10.0, 1.0), ("a", "2024-01-02 01:00", 20.0, 2.0), ("a", "2024-01-03 01:00", 30.0, 4.0)],
        [("a", "2024-01-01 02:00", 50.0, 8.0), ("b", "2024-01-01 03:00", 70.0, 16.0), ("a", "2024-01-04 02:00", 1.0, 1.0), ("a", None, 1.0, 1.0)],
        [("a", "2024-01-06 00:00", 5.0, 5.0), ("a", "2024-01-02 09:00", 40.0, 32.0)],
    ]
    for k, rows in enumerate(batches):
        part = spark.createDataFrame(rows, schema.replace("timestamp", "string")).selectExpr("vm_id", "cast(ts as timestamp) as ts", "cpu_usage_pct", "disk_read_kbps")
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}.d")
        for name in os.listdir(f"{tmp_path}/in/{k}.d"):
            if name.endswith(".parquet"):
                os.rename(f"{tmp_path}/in/{k}.d/{name}", f"{tmp_path}/in/rows-{k}.parquet")
                os.utime(f"{tmp_path}/in/rows-{k}.parquet", (k, k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "rows-*").parquet(f"{tmp_path}/in")
    issued, late = ingest.corrected_rollup(stream, path=f"{tmp_path}/out")
    got = {(r.vm_id, str(r.date)): (r.n, r.disk_read_kbps, r.issued_by, r.is_correction) for r in spark.read.parquet(issued).collect()}
    assert got == {
        ("a", "2024-01-01"): (2, 9.0, 1, True), ("b", "2024-01-01"): (1, 16.0, 1, True), ("a", "2024-01-02"): (2, 34.0, 2, True),
        ("a", "2024-01-03"): (1, 4.0, 2, False), ("a", "2024-01-04"): (1, 1.0, 2, False),
    }
    assert spark.read.parquet(late).count() == 3
