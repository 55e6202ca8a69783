import datetime as dt

import pytest
from pyspark.sql import functions as F

from cloudtally.operators import silver
from cloudtally.plans import fixtures as fx
from cloudtally.sources import csv_upload, pricing, store, telemetry


def write(path, text):
    path.write_text(text)
    return str(path)


def test_upload_without_utilisation(spark, tmp_path):
    p = write(
        tmp_path / "cur.csv",
        "UsageStartDate,ProductName,LineItemResourceId,UnblendedCost\n"
        "2024-01-01,Amazon EC2,i-1,4.50\n2024-01-02,Amazon EC2,i-1,9.00\n2024-01-01,Amazon S3,b,0.80\nbad,Amazon S3,b,oops\n",
    )
    up = csv_upload.ingest(spark, p, "org-1")
    rows = {(r.resource_id, r.runtime_days): r for r in up.table.collect()}
    assert rows["i-1", 2].cost_growth_rate == 1.0 and rows["b", 2].date is None and rows["b", 2].cost is None
    assert up.weights == {"growth": 0.6667, "history": 0.3333}
    assert [r.rule for r in up.failures.collect()] == ["missing_timestamp"]


def test_upload_with_messy_headers_and_region(spark, tmp_path):
    p = write(
        tmp_path / "b.csv",
        "Usage-Date,service_name,Resource ID,amount,CPU Utilization,Avg Memory,Region\n2024-03-01,EC2,a,2,101,-4, \n",
    )
    up = csv_upload.ingest(spark, p)
    assert {r.rule for r in up.failures.collect()} == {"impossible_cpu_value", "negative_memory", "missing_region"}


def test_upload_missing_required_column(spark, tmp_path):
    p = write(tmp_path / "c.csv", "date,cost\n2024-01-01,3\n")
    with pytest.raises(ValueError, match="resource_id"):
        csv_upload.ingest(spark, p)


def test_price_files(spark, tmp_path):
    paths = [
        write(tmp_path / "a.csv", " InstanceType,Price,Region,Cost Center\nm5.large,0.1,us-east-1,x\nm5.large,0.1,us-east-1,x\nm5.large,-1,us-east-1,x\n"),
        write(tmp_path / "b.csv", "InstanceType,SpotPrice,AvailabilityZone,Timestamp,ProductDescription\nm5.large,0.05,us-east-1b,2024-01-01 00:00:00,Linux/UNIX\n"),
        write(tmp_path / "c.csv", "Instance_Type,Price_Prediction,Real_AWS_SpotPrice,Timestamp\nc5.large,0.2,0.3,2024-01-01\n"),
        write(tmp_path / "d.csv", "foo,cost\n1,2\n"),
    ]
    kept, manifest = pricing.build_prices(spark, paths)
    got = {(r.instance_type, r.pricing_type): r for r in kept.collect()}
    assert set(got) == {("m5.large", "on_demand"), ("m5.large", "spot"), ("c5.large", "prediction")}
    assert got["m5.large", "spot"].region == "us-east-1" and got["m5.large", "spot"].os == "linux"
    assert got["m5.large", "on_demand"].os == "unknown"  # 'os' inside 'Cost' is not an OS column
    by_file = {r.source_file: r for r in manifest.collect()}
    assert by_file["a.csv"].rows_dropped_invalid_or_dupe == 2 and by_file["d.csv"].needs_manual_mapping


def test_telemetry_folder_with_two_headers(spark, tmp_path):
    head = ",".join(telemetry.fv.TELEMETRY_COLUMNS)
    a = write(tmp_path / "a.csv", f"{head}\n1,2024-01-01 00:05:00,2,100,50,50,1024,512,1,2,3,4\n1,nope,2,100,50,50,1024,512,1,2,3,4\n")
    b = write(tmp_path / "b.csv", f"{head},Extra\n2,2024-01-01 00:05:00,2,100,,,1024,512,1,2,3,4,x\n")
    raw = telemetry.read_folder(spark, [a, b])
    assert {r.source_file for r in raw.collect()} == {"a.csv", "b.csv"}
    cleaned = silver.clean(telemetry.typed(raw), order=["source_file", "line"])
    assert [r.vm_id for r in cleaned.collect()] == ["1"]
    with pytest.raises(ValueError):
        telemetry.typed(raw.drop("VM_ID"))
    with pytest.raises(FileNotFoundError):
        telemetry.read_folder(spark, [])


def test_upload_modes_and_purge(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda org, n: spark.createDataFrame([(org, "r", dt.date(2024, 1, 1 + i)) for i in range(n)] + [(org, "r", None)], "organization_id string, resource_id string, date date")
    store.load_upload(rows("a", 3), path, "new_analysis")
    store.load_upload(rows("b", 2), path, "new_analysis")
    store.load_upload(rows("a", 1), path, "continuous")
    assert spark.read.parquet(path).groupBy("organization_id").count().orderBy("organization_id").collect()[0]["count"] == 4
    store.load_upload(rows("a", 2), path, "new_analysis")  # replaces tenant a only
    now = {r.organization_id: r["count"] for r in spark.read.parquet(path).groupBy("organization_id").count().collect()}
    assert now == {"a": 2, "b": 2}
    scan = store.tenant_scan(spark, path, "a")
    assert "PartitionFilters: [isnotnull(organization_id" in scan._jdf.queryExecution().toString()
    assert store.purge(spark.read.parquet(path), "a").count() == 2
    with pytest.raises(ValueError):
        store.load_upload(rows("a", 1), path, "other")


def test_feature_round_trip(spark, tiny):
    base = fx.billing(spark, tiny).filter("resource_id = 'vm-1'").withColumn("empty", F.lit(None).cast("double"))
    first = store.feature_rows(base.select("organization_id", "resource_id", "date", "cost", "empty"))
    twice = store.upsert(first, first.withColumn("created_at", F.col("created_at")))
    back = store.read_features(twice, ["cost", "empty"], resource_ids=["vm-1"])
    assert back.count() == base.count() and back.filter("empty is not null").count() == 0


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([("a", "1")], "metric string, value string")
    store.export_rows(df, str(tmp_path / "x"), "csv")
    store.export_rows(df, str(tmp_path / "y"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "x")).first().metric == "a"
    assert spark.read.json(str(tmp_path / "y")).first().value == "1"
    with pytest.raises(ValueError):
        store.export_rows(df, str(tmp_path / "z"), "xml")


def test_headers_cost_no_more_for_long_files(spark, tmp_path):
    from cloudtally.sources import headers

    paths = []
    for k, text in enumerate(["a,b\n" + "1,2\n" * 200_000, "a,b\r\n1,2\r\n", "c;d", "", "x" * 40_000 + ",y\n1"]):
        paths.append(f"{tmp_path}/with space {k}.csv")
        with open(paths[-1], "w", newline="") as f:
            f.write(text)
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            read.append(n)
            return self.f.read(n)

        def __enter__(self):
            return self

        def __exit__(self, *more):
            self.f.close()

    real = headers.pafs.LocalFileSystem

    class System:
        def open_input_file(self, path):
            return Counted(real().open_input_file(path))

    headers.pafs.LocalFileSystem = System
    try:
        assert headers.first_line(f"file://{paths[0]}") == "a,b" and sum(read) == headers.FIRST_BYTES
    finally:
        headers.pafs.LocalFileSystem = real
    got = {r.path.removeprefix("file://"): r.header for r in headers.first_lines(spark, paths).collect()}
    assert got == {paths[0]: "a,b", paths[1]: "a,b", paths[2]: "c;d", paths[4]: "x" * 40_000 + ",y"}
    through = {headers.unquote(r.path).removeprefix("file:"): r.header for r in headers._read_through(spark, paths).collect()}
    assert through == got
