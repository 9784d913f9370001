"""Scans and sinks on small files."""

import pytest
from pyspark.sql import functions as F

from obsexp.session import scratch_path
from obsexp.sources import ledger as lg
from obsexp.sources.readers import MissingTable, read_events_csv, read_periods, read_table
from obsexp.sources.writers import compact, write_table


def test_csv_keeps_the_schema_and_blanks_bad_fields(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text("id,v,name\n1,2.5,a\nx,3.5,b\n3,NaN,c\n4,,\n")
    rows = read_events_csv(spark, str(path), "id long, v double, name string").collect()
    assert [tuple(r) for r in rows] == [(1, 2.5, "a"), (None, 3.5, "b"), (3, None, "c"), (4, None, None)]


def test_missing_table_names_its_producer(spark, tmp_path):
    with pytest.raises(MissingTable, match="run the scoring step first"):
        read_table(spark, str(tmp_path / "none"), "the scoring step")


def test_filters_reach_the_files(spark, small):
    plan = read_table(spark, f"{small}/orders.parquet").where("o_orderstatus = 'F'").select("o_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in text


def test_periods_come_from_file_names(spark, tmp_path):
    import pandas as pd
    pd.DataFrame({"a": [1.0, float("nan")], "b": ["x", "y"]}).to_parquet(tmp_path / "shots_2014-15.parquet")
    pd.DataFrame({"a": [3.0]}).to_parquet(tmp_path / "shots_2015-16.parquet")
    rows = read_periods(spark, f"{tmp_path}/shots_*.parquet", r"^shots_(.*)\.parquet$").orderBy("season", "b").collect()
    assert [(r.season, r.a, r.b) for r in rows] == [("2014-15", 1.0, "x"), ("2014-15", None, "y"), ("2015-16", 3.0, None)]


def test_compaction_and_ordered_sink(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") < 90, 2014).otherwise(2015).alias("season"),
                                   F.when(F.col("id") % 4 == 0, "low").otherwise("high").alias("release_confidence"))
    path = scratch_path(spark, "t-compact")
    report = {r.season: (r.n, round(r.confident_share, 3)) for r in compact(rows, path, "season", F.col("release_confidence") == "high").collect()}
    assert report == {2014: (90, 0.744), 2015: (10, 0.8)}
    out = scratch_path(spark, "t-sorted")
    write_table(rows, out, "csv", [F.desc("id")])
    assert [r.id for r in read_events_csv(spark, out, "id long, season int, release_confidence string").limit(3).collect()] == [99, 98, 97]
    with pytest.raises(ValueError):
        write_table(rows, out, "orc")


def test_status_counts_each_file_once(spark):
    listing = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "file string")
    book = spark.createDataFrame([("a", "failed", "x", 0), ("a", "ok", None, 5), ("b", "empty", "y", 0), ("c", "failed", "z", 0)], lg.LEDGER)
    row = lg.ingest_status(listing, book).first().asDict()
    assert row == {"total": 4, "extracted": 1, "empty": 1, "remaining": 2, "rows": 5, "open_failures": 1}
    assert sorted(r.file for r in lg.pending(listing, book).collect()) == ["c", "d"]


def test_publishing_waits_for_every_unit(spark, tmp_path):
    source = tmp_path / "units"
    source.mkdir()
    for name, text in (("a b.txt", "1\n2\n"), ("c.txt", "3\n"), ("void.txt", ""), ("bad.txt", "x\n")):
        (source / name).write_text(text)
    taken = []

    def extract(todo):
        files = [r.path for r in todo.collect()]
        taken.append(sorted(f.rsplit("/", 1)[1] for f in files))
        lines = spark.read.text(files).withColumn("file", F.col("_metadata.file_name")).withColumn(
            "v", F.col("value").try_cast("int")).withColumn("file", F.replace("file", F.lit("%20"), F.lit(" ")))
        counts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n_frames"), F.count(F.lit(1)).alias("n_events"),
                                           F.count("v").alias("n_rows"), (F.count("v") == 0).alias("corrupt"))
        return lines.where("v is not null").select("file", "v"), counts

    out, book, routes, target = (scratch_path(spark, f"t-season-{c}") for c in ("rows", "ledger", "routes", "target"))
    run = lambda: lg.ingest_new(spark, str(source), out, book, extract, "*.txt", routes=routes, batch=2).first()
    listing = lambda: lg.list_units(spark, str(source), "*.txt")
    first = run()
    assert (first.total, first.extracted, first["empty"], first.open_failures, first.rows) == (4, 2, 1, 1, 3)
    assert sorted(f for files in taken for f in files) == ["a b.txt", "bad.txt", "c.txt", "void.txt"]
    side = {s: sorted(r.file for r in lg.read_route(spark, routes, s).collect()) for s in ("ok", "empty", "failed")}
    assert side == {"ok": ["a b.txt", "c.txt"], "empty": ["void.txt"], "failed": ["bad.txt"]}
    assert not lg.publish(spark, listing(), out, book, target)  # a failure is open
    with pytest.raises(MissingTable):
        lg.read_published(spark, target)
    (source / "bad.txt").write_text("7\n")
    assert run().open_failures == 0 and not lg.publish(spark, listing(), out, book, target, limited=True)
    assert lg.publish(spark, listing(), out, book, target) and lg.publish(spark, listing(), out, book, target)
    assert sorted(r.v for r in lg.read_published(spark, target).collect()) == [1, 2, 3, 7]
    assert spark.read.parquet(f"{target}/commits").count() == 1  # the second call found it published
    (source / "new.txt").write_text("9\n")
    assert not lg.publish(spark, listing(), out, book, target)  # the old version stays readable
    assert lg.read_published(spark, target).count() == 4
    assert run().remaining == 0 and lg.publish(spark, listing(), out, book, target)
    assert sorted(r.v for r in lg.read_published(spark, target).collect()) == [1, 2, 3, 7, 9]
