import datetime as dt

import pytest

from strandline.sources import readers, sinks


def test_one_header_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("Date,Price,Volume\n2020-01-02,1.5,10\n2020-01-01,x,20\nbad,3,4\n")
    d = readers.read_csv(spark, str(p)).orderBy("ts").collect()
    assert [(r.ts, r.Price, r.Volume) for r in d] == [(dt.date(2020, 1, 1), None, 20.0), (dt.date(2020, 1, 2), 1.5, 10.0)]
    assert readers.header_rows(spark, str(p)) == 1
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(p), date="nope")


def test_two_level_csv(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_text("asset_class,equity_indices,,volatility\ncolumn,tsx,spx,vix\nDate,,,\n2020-01-01,1,2,3\n2020-01-02,4,,6\n")
    long, meta = readers.read_two_level_csv(spark, str(p))
    assert readers.header_rows(spark, str(p)) == 2
    assert {(r.series_id, r.asset_class, r.ordinal) for r in meta.collect()} == {("tsx", "equity_indices", 0), ("spx", "equity_indices", 1), ("vix", "volatility", 2)}
    assert long.count() == 6 and long.where("series_id = 'spx' and value is null").count() == 1
    assert readers.load(spark, str(p)).count() == 6


def test_date_window_is_inclusive(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("Date,price\n" + "".join(f"2020-01-{i:02d},{i}\n" for i in range(1, 31)))
    assert readers.read_csv(spark, str(p), start="2020-01-10", end="2020-01-20").count() == 11


def test_mapping_keys():
    assert readers.mapping({" A Index | PX_LAST": "a", "B|F|O": "b"}) == [("A Index", "PX_LAST", "", "a"), ("B", "F", "O", "b")]
    with pytest.raises(ValueError):
        readers.mapping({"A": "a"})


def test_history_source(spark):
    d = readers.history(spark, {"AA|PX": "a", "BBB|PX": "b"}, "strandline.sources.readers:fixture_provider", start="2024-01-01")
    got = {r.series_id: r["n"] for r in d.groupBy("series_id").count().withColumnRenamed("count", "n").collect()}
    assert got == {"a": 10, "b": 10}


def test_settings_round_trip(tmp_path):
    s = readers.Settings(fees=0.1, strategies=["x"])
    s.to_yaml(str(tmp_path / "s.yaml"))
    assert readers.Settings.from_yaml(str(tmp_path / "s.yaml")) == s


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", dt.date(2020, 1, 1), 1.0)], "series_id string, ts date, value double")
    sinks.write_run(str(tmp_path), "r1", equity=d)
    assert spark.read.parquet(f"{tmp_path}/equity").first().run_id == "r1"
    sinks.write_prices(d, f"{tmp_path}/prices")
    assert spark.read.parquet(f"{tmp_path}/prices").where("series_id = 'a' and year = 2020").count() == 1
    sinks.write_csv(d, f"{tmp_path}/csv", one_file=True)
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 1
    assert "1.0000" in sinks.report("T", d)


def test_reports_tell_what_they_leave_out(spark, tmp_path):
    d = spark.range(5).selectExpr("id", "cast(id as double) / 3 as x")
    text = sinks.report("Rows", d.orderBy("id"), 2)
    assert "... and 3 more rows" in text and "0.3333" in text and "1.3333" not in text and "more rows" not in sinks.report("Rows", d)
    whole = sinks.full_report("Run", performance=d, trade_blotter=d.limit(0))
    assert "Performance" in whole and "Trade blotter" in whole and len(whole.splitlines()) > 12
    sinks.write_text(spark, whole, f"{tmp_path}/r")
    assert spark.read.text(f"{tmp_path}/r").count() == len(whole.split("\n"))


def test_intraday_requests_are_narrowed_and_streamed(spark, small, tmp_path):
    import datetime as dt

    from pyspark.sql import functions as F

    from strandline.sources import intraday

    e = spark.read.parquet(f"{small}/events.parquet")
    lo, hi = e.agg(F.min("ts"), F.max("ts")).first()
    kinds, end = sorted(r[0] for r in e.select("event_type").distinct().collect()), hi + dt.timedelta(microseconds=1)
    how = {"provider": "strandline.sources.intraday:table_provider", "path": f"{small}/events.parquet"}
    whole = intraday.intraday(spark, kinds, lo, end, **how)
    want = sorted((r.event_type, r.ts, r.event_id, r.value) for r in e.collect())
    assert sorted(map(tuple, whole.collect())) == want
    cut = lo + dt.timedelta(days=3)
    part = whole.where(F.col("ts") < F.lit(cut).cast("timestamp_ntz"))
    assert sorted(map(tuple, part.collect())) == [r for r in want if r[1] < cut]
    assert part.rdd.getNumPartitions() <= 4 * len(kinds) < whole.rdd.getNumPartitions()
    q = intraday.intraday_stream(spark, kinds, lo, end, slices=11, **how).writeStream.format("memory").queryName("intraday").option("checkpointLocation", str(tmp_path)).start()
    try:
        q.processAllAvailable()
        assert sorted(map(tuple, spark.table("intraday").collect())) == want
    finally:
        q.stop()


def test_slices_meet_and_cover():
    import datetime as dt

    from strandline.sources import intraday

    a, b = dt.datetime(2024, 1, 1, 7, 30), dt.datetime(2024, 1, 3, 1)
    s = intraday.sliced(a, b, 86400)
    assert s[0] == (a, dt.datetime(2024, 1, 2)) and s[-1][1] == b and all(x[1] == y[0] for x, y in zip(s, s[1:], strict=False))
    assert intraday.sliced(a, a, 60) == []
