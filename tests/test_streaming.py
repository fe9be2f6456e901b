from loomlog.streaming.live import level_counts, reduce_batches, scrub_stream


def source(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def test_scrub(spark, tmp_path):
    stream = scrub_stream(source(spark, tmp_path, [("2024-01-15T14:32:01Z see https://h/a?x=1",)], "line string"))
    query = stream.writeStream.format("memory").queryName("scrubbed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert [r["line"] for r in spark.table("scrubbed").collect()] == ["14:32:01 see https://h/a"]


def test_level_counts(spark, tmp_path):
    rows = [("2024-01-01 10:05:00", "ERROR a"), ("2024-01-01 10:15:00", "error b"), ("2024-01-01 11:05:00", "INFO c"), ("2024-01-01 11:06:00", "d")]
    stream = source(spark, tmp_path, rows, "at string, line string").selectExpr("CAST(at AS TIMESTAMP) AS ts", "line")
    query = level_counts(stream).writeStream.outputMode("complete").format("memory").queryName("levels").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert {(r["start"].hour, r["level"]): r["n"] for r in spark.table("levels").collect()} == {(10, "ERROR"): 2, (11, "INFO"): 1}


def test_batches(spark, tmp_path):
    got = []
    stream = source(spark, tmp_path, [("a", 0, "x 1"), ("a", 1, "x 2")], "log_id string, line_no long, line string")
    query = reduce_batches(stream, lambda df, n: got.extend(r["line"] for r in df.collect())).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    assert got == ["[x2] x {N} | N = 1, 2"]
