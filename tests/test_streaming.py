from evalguard.streaming import monitors


def test_entities_in_a_second_split(spark, tmp_path):
    schema = "p string, s string"
    for i, batch in enumerate([[("a", "train"), ("b", "train")], [("a", "test"), ("a", "test"), ("b", "train"), ("c", "test")]]):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}.parquet"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    monitors.run_once(monitors.entity_leaks(stream, "p", "s"), "leaks", str(tmp_path / "ck"))
    rows = [tuple(r) for r in spark.table("leaks").collect()]
    # files come in the order of their times; whichever split comes first, a is seen in the other
    assert [r[0] for r in rows] == ["a"]


def test_repeated_content_is_dropped(spark, tmp_path):
    spark.createDataFrame([(1, "x", "2024-01-01 00:00:00"), (2, "x", "2024-01-01 01:00:00"), (3, "y", "2024-01-01 02:00:00")], "i long, t string, ts string").selectExpr("i", "t", "timestamp(ts) ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("i long, t string, ts timestamp").parquet(str(tmp_path / "in"))
    monitors.run_once(monitors.first_seen(stream, ["t"], "ts"), "seen", str(tmp_path / "ck"))
    assert sorted(r["t"] for r in spark.table("seen").collect()) == ["x", "y"]
