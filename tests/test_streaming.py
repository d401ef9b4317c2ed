from graphspun.streaming.manifest import manifest_stream, write_stream


def test_manifest_grows_once_for_each_slug(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for batch in (["a", "b", "a"], ["b", "c", None]):
        spark.createDataFrame([(s,) for s in batch], "slug string").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("slug string").parquet(source)
        query = write_stream(manifest_stream(stream, "person"), out, check)
        assert query.awaitTermination(120) and query.exception() is None
    found = sorted((r.kind, r.lookup_name, r.path) for r in spark.read.parquet(out).collect())
    assert found == [("person", x, f"person/{x}") for x in "abc"]


def test_state_is_bounded_with_a_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01'), ('a', timestamp'2024-01-01 01:00:00'), ('b', timestamp'2024-01-02') AS t(slug, at)").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("slug string, at timestamp").parquet(source)
    query = write_stream(manifest_stream(stream, "book", arrived="at"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert query.awaitTermination(120)
    assert sorted(r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
