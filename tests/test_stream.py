from coordweave.streaming.convert import convert_stream


def test_stream_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "refseq:NC_000001.1:5..9"), (2, "refseq:NC_000001.1:12")], "query_id long, text string").write.parquet(source)
    blocks = spark.createDataFrame([(0, "refseq:NC_000001.1", 0, "refseq:NM_000001.1", 100, 10, True)], "ix long, src_ref string, src long, tgt_ref string, tgt long, len long, rev boolean")
    stream = spark.readStream.schema("query_id long, text string").parquet(source)
    convert_stream(stream, blocks, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [(r.query_id, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, "refseq:NM_000001.1:complement(102..106)")]
