"""The stateless stages on a stream."""

from pyspark.sql import functions as F

from lexiloom.streaming.preprocess import stream_encoded, stream_frequencies, stream_tokens


def run(df, name, mode="append"):
    stream = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    stream.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_stream(spark, tmp_path):
    rows = [(1, "The Tables, tables", "2024-01-01 00:00:00"), (2, None, "2024-01-01 10:00:00"), (3, "tables x9", "2024-01-02 00:00:00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at string").withColumn("at", F.col("at").cast("timestamp"))
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    assert sorted(run(stream_tokens(stream), "toks")) == [(1, 1, "tables"), (1, 2, "tables"), (2, 0, ""), (3, 0, "tables"), (3, 1, "x9")]
    words = spark.createDataFrame([(7, "tables")], "word_id int, token string")
    assert sorted(run(stream_encoded(stream, words), "enc")) == [(1, 1, 7), (1, 2, 7), (3, 0, 7)]
    counted = run(stream_frequencies(stream, "at").select("token", "freq"), "freqs", "complete")
    assert sorted(counted) == [("", 1), ("tables", 1), ("tables", 2), ("x9", 1)]
