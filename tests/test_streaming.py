"""Stable texts of a stream of runs."""

from lodestone.streaming.history import stable_stream


def test_stable_stream(spark, tmp_path):
    source, out = f"{tmp_path}/in", []
    schema = "domain string, run_seq long, text string"
    for i in range(3):
        spark.createDataFrame([("d", i, "Red  plate"), ("d", i, f"once {i}")], schema).coalesce(1).write.mode("append").json(source)
    stream = stable_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source))
    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda df, i: out.append([r.asDict() for r in df.collect()])).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [len(x) for x in out] == [0, 1, 1]
    assert out[-1][0]["norm"] == "red plate" and out[-1][0]["appearances"] == 3 and out[-1][0]["stability"] == 1.0
