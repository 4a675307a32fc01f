from pyspark.sql import functions as F

from quadrille.operators import timeagg
from quadrille.streaming.periods import stream_periods


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_periods(stream, "ts", "month", ["value"], "30 days").writeStream.format("memory").queryName("periods").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["period"]: r["n"] for r in spark.table("periods").collect()}
    assert got == {r["period"]: r["n"] for r in timeagg.time_aggregate(batch, "ts", "month").collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [("2024-01-10", 1.0), ("2024-06-20", 2.0)], [("2024-06-01", 3.0), ("2020-01-01", 9.0), ("2024-05-25", 4.0)], [("2020-01-02", 9.0), ("2024-07-01", 5.0)]
    schema, into = "day string, value double", str(tmp_path / "in")
    for k, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{into}/k={k}")
        stream = spark.readStream.schema(schema).parquet(f"{into}/*").select(F.to_timestamp("day").alias("ts"), "value")
        out = stream_periods(stream, "ts", "month", ["value"], "1 day")
        into_rows = lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))
        q = out.writeStream.outputMode("update").foreachBatch(into_rows).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r["period"], r["n"], r["mean_value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    june = 2024 * 12 + 5
    assert {p for p, *_ in got} == {june - 5, june - 1, june, june + 1} and (june, 2, 2.5) in got and (june - 1, 1, 4.0) in got
