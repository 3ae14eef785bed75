from pyspark.sql import functions as F

from crossgrain.sources.tables import table
from crossgrain.streaming import panels as S


def test_final_cells_equal_the_batch(spark, sf_dir, tmp_path):
    events = table(spark, sf_dir, "events").select("ts", "user_id", F.col("value").cast("double").alias("value"))
    last = events.agg(F.max(F.to_date("ts")).alias("d")).first()["d"]
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = S.streaming_cells(S.event_stream(spark, f"{tmp_path}/in", "ts timestamp_ntz, user_id long, value double", 10), "ts", "user_id", "value", "2 days")
    query = S.written_once(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert query.awaitTermination(120)
    got = {(r["d"], r["asset"]): (round(r["px"], 6), r["volume"]) for r in spark.read.schema("d date, asset long, px double, volume double").parquet(f"{tmp_path}/out").collect()}
    want = {(r["d"], r["user_id"]): (round(r["px"], 6), float(r["n"])) for r in events.groupBy(F.to_date("ts").alias("d"), "user_id").agg(F.avg("value").alias("px"), F.count("value").alias("n")).where("n > 0").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and last not in {d for d, _ in got}
