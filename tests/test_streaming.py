"""A small stream of Parquet files into a store."""

from pyspark.sql import functions as F

from loomgraph.plans.writer import open_session
from loomgraph.streaming import changes_into, windowed_counts

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_stream_becomes_nodes(spark, tmp_path):
    source = tmp_path / "in"
    spark.read.parquet(EVENTS).limit(50).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    db = open_session(spark, str(tmp_path / "graph"))
    for _ in range(2):  # a second run finds nothing new
        stream = spark.readStream.schema(schema).parquet(str(source))
        query = changes_into(db.store, stream, label="Event", id_column="event_id").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert db.execute("MATCH (e:Event) RETURN count(*) AS n").rows() == [{"n": 50}]


def test_windowed_counts(spark, tmp_path):
    schema = spark.read.parquet(EVENTS).schema
    source = tmp_path / "in"
    spark.read.parquet(EVENTS).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source))
    query = windowed_counts(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM counts").first()["n"] == 1000
