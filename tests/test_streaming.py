"""Incremental fitting by Structured Streaming."""

from pyspark.sql import functions as F

from lattica.model import Config, Model
from lattica.operators.graph import Graph
from lattica.plans import graphs
from lattica.streaming import incremental


def to_graph(rows):
    nodes = rows.select(F.col("user_id").alias("graph_id"), F.col("event_id").alias("node_id"), "event_type", F.col("value").alias("y"))
    return Graph(nodes, graphs.chain(rows, "user_id", ["ts", "event_id"], "event_id"))


def test_batches_add_up_to_the_whole_fit(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    for k in range(2):
        events.where(F.pmod("user_id", F.lit(2)) == k).coalesce(1).write.parquet(str(tmp_path / f"in/part={k}"))
    config = Config(("event_type",), 1)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    run = stream.writeStream.foreachBatch(incremental.batch_writer(config, str(tmp_path / "out"), to_graph)).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    model = incremental.read(spark, config, str(tmp_path / "out"))
    key = lambda m: {(r["level"], r["cid"], r["n"], round(r["mean"], 6), round(r["msd"], 1)) for r in m.classes.collect()}
    assert key(model) == key(Model.fit(config, to_graph(events)))
    assert model.whole.first()["n"] == 1000
