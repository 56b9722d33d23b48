"""Bundles that arrive in a folder, kept up to date in the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from carepath.operators import graph
from carepath.sources import fhir, store


def keep_graphs(spark: SparkSession, root: str, nodes_path: str, edges_path: str, checkpoint: str) -> StreamingQuery:
    """Starts a stream: each batch of new files replaces its patients' nodes and edges.

    A batch that runs again after a failure replaces the same patients with the same rows.
    """
    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(root)

    def put(batch: DataFrame, epoch: int) -> None:
        if batch.isEmpty():
            return
        rows = fhir.entries(batch).persist()  # every typed table reads them
        store.replace_patients(graph.nodes(fhir.records(rows)), nodes_path)
        touched = rows.select(F.col("source").alias("patient")).distinct()
        n = spark.read.parquet(nodes_path).drop("part").join(touched, "patient", "left_semi")
        store.replace_patients(graph.edges(n).unionByName(graph.precedes(graph.series(n, graph.same_measurement(n)), n)), edges_path)
        rows.unpersist()

    return arrived.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
