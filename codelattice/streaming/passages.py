"""Passages and postings of documents that keep arriving: the batch expressions on a stream, appended batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelattice.functions.encoders import TokenEncoder, encode
from codelattice.operators.indexing import assignments, postings
from codelattice.operators.passages import dense_ids, passages
from codelattice.sources import sinks


def index_stream(documents: DataFrame, key: str, bodies: list[str], centroids: DataFrame, encoder: TokenEncoder, path: str, *, checkpoint: str, title: str | None = None, length: int = 180, stride: int = 90, weighted: bool = False, once: bool = True) -> StreamingQuery:
    """Appends passages and postings of each micro-batch under ``path``, a folder for each batch, so that a repeated batch replaces its own.

    Passage ids go on from those of the batches before, whose number is kept beside each batch.
    """
    cut = passages(documents, key, bodies, title=title, length=length, stride=stride)

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        start, before = 0, number - 1
        while before >= 0 and (text := sinks.read_text(spark, f"{path}/counts/{before}.txt")) is None:
            before -= 1
        if before >= 0:
            start = int(text)
        rows = dense_ids(batch, ["doc_id", "chunk_idx"]).withColumn("pid", F.col("pid") + start)
        rows.write.mode("overwrite").parquet(f"{path}/passages/batch={number}")
        kept = spark.read.parquet(f"{path}/passages/batch={number}")
        tokens = encode(kept, "pid", "text", encoder)
        postings(assignments(tokens, centroids, ["pid", "tok"]), weighted=weighted).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        sinks.write_text(spark, f"{path}/counts/{number}.txt", str(start + kept.count()))

    writer = cut.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
