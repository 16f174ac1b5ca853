"""Search: probes, inverted-list scores, padded top-k, rerank by all centroid scores, pooling to documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from codelattice.operators.vectors import Codebook, as_codebook, best_centroids, matrix
from codelattice.session import write_scratch


def probes(queries: DataFrame, centroids: DataFrame | Codebook, nprobe: int) -> DataFrame:
    """(qid, tok, cid, score): the ``nprobe`` best centroids of each query token (qid, tok, v)."""
    return best_centroids(queries, centroids, ["qid", "tok"], nprobe).select("qid", "tok", "cid", "score")


def first_stage(probed: DataFrame, posts: DataFrame, nprobe: int) -> DataFrame:
    """(qid, pid, score) of every passage with a probed centroid: per token the largest weight times score, summed over the tokens.

    A token's maximum includes an implicit 0 unless the passage holds all of the token's probes. One shuffle by (qid, pid) serves both
    group-bys: rows of a token and a passage stem from different centroids, so combining before it would hardly make them fewer.
    """
    hit = probed.join(posts, "cid").select("qid", "tok", "pid", (F.col("w") * F.col("score")).alias("x")).repartition("qid", "pid")
    full = F.count("*") == nprobe
    best = hit.groupBy("qid", "pid", "tok").agg(F.when(full, F.max("x")).otherwise(F.greatest(F.max("x"), F.lit(0.0))).alias("m"))
    return best.groupBy("qid", "pid").agg(F.sum("m").alias("score"))


def top_passages(scored: DataFrame, queries: DataFrame, n_docs: int, topk: int) -> DataFrame:
    """min(topk, n_docs) passages for every query: those without a score count 0, which beats negative ones; ties go to the smaller pid.

    Pids are 0 .. n_docs-1. Among the first topk + m of them at least topk are not among a query's m scored passages, so no more zeros
    are made than that, and none for queries with topk positive scores. The scored passages are gone through once, and their topk of each query kept.
    """
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pid"))
    typed = scored.select("qid", F.col("pid").cast("long"), "score")
    kept = write_scratch(typed.withColumn("rank", rank).where(F.col("rank") <= topk).drop("rank"))

    def counted(rows: DataFrame) -> DataFrame:
        return rows.groupBy("qid").agg(F.count("*").alias("m"), F.sum((F.round("score", 9) > 0).cast("int")).alias("up"))

    if n_docs > topk:  # queries whose topk scores are not all positive may have more of the negative ones, which are no zeros
        negative = write_scratch(counted(kept).where((F.col("m") >= topk) & (F.col("up") < topk)).select("qid"))
        if negative.take(1):
            kept = kept.join(negative, "qid", "left_anti").union(typed.join(negative, "qid", "left_semi"))
    asked = queries.select("qid").distinct().join(counted(kept), "qid", "left").na.fill(0)
    lacking = asked.where(F.col("up") < topk).select("qid", F.explode(F.sequence(F.lit(0), F.least(F.lit(n_docs), F.lit(topk) + F.col("m")) - 1)).alias("pid")) if n_docs else asked.select("qid", F.lit(0).alias("pid")).limit(0)
    zeros = lacking.select("qid", F.col("pid").cast("long")).join(kept.select("qid", "pid"), ["qid", "pid"], "left_anti").withColumn("score", F.lit(0.0))
    return kept.union(zeros).withColumn("rank", rank).where(F.col("rank") <= topk)


def rerank(short: DataFrame, posts: DataFrame, queries: DataFrame, centroids: DataFrame | Codebook) -> DataFrame:
    """(qid, pid, score) of short-listed passages: the sum over tokens of the best score of any of the passage's centroids.

    Weights don't matter, all centroids count (not only probed ones), and there is no floor of 0. Passages without codes drop out.
    ``posts`` is best the layout clustered by passage; only short-listed passages' rows of it are shuffled. Scores are made for the
    centroids of short-listed passages alone, whose vectors each worker gathers from the codebook's blocks.
    """
    book, spark = as_codebook(centroids), short.sparkSession
    out = f"qid {short.schema['qid'].dataType.simpleString()}, pid long, score double"
    if not book.blocks:
        return spark.createDataFrame([], out)
    listed = short.select("qid", F.col("pid").cast("long").alias("pid"))
    codes = posts.select(F.col("pid").cast("long").alias("pid"), "cid").join(listed.select("pid").distinct(), "pid", "left_semi")
    codes = codes.groupBy("pid").agg(F.array_sort(F.collect_set("cid")).alias("cids"))
    # a row for each query, with its short list: its vectors travel once
    asked = queries.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("tok", "v"))).alias("t")).select("qid", F.col("t.v").alias("q"))
    lists = listed.join(codes, "pid").groupBy("qid").agg(F.collect_list(F.struct("pid", "cids")).alias("p"))
    rows = lists.join(asked, "qid").select("qid", "p.pid", "p.cids", "q")

    def scored(part: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Of some queries' short lists, whose centroids are gathered at once."""
        cids, at = np.unique(np.concatenate([flat for _, _, flat, _, _ in part]), return_inverse=True)
        c, done = book.vectors(cids), 0
        for qid, pids, flat, sizes, q in part:
            own, where = np.unique(at[done : done + len(flat)], return_inverse=True)
            done += len(flat)
            s = np.round(q @ c[own].T, 9)
            best = np.maximum.reduceat(s[:, where], np.cumsum(sizes) - sizes, axis=1).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([qid] * len(pids), kind), pids, pa.array(best)], ["qid", "pid", "score"])

    kind = pa.array([], type=to_arrow_type(short.schema["qid"].dataType)).type

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, codes = [], 0
        for b in batches:
            for i in range(b.num_rows):
                own = b.column(2)[i].values
                flat = own.flatten().to_numpy()
                part.append((b.column(0)[i].as_py(), b.column(1)[i].values, flat, np.diff(own.offsets.to_numpy()), matrix(b.column(3)[i].values)))
                codes += len(flat)
                if codes > 200_000:
                    yield from scored(part)
                    part, codes = [], 0
        if part:
            yield from scored(part)

    return rows.mapInArrow(score, out)


def pool(scored: DataFrame, mapping: DataFrame | None, limit: int | None = 100) -> DataFrame:
    """(qid, doc_id, score, rank): a document's score is that of its best passage; the ``limit`` best documents of each query.

    Without a mapping (pid, doc_id), passages are documents. Ties go to the smaller document id.
    """
    rows = scored.join(mapping.select("pid", "doc_id"), "pid") if mapping is not None else scored.withColumn("doc_id", F.col("pid").cast("string"))
    best = rows.groupBy("qid", "doc_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "doc_id")))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def search(queries: DataFrame, centroids: DataFrame | Codebook, posts: DataFrame, n_docs: int, mapping: DataFrame | None = None, *, nprobe: int = 1, topk: int = 1000, use_forward: bool = True, limit: int = 100, forward_posts: DataFrame | None = None) -> DataFrame:
    """The whole search as one plan, for any number of queries. ``posts`` is best clustered by centroid, ``forward_posts`` by passage."""
    book = as_codebook(centroids)
    probed = write_scratch(probes(queries, book, nprobe))  # a few rows for each token of a query, which would be made anew wherever they are needed
    top = top_passages(first_stage(probed, posts, nprobe), queries, n_docs, topk)
    scored = rerank(top, forward_posts if forward_posts is not None else posts, queries, book) if use_forward else top
    return pool(scored.select("qid", "pid", "score"), mapping, limit)
