"""Sampling, assignment, postings, and the two layouts of the index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.operators.vectors import Codebook, as_codebook, best_centroids, matrix
from codelattice.session import write_scratch


def sample_size(n_passages: int, doclen: float = 120, given: int | None = None) -> int:
    """How many passages to sample: 16 times the root of the number of tokens, or what is given; never more than there are."""
    return min(given if given is not None else 1 + int(16 * math.sqrt(doclen * n_passages)), n_passages)


def sample_exactly(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), those of the smallest md5 of key and seed: the same on every run.

    Only counts of hashes by their first digits reach the driver, until the hash of the n-th row is found among a few; the rows are then
    chosen by a filter, so nothing but rows of one and the same key as the n-th is ever put in order.
    """
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    hashed, prefix, left = df.withColumn("_h", h), "", n
    if n < 1:
        return df.limit(0)
    while len(prefix) < 32:
        within = hashed.where(F.col("_h").startswith(prefix)) if prefix else hashed
        counts = within.groupBy(F.substring("_h", 1, len(prefix) + 3).alias("p")).count().orderBy("p").collect()  # 4,096 rows at most
        for r in counts:
            if r["count"] >= left:
                prefix = r.p
                break
            left -= r["count"]
        else:
            return df  # fewer than n rows in all
        if r["count"] == left:
            return hashed.where(F.substring("_h", 1, len(prefix)) <= prefix).drop("_h")
    before, same = hashed.where(F.col("_h") < prefix), hashed.where(F.col("_h") == prefix)
    return before.union(same.orderBy(key).limit(left)).drop("_h")  # repeated rows of one key


def training_queries(df: DataFrame, text: str, most: int = 8192) -> DataFrame:
    """Texts in ascending order, every (number // most)-th of them: up to about twice ``most`` remain. Columns rank (from 0), text."""
    texts = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    stride = max(1, texts.count() // most)
    if stride == 1:
        return texts.withColumn("rank", F.row_number().over(Window.orderBy("text")) - 1)
    from codelattice.operators.passages import dense_ids

    return dense_ids(texts.withColumn("_u", F.monotonically_increasing_id()), ["text", "_u"], "rank").where(F.col("rank") % stride == 0).select("rank", "text")


def assignments(vectors: DataFrame, centroids: DataFrame | Codebook, keys: list[str], *, by: str | None = None) -> DataFrame:
    """The centroid of each vector, its score, and the weight v · (v - c) + 1."""
    best = best_centroids(vectors, centroids, keys, 1, by=by)
    return best.select(*keys, "cid", "score", (F.col("norm2") - F.col("score") + 1).alias("w"))


def postings(assigned: DataFrame, keys: list[str] | None = None, *, weighted: bool = False) -> DataFrame:
    """(keys, cid, w): each centroid of a passage once; its weight is 1, or the largest of its tokens', and at least -1."""
    keys = keys or ["pid"]
    w = F.max(F.greatest("w", F.lit(-1.0))) if weighted else F.lit(1.0)
    return assigned.groupBy(*keys, "cid").agg(w.alias("w"))


def forward(posts: DataFrame, key: str = "pid") -> DataFrame:
    """One row for each passage: its codes in ascending order of centroid."""
    return posts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("cid", "w"))).alias("codes"))


def inverted(posts: DataFrame, files: int | None = None) -> DataFrame:
    """The postings clustered by centroid, ascending by passage: long form, so that a frequent centroid is no single value."""
    n = [files] if files else []
    return posts.repartitionByRange(*n, "cid", "pid").sortWithinPartitions("cid", "pid")


def inverted_lists(posts: DataFrame, key: str = "pid") -> DataFrame:
    """One row for each centroid with its passages; for codebooks whose lists are known to be short."""
    return posts.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct(key, "w"))).alias("passages"))


def check_dense(df: DataFrame, key: str = "pid") -> int:
    """The number of passages; raises unless their ids are 0 .. n-1, as layouts by position need."""
    low, high, n = df.agg(F.min(key), F.max(key), F.count_distinct(key)).first()
    if n and (low != 0 or high != n - 1):
        raise ValueError(f"passage ids are not dense: {n} of them from {low} to {high}")
    return n


def check_range(posts: DataFrame, n_centroids: int) -> None:
    if posts.where((F.col("cid") < 0) | (F.col("cid") >= n_centroids)).take(1):
        raise ValueError("a centroid id is out of range")


def stats(posts: DataFrame, n_centroids: int) -> DataFrame:
    return posts.agg(F.count_distinct("pid").alias("n_docs"), F.count("*").alias("nnz"), F.lit(n_centroids).cast("long").alias("n_centroids"))


def merge(shards: list[DataFrame], key: str = "pid") -> DataFrame:
    """Union of shards (pid, cid, w); of a passage in several of them the last shard's rows hold."""
    every = None
    for i, s in enumerate(shards):
        part = s.withColumn("_shard", F.lit(i))
        every = part if every is None else every.unionByName(part)
    last = every.groupBy(key).agg(F.max("_shard").alias("_shard"))
    return every.join(last, [key, "_shard"]).drop("_shard")


def code_map(assigned_sets: DataFrame) -> DataFrame:
    """Passages given as arrays of centroid ids (pid, cids) become postings of weight 1."""
    return assigned_sets.select("pid", F.explode(F.array_distinct("cids")).alias("cid")).withColumn("w", F.lit(1.0))


def dead_centroids(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    return centroids.select("cid").join(assigned.select("cid").distinct(), "cid", "left_anti")


def restart_plan(vectors: DataFrame, centroids: DataFrame | Codebook, keys: list[str], queries: np.ndarray, *, by: str | None = None) -> DataFrame:
    """Which vector replaces each centroid that nothing was assigned to: the vectors of the largest error |Q(c - d)|, in turn.

    ``queries`` is the matrix Q, all training queries or a sample, d a vector and c its centroid. Columns: cid, ``keys``, error2 (the square,
    rounded to 6 decimals). Ties go to the smaller key. The errors are made beside the vectors, in one pass; at most as many rows as
    there are dead centroids are ranked.
    """
    book = as_codebook(centroids, by)
    spark = vectors.sparkSession
    given = spark.sparkContext.broadcast(np.asarray(queries, np.float64))
    best = best_centroids(vectors.withColumn("_v", F.col("v")), book, [*keys, "_v"], by=by)
    fields = ", ".join(f"`{k}` {vectors.schema[k].dataType.simpleString()}" for k in keys)

    def error(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                cids = part.column(len(keys) + 1).to_numpy()
                own = np.unique(cids)
                c = np.zeros((len(own), book.dim))
                for name in {x for block in book.blocks for x in block.value}:
                    c += book.vectors(own, name)
                e = (((c[np.searchsorted(own, cids)] - matrix(part.column(len(keys)))) @ given.value.T) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], part.column(len(keys) + 1), pa.array(np.round(e, 6))], [*keys, "cid", "error2"])

    rated = write_scratch(best.select(*keys, "_v", "cid").mapInArrow(error, f"{fields}, cid int, error2 double"))
    used = rated.select("cid").distinct()
    every = centroids.select("cid") if isinstance(centroids, DataFrame) else spark.createDataFrame([(int(c),) for x in book.load() for cids, _ in x.values() for c in cids], "cid int")
    dead = every.join(used, "cid", "left_anti")
    n = dead.count()
    worst = rated.orderBy(F.col("error2").desc(), *keys).limit(n).drop("cid")
    worst = worst.withColumn("r", F.row_number().over(Window.orderBy(F.col("error2").desc(), *keys)))
    return dead.withColumn("r", F.row_number().over(Window.orderBy("cid"))).join(worst, "r").select("cid", *keys, "error2")
