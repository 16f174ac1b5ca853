"""Top N items within every group, from files clustered by group whose row groups are skipped by their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codelattice.session import scratch_path

#: Rows of a file and of a row group of the clustered table.
FILE_ROWS, ROW_GROUP_ROWS = 1_000_000, 4_096


def cluster_by_group(df: DataFrame, group: str, item: str, score: str, *, file_rows: int = FILE_ROWS, row_group_rows: int = ROW_GROUP_ROWS, path: str | None = None) -> str:
    """Write the rows that count, as (g, d, s), clustered by group and descending score, and return the path.

    With a ``path`` of its own the table stays, and :func:`top_n_clustered` answers for any ``n`` from it without another shuffle of the rows.
    The files are ranges of (group, score descending, item), so a group that holds a third of all rows is spread over many
    files, and of these only the first row group can hold rows of its top N.
    Rows with a null group, item or score or a NaN score don't count.
    """
    spark = df.sparkSession
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("d"), (F.col(score).cast("double") + F.lit(0.0)).alias("s"))
    rows = rows.where("g is not null and d is not null and s is not null and not isnan(s)")
    parts = max(spark.sparkContext.defaultParallelism, -(-df.count() // file_rows))
    path = path or scratch_path(spark)
    order = [F.col("g"), F.col("s").desc(), F.col("d")]
    (
        rows.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .write.option("parquet.block.row.count.limit", row_group_rows)  # row groups by rows, not by bytes
        .option("parquet.page.row.count.limit", row_group_rows)
        .option("compression", "zstd")
        .parquet(path)
    )
    return path


def _open(path: str):
    """A Parquet file on any file system that pyarrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return pq.ParquetFile(path.removeprefix("file:").removeprefix("//"))
    where, name = fs.FileSystem.from_uri("s3://" + path.removeprefix("s3a://") if path.startswith("s3a://") else path)
    return pq.ParquetFile(where.open_input_file(name))


def top_of_file(path: str, n: int, counts: dict[str, int] | None = None) -> Iterator[pa.RecordBatch]:
    """The top ``n`` of each group within one clustered file.

    Row groups are taken in descending maximum score. One that holds a single group is skipped if that group already has
    ``n`` items and the row group's maximum is strictly below the n-th score; equal scores are read, as the tie rule may
    prefer them. Which groups a row group with several holds isn't in its statistics: it is read.
    """
    f = _open(path)
    meta = f.metadata
    stats = []
    for k in range(meta.num_row_groups):
        g, s = meta.row_group(k).column(0).statistics, meta.row_group(k).column(2).statistics
        exact = g is not None and s is not None and g.has_min_max and s.has_min_max
        stats.append((k, g.min if exact else None, g.max if exact else "", s.max if exact else float("inf")))
    best: dict[str, dict[str, float]] = {}  # of groups that may go on in another row group
    floor: dict[str, float] = {}
    edges = {x for _, lo, hi, _ in stats for x in (lo, hi)}
    for k, lo, hi, most in sorted(stats, key=lambda x: (-x[3], x[0])):
        if counts is not None:
            counts["seen"] = counts.get("seen", 0) + 1
        if lo == hi and most < floor.get(lo, float("-inf")):
            if counts is not None:
                counts["skipped"] = counts.get("skipped", 0) + 1
            continue
        t = f.read_row_group(k)
        # rows are ordered by group, score descending and item: of equal pairs of group and item, the first has the highest score
        t = t.append_column("i", pa.array(range(len(t)), pa.int32()))
        first = t.group_by(["g", "d"], use_threads=False).aggregate([("i", "min"), ("s", "max")]).sort_by("i_min")
        first = first.combine_chunks()
        codes = pc.dictionary_encode(first["g"].chunk(0)).indices.to_numpy()  # in order of appearance
        sizes = np.bincount(codes)
        rank = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        first = first.filter(pa.array(rank < n)).select(["g", "d", "s_max"]).rename_columns(["g", "d", "s"])
        at_edge = pa.array(np.ones(len(first), bool)) if None in edges else pc.is_in(first["g"], value_set=pa.array(sorted(edges), pa.string()))
        open_rows = first.filter(at_edge).to_pydict()
        for g, d, s in zip(open_rows["g"], open_rows["d"], open_rows["s"], strict=True):
            own = best.setdefault(g, {})
            own[d] = max(s, own.get(d, s))
        for g in {*open_rows["g"]}:
            kept = sorted(best[g].items(), key=lambda x: (-x[1], x[0]))[:n]
            best[g] = dict(kept)
            if len(kept) == n:
                floor[g] = kept[-1][1]
        yield from first.filter(pc.invert(at_edge)).combine_chunks().to_batches()
    if best:
        rows = [(g, d, s) for g, own in best.items() for d, s in own.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["g", "d", "s"])


def top_n(df: DataFrame, group: str, item: str, score: str, n: int, *, file_rows: int = FILE_ROWS, row_group_rows: int = ROW_GROUP_ROWS) -> DataFrame:
    """The up to ``n`` best items of every group: columns ``group``, ``item``, ``score``, ``rank`` (from 1).

    An item counts once for a group, with its highest score. A higher score is better; of equal ones the item that is smaller
    in byte order comes first. Rows with a null group, item or score or a NaN score don't count; infinite scores do; -0.0 and 0.0
    are equal. Repeated rows change nothing. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    path = cluster_by_group(df, group, item, score, file_rows=file_rows, row_group_rows=row_group_rows)
    return top_n_clustered(df.sparkSession, path, n, group=group, item=item, score=score)


def top_n_clustered(spark: SparkSession, path: str, n: int, *, group: str = "g", item: str = "d", score: str = "s") -> DataFrame:
    """The up to ``n`` best items of every group of a table that :func:`cluster_by_group` wrote; see :func:`top_n`. Only what no statistics rule out is read."""
    if n < 1:
        raise ValueError("n must be at least 1")
    files = spark.read.schema("g string, d string, s double").parquet(path).inputFiles()
    out = "g string, d string, s double"
    if not files:
        best = spark.createDataFrame([], out)
    else:
        names = spark.createDataFrame([(x,) for x in files], "path string").repartition(len(files))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for p in b.column(0).to_pylist():
                    yield from top_of_file(p, n)

        best = names.mapInArrow(read, out)
    # a group whose rows lie in several files has up to n rows of each
    best = best.groupBy("g", "d").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("d")))
    return best.withColumn("rank", rank).where(F.col("rank") <= n).select(F.col("g").alias(group), F.col("d").alias(item), F.col("s").alias(score), "rank")
