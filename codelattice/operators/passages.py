"""Documents to overlapping token windows, and dense passage ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.text import assemble, tokens, window_starts
from codelattice.session import write_scratch

#: Encodes a list of texts to lists of tokens, and joins tokens to a text.
Tokenizer = tuple[Callable[[list[str]], list[list]], Callable[[list], str]]


def passages(documents: DataFrame, key: str, bodies: list[str], *, title: str | None = None, length: int = 180, stride: int = 90, lower: bool = False, tokenizer: Tokenizer | None = None) -> DataFrame:
    """``doc_id`` (as text), ``chunk_idx``, ``passage_id``, ``n_tokens``, ``text`` of each window; a document without tokens has none.

    The built-in tokenizer stays within Catalyst; another one runs in Arrow batches.
    """
    if length < 1 or stride < 1:
        raise ValueError("length and stride must be at least 1")
    text = assemble(F.col(title) if title else None, [F.col(b) for b in bodies], lower=lower, collapse=tokenizer is not None)
    rows = documents.select(F.col(key).cast("string").alias("doc_id"), text.alias("text"))
    if tokenizer is None:
        rows = rows.select("doc_id", tokens(F.col("text")).alias("t"))
        cut = rows.select("doc_id", "t", F.posexplode(window_starts(F.size("t"), stride)).alias("chunk_idx", "s"))
        part = F.slice("t", F.col("s") + 1, F.lit(length))
        cut = cut.select("doc_id", F.col("chunk_idx").cast("long"), F.size(part).alias("n_tokens"), F.array_join(part, " ").alias("text"))
    else:
        encode, decode = tokenizer

        def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(d, i, len(ids[s : s + length]), decode(ids[s : s + length])) for d, ids in zip(b["doc_id"], encode(b["text"].tolist()), strict=True) for i, s in enumerate(range(0, len(ids), stride))]
                yield pd.DataFrame(out, columns=["doc_id", "chunk_idx", "n_tokens", "text"])

        cut = rows.mapInPandas(windows, "doc_id string, chunk_idx long, n_tokens int, text string")
    return cut.withColumn("passage_id", F.concat_ws("_", "doc_id", F.col("chunk_idx").cast("string")))


def dense_ids(df: DataFrame, order: list[str], name: str = "pid") -> DataFrame:
    """Numbers 0, 1, 2, ... in the order of ``order`` (which must be unique): one shuffle into ranges, whose rows are numbered as they are
    written, and the numbers of rows in the ranges before, a row for each partition."""
    inner = F.monotonically_increasing_id()  # the partition in the upper bits, the row within it in the lower 33
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    kept = write_scratch(ranged.select("*", F.shiftrightunsigned(inner, 33).cast("int").alias("_part"), inner.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")))
    counts = kept.groupBy("_part").count().select("_part", (F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    return kept.join(F.broadcast(counts), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_before", "_row")


def rank_batches(df: DataFrame, order: list[str], ranks: int, size: int) -> DataFrame:
    """``rank`` and ``batch`` of each row: rows in order go to the ranks in turn, and each rank takes ``size`` of its rows at once.

    Spark's partitions and Arrow batches do this by themselves; this is for handing the work to something else.
    """
    if ranks < 1 or size < 1:
        raise ValueError("ranks and size must be at least 1")
    numbered = dense_ids(df, order, "_n")
    return numbered.withColumn("rank", (F.col("_n") % ranks).cast("int")).withColumn("batch", F.expr(f"_n div {ranks} div {size}")).drop("_n")
