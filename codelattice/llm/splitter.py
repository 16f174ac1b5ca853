"""Splitting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.units import TOKEN, rows_of

PARAGRAPH, SENTENCE, NONE = 0, 1, 2
_CLOSERS = "\"'”’»)]"
_ENDS = re.compile(r"[.!?…][\"'”’»)\]]*\Z")


def boundaries(text: str) -> tuple[list[int], list[int], np.ndarray]:
    """Starts and ends of the words, and for each position b in 0..n the kind of the boundary before word b."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    kind = np.full(len(spans) + 1, NONE, np.int64)
    for b in range(1, len(spans)):
        left, right = spans[b - 1][1], spans[b][0]
        if text.count("\n", left, right) >= 2:
            kind[b] = PARAGRAPH
        elif _ENDS.search(text, spans[b - 1][0], left):
            kind[b] = SENTENCE
    return [a for a, _ in spans], [b for _, b in spans], kind


def cut(kind: np.ndarray, most: int, least: int, overlap: int, penalties: tuple[float, float, float] | None = None, balance: float = 1.0) -> list[tuple[int, int]]:
    """First and last word of each piece, by dynamic programming over the boundary positions.

    A piece from word a ends before a word b with a + least < b <= a + most, and the next one starts at b - overlap; when at most
    ``most`` words remain, the piece is the last. The value of a start is the cost of the cheapest way to cut what remains: the least, over
    the boundaries b of its window, of the cut's penalty, the imbalance of the piece, and the value of b - overlap times ``discount``.

    ``penalties``: costs of a cut at a paragraph, sentence or other boundary; ``balance`` is the cost of an empty piece, in
    square of the part of ``most`` that a piece lacks; there is no discount, so the least total wins; of equal totals the longer first piece.
    None: a cut's cost is its kind of boundary first, then the words the piece lacks, as one integer below c, and the discount is 1 / (c + 1):
    all later cuts together weigh less than the least difference of one. This is the order in which costs are compared cut by cut.
    """
    n = len(kind) - 1
    if n <= 0:
        return []
    step = most - least
    lacking = np.arange(step - 1, -1, -1)
    value, best = np.zeros(n + 1), np.zeros(n + 1, np.int64)
    if penalties is None:
        price, lack, discount = kind * float(step), lacking.astype(float), 1 / (3 * step + 1)
    else:
        price, lack, discount = np.asarray(penalties, float)[kind], balance * (lacking / most) ** 2, 1.0
        tail = np.arange(max(0, n - most), n)
        value[tail] = balance * ((most - (n - tail)) / most) ** 2
    # starts closer to each other than the least piece without its overlap don't depend on each other: they are solved together
    block = least + 1 - overlap
    for stop in range(n - most, 0, -block):
        first = max(0, stop - block)
        ends = np.arange(first, stop)[:, None] + np.arange(least + 1, most + 1)
        cost = price[ends] + lack + discount * value[ends - overlap]
        k = step - 1 - cost[:, ::-1].argmin(1)
        value[first:stop], best[first:stop] = cost[np.arange(stop - first), k], np.arange(first, stop) + least + 1 + k
    pieces, a = [], 0
    while n - a > most:
        pieces.append((a, int(best[a]) - 1))
        a = int(best[a]) - overlap
    return [*pieces, (a, n - 1)]


def split_oversized(
    df: DataFrame, key: str, text: str, *, most: int = 200, least: int = 100, overlap: int = 20, penalties: tuple[float, float, float] | None = None, balance: float = 1.0, with_text: bool = True
) -> DataFrame:
    """The pieces of every text of more than ``most`` words: ``key``, ``piece_no``, ``first_word``, ``last_word`` and ``piece``.

    A word is a maximal run of characters that are not white space (Unicode's White_Space). Texts of at most ``most`` words,
    null, empty and blank ones have no rows. Repeated rows (same key and text) give their pieces once; different texts of one
    key each give theirs. A null key is kept. A single word is never cut, however long it is. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    if not 0 <= overlap <= least < most:
        raise ValueError("0 <= overlap <= least < most is needed")
    kind = df.schema[key].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in rows_of(batches):
            rows, numbers, firsts, lasts, cuts = [], [], [], [], []
            for i, t in enumerate(texts):
                if len(TOKEN.findall(t)) <= most:
                    continue
                starts, ends, kinds = boundaries(t)
                for k, (a, b) in enumerate(cut(kinds, most, least, overlap, penalties, balance)):
                    rows.append(i)
                    numbers.append(k)
                    firsts.append(a)
                    lasts.append(b)
                    cuts.append(t[starts[a] : ends[b]] if with_text else None)
            if rows:
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), pa.array(numbers, pa.int32()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32()), pa.array(cuts, pa.string())], [key, "piece_no", "first_word", "last_word", "piece"])

    # a text of more than n words has more than 2n characters
    long_enough = df.where(F.length(text) > 2 * most).select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    out = long_enough.mapInArrow(pieces, f"`{key}` {kind}, piece_no int, first_word int, last_word int, piece string").distinct()
    return out if with_text else out.drop("piece")


def latest_tags(mapping: DataFrame, key: str = "pid", tag: str = "original_docid_chunkidx", at: str = "written_at") -> DataFrame:
    """The tag of the latest row of each key (of equally late ones the greatest tag), and its docid: the tag without its last ``_`` and what follows; empty when the tag has no ``_`` or is null."""
    held = mapping.groupBy(F.col(key).alias(key)).agg(F.max(F.struct(F.col(at), F.col(tag))).alias("h"))
    return held.select(key, F.col(f"h.{tag}").alias("tag"), F.coalesce(F.regexp_replace(F.col(f"h.{tag}"), "(?s)_?[^_]*\\z", ""), F.lit("")).alias("docid"))


def traced_pieces(passages: DataFrame, mapping: DataFrame, **options) -> DataFrame:
    """The pieces of oversized passages with the docid of their pid, empty when the mapping has no row of it."""
    pieces = split_oversized(passages, "pid", "passage_text", **options)
    return pieces.join(latest_tags(mapping).select("pid", "docid"), "pid", "left").withColumn("docid", F.coalesce("docid", F.lit("")))
