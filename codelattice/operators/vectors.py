"""Products of vectors with a codebook, in Arrow blocks, and as expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a codebook block, of which a worker holds one at a time, and of a whole codebook, beyond which it is refused.
BLOCK_BYTES, CODEBOOK_BYTES = 64 << 20, 8 << 30
#: Vectors that are compared with a codebook of several blocks at once: each block is loaded once for so many.
PASS_ROWS = 65_536


def dot(a: Column, b: Column) -> Column:
    """Inner product as an expression, for codebooks of a few rows."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of numbers as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if n and flat.size % n:
        raise ValueError("vectors of different lengths")
    return flat.reshape(n, -1).astype(np.float64)


class Codebook:
    """A codebook (cid, v, and ``by``: several codebooks) as broadcast blocks of bounded size, each by codebook: cids ascending, and vectors.

    The driver holds one block at a time while it fetches them, once; hand the same object to whatever needs the codebook. Workers hold one block
    at a time, too. Vectors are kept as they are stored (32-bit floats if that is their type); products are taken in doubles.
    """

    def __init__(self, centroids: DataFrame, by: str | None = None):
        self.by, self.spark = by, centroids.sparkSession
        row = centroids.agg(F.count("*"), F.max(F.size("v")), F.max("cid")).first()
        self.rows, self.dim = row[0], row[1] or 0
        double = centroids.schema["v"].dataType.elementType.simpleString() != "float"
        size = self.rows * self.dim * (8 if double else 4)
        if size > CODEBOOK_BYTES:
            raise ValueError(f"a codebook of {size} bytes; at most {CODEBOOK_BYTES} can be used")
        n = max(1, -(-size // BLOCK_BYTES))
        cut = centroids.select("cid", "v", (F.col(by) if by else F.lit("")).alias("b"))
        self.blocks = []
        for k in range(n if self.rows else 0):
            got = (cut.where(F.pmod("cid", F.lit(n)) == k) if n > 1 else cut).toArrow()
            names, cids, v = got["b"].to_pylist(), got["cid"].to_numpy(), matrix(got["v"]).astype(np.float64 if double else np.float32)
            block = {}
            for name in sorted({x for x in names if x is not None}):
                at = np.array([i for i, x in enumerate(names) if x == name]) if by else np.arange(len(names))
                at = at[np.argsort(cids[at])]
                block[name] = cids[at], v[at]
            self.blocks.append(self.spark.sparkContext.broadcast(block))

    def load(self) -> Iterator[dict]:
        """The blocks one after the other; each is let go before the next one is loaded, unless there is only one."""
        for b in self.blocks:
            yield b.value
            if len(self.blocks) > 1:
                b.__dict__.pop("_value", None)

    def vectors(self, cids: np.ndarray, name: str = "") -> np.ndarray:
        """The vectors of ``cids`` (ascending, without repeats), gathered from all blocks."""
        out = np.zeros((len(cids), self.dim))
        for block in self.load():
            own, c = block.get(name, (np.zeros(0, np.int64), np.zeros((0, self.dim))))
            if len(own):
                at = np.minimum(np.searchsorted(own, cids), len(own) - 1)
                hit = own[at] == cids
                out[hit] = c[at[hit]]
        return out

    def __getstate__(self):
        return {"by": self.by, "rows": self.rows, "dim": self.dim, "blocks": self.blocks}


def as_codebook(centroids: DataFrame | Codebook, by: str | None = None) -> Codebook:
    return centroids if isinstance(centroids, Codebook) else Codebook(centroids, by)


def top_of_block(v: np.ndarray, cids: np.ndarray, c: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``n`` best scores of each row of ``v`` and their cids, best first; equal ones (after rounding to 9 decimals) by cid."""
    s = np.round(v @ c.T.astype(np.float64), 9)
    k = min(n, len(cids))
    i = np.arange(len(v))[:, None]
    if k == 1:
        top = s.argmax(1)[:, None]
    elif k == len(cids):
        top = np.argsort(-s, axis=1, kind="stable")
    else:
        # whatever is above the k-th score is in; of what equals it, the first ones
        kth = np.partition(s, len(cids) - k, axis=1)[:, len(cids) - k][:, None]
        over, even = s > kth, s == kth
        chosen = over | (even & (np.cumsum(even, axis=1) <= k - over.sum(1, keepdims=True)))
        top = np.nonzero(chosen)[1].reshape(len(v), k)
        top = np.take_along_axis(top, np.argsort(-s[i, top], axis=1, kind="stable"), 1)
    return s[i, top], cids[top]


def best_centroids(vectors: DataFrame, centroids: DataFrame | Codebook, keys: list[str], n: int = 1, *, by: str | None = None) -> DataFrame:
    """The ``n`` centroids of the largest inner product with each vector (``v``): ``keys``, ``cid``, ``score``, ``norm2`` (v · v), ``rank``.

    Equal products (after rounding to 9 decimals) go to the smaller cid. With ``by``, only centroids of the vector's own codebook.
    The vectors are read once, however many blocks the codebook has: each worker keeps the best so far of some vectors and goes through the blocks.
    """
    spark, book = vectors.sparkSession, as_codebook(centroids, by)
    fields = [f"`{k}` {vectors.schema[k].dataType.simpleString()}" for k in keys]
    out = ", ".join([*fields, "cid int, score double, norm2 double, rank int"])
    if not book.blocks:
        return spark.createDataFrame([], out)

    def rows_of(t: pa.Table) -> Iterator[pa.RecordBatch]:
        names = t[len(keys) + 1].to_pylist() if by else [""] * len(t)
        groups: dict[str, list[int]] = {}
        for i, x in enumerate(names):
            groups.setdefault(x, []).append(i)
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        v = {x: matrix(t[len(keys)].take(pa.array(r))) for x, r in groups.items() if x is not None}
        for block in book.load():
            for x in v.keys() & block.keys():
                cids, c = block[x]
                per = max(64, (1 << 23) // max(1, len(cids)))
                parts = [top_of_block(v[x][a : a + per], cids, c, n) for a in range(0, len(v[x]), per)]
                s, who = (np.concatenate(p) for p in zip(*parts, strict=True))
                if x in held:
                    s, who = np.concatenate((held[x][0], s), 1), np.concatenate((held[x][1], who), 1)
                    order = np.lexsort((who, -s), axis=1)[:, :n]
                    s, who = np.take_along_axis(s, order, 1), np.take_along_axis(who, order, 1)
                held[x] = s, who
        for x, (s, who) in held.items():
            k = s.shape[1]
            at = np.repeat(np.arange(len(s)), k)
            cols = t.select(list(range(len(keys)))).take(pa.array(np.array(groups[x])[at])).combine_chunks()
            norm2 = np.einsum("ij,ij->i", v[x], v[x])
            yield from pa.table([*cols.columns, pa.array(who.ravel(), pa.int32()), pa.array(s.ravel()), pa.array(norm2[at]), pa.array(np.tile(np.arange(1, k + 1), len(s)), pa.int32())], [*keys, "cid", "score", "norm2", "rank"]).to_batches()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, rows = [], 0
        for b in batches:
            waiting.append(b)
            rows += b.num_rows
            if rows >= (PASS_ROWS if len(book.blocks) > 1 else 1):
                yield from rows_of(pa.Table.from_batches(waiting))
                waiting, rows = [], 0
        if rows:
            yield from rows_of(pa.Table.from_batches(waiting))

    return vectors.select(*keys, "v", *([by] if by else [])).mapInArrow(score, out)


def all_scores(vectors: DataFrame, centroids: DataFrame | Codebook, keys: list[str]) -> DataFrame:
    """The inner product of every vector with every centroid: ``keys``, ``cid``, ``score``. As many rows as both together multiply to."""
    book = as_codebook(centroids)
    return best_centroids(vectors, book, keys, max(1, book.rows)).select(*keys, "cid", "score")
