"""Usable vectors, packed; and cells of vectors with overlap, in tiles of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.units import lists
from codelattice.session import hint_small, write_scratch

#: A sample of at most so many vectors is fitted on; the driver holds it.
SAMPLE = 65_536
#: A vector in more rows than this is put together to one row before it is placed.
HOT = 1_000
#: A vector in more rows than this counts as repeated; with more than so many rows of repeated vectors, all are put together before they are placed.
COPIES, REPEATED = 4, 100_000
#: Numbers of a block of the matrix of vectors by centres, and flags of one of vectors by cells; these are never held whole.
BLOCK, FLAGS = 1 << 22, 1 << 24


def matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the rows that are usable vectors (``dim`` elements, all finite, not all zero), as float32, and those rows' numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)
    fits = np.flatnonzero((sizes == dim) & ~np.asarray(column.is_null()))
    starts = column.offsets.to_numpy()[:-1][fits]
    x = flat[starts[:, None] + np.arange(dim)] if len(fits) else np.zeros((0, dim), flat.dtype)
    ok = np.isfinite(x).all(1) & (x != 0).any(1)
    return x[ok].astype(np.float32), fits[ok]


def pack(x: np.ndarray) -> list[bytes]:
    """Each vector as bytes, of 16-bit floats where those lose nothing, else of 32-bit ones. -0.0 becomes 0.0."""
    x = x + np.float32(0)
    with np.errstate(over="ignore"):
        short = x.astype(np.float16)
    exact = (short.astype(np.float32) == x).all(1)
    return [s.tobytes() if ok else f.tobytes() for s, f, ok in zip(short, x, exact, strict=True)]


def unpack(packed: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(packed), dim))
    short = np.array([len(b) == 2 * dim for b in packed], bool)
    if short.any():
        out[short] = np.frombuffer(b"".join(b for b in packed if len(b) == 2 * dim), np.float16).reshape(-1, dim)
    if not short.all():
        out[~short] = np.frombuffer(b"".join(b for b in packed if len(b) != 2 * dim), np.float32).reshape(-1, dim)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very small or large numbers neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def names(packed: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b) for b in packed], np.uint64).view(np.int64)


def usable(vector: str, dim: int) -> Column:
    """Whether a column of arrays holds a usable vector, as :func:`matrix` has it; JVM-side, without a function for each element."""
    v = F.col(vector)
    most, least, inf = F.array_max(v), F.array_min(v), F.lit(float("inf"))
    return (F.size(v) == dim) & (F.size(F.array_compact(v)) == dim) & (most < inf) & (least > -inf) & ((most != 0) | (least != 0))


def survey(base: DataFrame, dim: int, hot: int | None = None) -> tuple[int, DataFrame | None]:
    """Of rows (id, v): how many distinct usable vectors there are, and the names (``name``: xxhash64 of v) of those in more than ``hot`` rows, if any.

    Rows are counted by a 64-bit hash of the vector, combined before anything is shuffled, so a vector in a third of all rows is one count of each task.
    """
    return surveyed(base, dim, hot)[:2]


def surveyed(base: DataFrame, dim: int, hot: int | None = None) -> tuple[int, DataFrame | None, bool]:
    """What :func:`survey` gives, and whether so many rows are of vectors repeated up to ``hot`` times that :func:`collapsed` is worth its shuffle."""
    hot = HOT if hot is None else hot
    counts = base.where(usable("v", dim)).select(F.xxhash64("v").alias("name")).groupBy("name").count()
    n = F.col("count")
    distinct, many, repeated = counts.agg(F.count("*"), F.count_if(n > hot), F.sum(F.when((n > COPIES) & (n <= hot), n))).first()
    return distinct, write_scratch(counts.where(n > hot).select("name")) if many else None, (repeated or 0) > REPEATED


def split_hot(base: DataFrame, hot: DataFrame | None, ids: int, dim: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows (id, v) of other than hot vectors, and of each hot one a single row (ids, v) with its ``ids`` smallest ids."""
    if hot is None:
        return base, None
    names, named = hint_small(hot), base.withColumn("name", F.xxhash64("v"))
    own = named.where(usable("v", dim)).join(names, "name")
    rank = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    few = own.select("name", "id").distinct().withColumn("r", rank).where(F.col("r") <= ids).groupBy("name").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    one = own.groupBy("name").agg(F.first("v").alias("v"))
    return named.join(names, "name", "left_anti").select("id", "v"), few.join(one, "name").select("ids", "v")


def collapsed(rows: DataFrame, dim: int, ids: int | None = None) -> DataFrame:
    """Of rows (id, v) one row (name, ids, x) for each usable vector: the vector packed, with all its ids or the ``ids`` smallest, in order.

    A tile is sized by distinct vectors; without this, it would get a row for each copy that is in another batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, at = matrix(b.column(1), dim)
            own: dict[bytes, set[int]] = {}
            for p, i in zip(pack(x), b.column(0).take(pa.array(at)).to_pylist(), strict=True):
                own.setdefault(p, set()).add(i)
            packed, each = [*own], [sorted(i)[:ids] for i in own.values()]
            yield pa.RecordBatch.from_arrays([pa.array(names(packed)), lists(np.concatenate(([0], np.cumsum([len(i) for i in each], dtype=np.int64))), pa.array([y for i in each for y in i], pa.int64())), pa.array(packed, pa.binary())], ["name", "ids", "x"])

    every = F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids"))))
    packed = rows.mapInArrow(run, "name long, ids array<long>, x binary").groupBy("name")
    return packed.agg((F.slice(every, 1, ids) if ids else every).alias("ids"), F.first("x").alias("x"))


def sample_units(base: DataFrame, dim: int, most: int, distinct: int) -> np.ndarray:
    """Unit vectors of the ``most`` distinct usable vectors with the smallest hashes (all, if there are fewer); ``distinct`` is how many there are.

    Copies are put together before the choice. Only hashes below a bound that holds ``most`` of them almost surely are sorted; should it
    hold fewer, all are. Whatever is unusable, and however many rows there are, a sample is empty only if no row is usable.
    """
    if distinct < 1:
        return np.zeros((0, dim))

    def smallest(share: float) -> np.ndarray:
        rows = base.select(F.xxhash64("v").alias("h"), "v")
        if share < 1:  # before the dearer test of all elements
            rows = rows.where(F.col("h") < hash_bound(share))
        got = rows.where(usable("v", dim)).groupBy("h").agg(F.first("v").alias("v")).orderBy("h").limit(most).select("v").toArrow()["v"]
        return matrix(got, dim)[0]

    share = (1.3 * most + 200) / distinct
    x = smallest(share)
    if share < 1 and len(x) < min(most, distinct):
        x = smallest(1.0)
    return unit(x) if len(x) else np.zeros((0, dim))


def hash_bound(share: float) -> int:
    """The signed 64-bit integer below which about this share of hashes lies, in integers: exact enough for any number of rows."""
    return -(1 << 63) + max(1, int(share * (1 << 62)) << 2)


def rows_at_once(columns: int) -> int:
    """Vectors taken at once with so many centres."""
    return int(np.clip(BLOCK // max(1, columns), 32, 2048))


def strongest(x: np.ndarray, centres: np.ndarray, rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The centre of the largest product with each vector, and that product, in blocks."""
    rows = rows or rows_at_once(len(centres))
    best, top, c = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32), centres.T.astype(np.float32, copy=False)
    for at in range(0, len(x), rows):
        s = x[at : at + rows].astype(np.float32) @ c
        best[at : at + rows] = s.argmax(1)
        top[at : at + rows] = s[np.arange(len(s)), best[at : at + rows]]
    return best, top


def spherical_means(sample: np.ndarray, k: int, rounds: int = 6, seed: int = 7) -> np.ndarray:
    """``k`` unit vectors in the middle of groups of the sample."""
    p = sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        near, _ = strongest(sample, p)
        sums = np.zeros_like(p)
        np.add.at(sums, near, sample)
        norm = np.sqrt((sums**2).sum(1))
        p = np.where((norm > 0)[:, None], sums / np.maximum(norm, 1e-12)[:, None], p)
    return p


def leaders(sample: np.ndarray, least: float, seed: int = 5) -> np.ndarray:
    """Members of the sample such that each member has a cosine of at least ``least`` with one of them, and they have less with each other."""
    left, chosen = np.random.default_rng(seed).permutation(len(sample)), []
    x = sample.astype(np.float32)
    while len(left):
        some = left[:128]
        near = x[some] @ x[some].T >= least
        own: list[int] = []
        for i in range(len(some)):
            if not near[i, own].any():
                own.append(i)
        chosen.append(some[own])
        left = left[strongest(x[left], x[some[own]])[1] < np.float32(least)]
    return sample[np.concatenate(chosen)] if chosen else sample[:0]


class Cells:
    """Which cells a unit vector belongs to: ``home`` gets the best one, ``all`` those it is near enough to as well."""

    tiles: np.ndarray  # by cell, into how many blocks its vectors are split

    def scores(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best cell of each vector, and a mask of all its cells."""
        raise NotImplementedError


def packed_evenly(sizes: np.ndarray, bins: int) -> np.ndarray:
    """A bin for each size, so that the bins are of even size."""
    out, load = np.zeros(len(sizes), np.int64), np.zeros(max(1, bins))
    for i in np.argsort(-sizes, kind="stable"):
        out[i] = np.argmin(load)
        load[out[i]] += sizes[i]
    return out


def tile_keys(cells: Cells, names: np.ndarray, home: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each placement of a vector: row, tile (of cell, block of owners, block of points), whether as an owner, whether as a point.

    A cell of one block is one tile. One of b blocks is b * b tiles; a vector is a point of its block's column and an owner in its row.
    """
    return tiles_of(cells, names, home, *np.nonzero(mask))


def tiles_of(cells: Cells, names: np.ndarray, home: np.ndarray, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`tile_keys` of the rows and cells that belong together, without a matrix of all rows by all cells."""
    b = cells.tiles[at]
    one = b == 1
    out = [(rows[one], at[one].astype(np.int64) << np.int64(32), home[rows[one]] == at[one], np.ones(one.sum(), bool))]
    for r, c in zip(rows[~one], at[~one], strict=True):
        n = int(cells.tiles[c])
        own = int(np.uint64(names[r].view(np.uint64)) % np.uint64(n))
        base = np.int64(c) << np.int64(32)
        other = np.arange(n, dtype=np.int64)
        point_in = base | (other << 16) | own
        out.append((np.full(n, r), point_in, (other == own) & (home[r] == c), np.ones(n, bool)))
        if home[r] == c:
            others = other[other != own]
            out.append((np.full(len(others), r), base | (np.int64(own) << 16) | others, np.ones(len(others), bool), np.zeros(len(others), bool)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def grouped(df: DataFrame, key: str, function: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``function`` of each group's rows; groups are tiles, whose size is bounded."""
    return df.groupBy(key).applyInArrow(function, schema)
