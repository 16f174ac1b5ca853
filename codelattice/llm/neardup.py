"""Near-duplicate texts: tensored minhash banding, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.units import Hashes, lists, mixed, rotated, rows_of, words_of
from codelattice.operators.components import connected_components
from codelattice.session import hint_small, write_scratch

_hashes = Hashes()


class Shingles:
    """Of a batch of texts, those with enough words: their row numbers, word sequence hashes and shingle hashes."""

    def __init__(self, texts: list[str | None], width: int, least_words: int):
        words, rows, sizes = [], [], []
        for i, t in enumerate(texts):
            if t:
                own = words_of(t)
                if len(own) >= max(least_words, width):
                    words += own
                    rows.append(i)
                    sizes.append(len(own))
        h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
        self.rows, n = np.array(rows, np.int32), np.array(sizes, np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        with np.errstate(over="ignore"):
            s = h[: len(h) - width + 1] if len(h) else h
            for k in range(1, width):
                s = mixed(rotated(s, 23) + h[k : len(h) - width + 1 + k])
            # shingles over the seam of two texts are left out
            inside = np.ones(len(s), bool)
            for k in range(1, width):
                at = ends - k
                inside[at[at < len(s)]] = False
            self.hashes = s[inside]
            self.sizes = n - width + 1
            self.starts = np.cumsum(self.sizes) - self.sizes
            # the sequence of words: order matters, as each word is mixed with its place
            place = np.arange(len(h)) - np.repeat(starts, n)
            self.sequence = np.add.reduceat(mixed(h + mixed(place.astype(np.uint64))), starts).view(np.int64) if len(n) else np.zeros(0, np.int64)

    def minima(self, count: int, seed: int = 1) -> np.ndarray:
        """Minhash values of 32 bits, one row for each of ``count`` functions."""
        rng = np.random.default_rng(seed)
        factors = rng.integers(0, 2**63, count, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        out = np.empty((count, len(self.rows)), np.uint32)
        for i, f in enumerate(factors):
            v = self.hashes ^ (self.hashes >> np.uint64(32))
            out[i] = np.minimum.reduceat(((v * f) >> np.uint64(32)).astype(np.uint32), self.starts)
        return out


def collection(m: np.ndarray) -> np.ndarray:
    """Keys of 64 bits from every two minhash values, a row for each key."""
    with np.errstate(over="ignore"):
        pairs = mixed((m[0::2].astype(np.uint64) << np.uint64(32)) | m[1::2]) + mixed(np.arange(1, len(m) // 2 + 1, dtype=np.uint64))[:, None]
        return mixed(pairs).view(np.int64)


def paired(table: DataFrame) -> DataFrame:
    """Every two classes (a < b) of a bucket."""
    return table.withColumnRenamed("class", "a").join(table.select("bucket", F.col("class").alias("b")), "bucket").where("a < b").select("a", "b")


def near_duplicates(df: DataFrame, key: str, text: str, *, threshold: tuple[int, int] = (4, 5), width: int = 5, least_words: int = 20, items: int = 16, bucket: int = 128, prefilter: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sequences, and all pairs of classes whose shingle sets have a Jaccard similarity of at least ``threshold``.

    Returns ``members`` (class, ``key``) with one row for each distinct class and key, and ``links`` (a, b, shared, together) with a < b:
    the classes, the number of shingles in both and in at least one. A class is the 64-bit hash of its sequence of words, so texts
    that differ only in what separates their words or in case are one class, however many rows it has.

    A word is a maximal run of letters and digits, lower-cased; shingles are sequences of ``width`` words. Texts with fewer than
    ``least_words`` words, null, empty and blank ones and rows with a null key take no part. Repeated rows (same key and text) count
    once; different texts of one key each count. An empty table gives empty results. Other columns are ignored, whatever their names.

    Method: two collections A and B of ``items`` keys, each of two minhash values. Every pair (A_i, B_j) is a table, ``items`` squared tables
    from ``4 * items`` minhashes instead of ``4 * items ** 2``. Two classes are candidates if they share the key of a table. The tables are
    formed where they matter: classes are brought together by their A keys, each class once, and an A key that more than ``bucket`` classes have is
    replaced by its tensored keys (A_i, B_j); where as many share one of these, too, they are joined in blocks, each with each. In smaller
    A buckets the B keys are compared pair by pair. A pair of similarity s is missed with a probability of at most
    2 * (1 - s^2)^items. All the minhash values then estimate the similarity, and pairs more than 3.5 standard deviations below the
    threshold are dropped (``prefilter`` sets that bound, 0 for none). What is left is verified on the exact shingle sets.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    half = 2 * items
    share = threshold[0] / threshold[1]
    bound = max(0.0, share - 3.5 * (share * (1 - share) / (2 * half)) ** 0.5) if prefilter is None else prefilter

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task need no second sketch
        for part, texts in rows_of(batches):
            x = Shingles(texts, width, least_words)
            if not len(x.rows):
                continue
            m = x.minima(2 * half)
            keys = collection(m[:half]).T
            sig = np.ascontiguousarray((m & np.uint32(255)).astype(np.uint8).T)
            new = np.zeros(len(x.rows), bool)
            for i, c in enumerate(x.sequence.tolist()):
                if c not in seen:
                    seen.add(c)
                    new[i] = True
            mask = pa.array(~new)
            offsets = np.concatenate(([0], np.cumsum(np.where(new, items, 0))))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(x.rows)),
                    pa.array(x.sequence, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[new].ravel(), pa.int64()), mask=mask),
                    pa.array([s.tobytes() if ok else None for s, ok in zip(sig, new, strict=True)], pa.binary()),
                ],
                ["key", "class", "keys", "sig"],
            )

    rows = df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).where(F.col("_k").isNotNull() & (F.length("_t") >= 2 * least_words - 1))
    base = write_scratch(rows.mapInArrow(sketch, f"key {kind}, class long, keys array<long>, sig binary").withColumn("row", F.monotonically_increasing_id()))
    members = base.select("class", "key").distinct()
    # a class that several tasks have sketched counts once
    several = base.where("keys is not null").groupBy("class").agg(F.sort_array(F.collect_list("row")).alias("r")).where(F.size("r") > 1)
    again = write_scratch(several.select(F.explode(F.slice("r", 2, F.size("r") - 1)).alias("row")))
    once = base.where("keys is not null").join(hint_small(again), "row", "left_anti")

    table = once.select(F.explode("keys").alias("bucket"), "class")
    crowded = write_scratch(table.groupBy("bucket").count().where(F.col("count") > bucket).select("bucket"))
    if crowded.take(1):
        # its tensored keys take the place of a crowded A key
        listed = hint_small(crowded)

        def tensored_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                sig = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, 2 * half)
                with np.errstate(over="ignore"):
                    keys = mixed(collection(sig[:, half:].T).view(np.uint64).T + mixed(b.column(0).to_numpy().view(np.uint64))[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(b.column(1).to_numpy(), items))], ["bucket", "class"])

        wide = once.select(F.explode("keys").alias("bucket"), "class", "sig").join(listed, "bucket").select("bucket", "class", "sig")
        tensored_table = write_scratch(wide.mapInArrow(tensored_keys, "bucket long, class long"))
        sizes = tensored_table.groupBy("bucket").count()
        full = write_scratch(sizes.where(F.col("count") > bucket).select("bucket", F.ceil(F.col("count") / bucket).cast("int").alias("n")))
        pairs = paired(table.join(listed, "bucket", "left_anti"))
        if full.take(1):
            blocks = hint_small(full)
            pairs = pairs.union(paired(tensored_table.join(blocks.select("bucket"), "bucket", "left_anti")))
            own = tensored_table.join(blocks, "bucket").withColumn("part", F.pmod(F.xxhash64("class"), F.col("n")).cast("int"))
            spread = own.select("class", "part", "bucket", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o"))
            pairs = pairs.union(paired(spread.select(F.xxhash64("bucket", F.least("part", "o"), F.greatest("part", "o")).alias("bucket"), "class")))
        else:
            pairs = pairs.union(paired(tensored_table))
    else:
        pairs = paired(table)
    pairs = pairs.distinct()
    sigs = once.select("class", "sig")
    pairs = pairs.join(sigs.select(F.col("class").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("class").alias("b"), F.col("sig").alias("sig_b")), "b")

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(b.num_rows, 2 * half) for c in (b.column(2), b.column(3)))
            same = x == y
            tensored = (same[:, half::2] & same[:, half + 1 :: 2]).any(1)  # the A key is shared already
            ok = pa.array(tensored & (same.mean(1) >= bound))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["a", "b"])

    candidates = write_scratch(pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(agreeing, "a long, b long"))

    # the texts of the candidates only, one for each class
    needed = candidates.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    speakers = write_scratch(base.groupBy("class").agg(F.min("key").alias("key")).join(needed, "class").select("class", "key"))

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in rows_of(batches):
            x = Shingles(texts, width, least_words)
            own = [np.unique(s) for s in np.split(x.hashes, x.starts[1:])] if len(x.rows) else []
            flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x.sequence, pa.int64()), lists(np.concatenate(([0], np.cumsum([len(o) for o in own]))), pa.array(flat, pa.int64()))], ["class", "set"])

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("_t")).join(hint_small(speakers.select("key").distinct()), "key", "left_semi")
    sets = source.mapInArrow(shingled, "class long, set array<long>").groupBy("class").agg(F.first("set").alias("set"))
    both = candidates.join(sets.select(F.col("class").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("class").alias("b"), F.col("set").alias("set_b")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("shared"), (F.size("set_a") + F.size("set_b")).cast("long").alias("n"))
    links = both.select("a", "b", "shared", (F.col("n") - F.col("shared")).alias("together")).where(F.col("shared") * threshold[1] >= F.col("together") * threshold[0])
    return members.select("class", F.col("key").alias(key)), write_scratch(links)


def pairs_of_keys(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """All pairs of keys within a class or in two linked classes: ``key_a`` < ``key_b``. The result grows as the square of a class."""
    m = members.where(F.col(key).isNotNull()).select("class", F.col(key).alias("k"))
    x, y = m.select(F.col("class").alias("a"), F.col("k").alias("x")), m.select(F.col("class").alias("b"), F.col("k").alias("y"))
    within = x.join(y, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    across = links.select("a", "b").join(x, "a").join(y, "b").where("x != y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return within.union(across).distinct().select(F.col("x").alias(f"{key}_a"), F.col("y").alias(f"{key}_b"))


def classes(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """One row for each key: the class, its smallest key, its size, its number of links to other classes, and the smallest key of its group of linked classes."""
    size = members.groupBy("class").agg(F.min(key).alias("first_key"), F.count("*").alias("copies"))
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    groups = connected_components(links, "a", "b").withColumnRenamed("node", "class")
    about = size.join(ends, "class", "left").join(groups, "class", "left")
    least = about.where("component is not null").groupBy("component").agg(F.min("first_key").alias("group_key"))
    about = about.join(least, "component", "left").withColumn("group_key", F.coalesce("group_key", "first_key"))
    about = about.select("class", F.col("first_key").alias("class_key"), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"), "group_key")
    return members.join(about, "class").drop("class")
