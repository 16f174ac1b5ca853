"""Evaluation texts leaking into a corpus: latent semantic retrieval, then checks of common runs, subsequences and telling words."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.units import lists, rows_of, words_of
from codelattice.session import write_scratch

#: Test items are collected to the driver and broadcast; more than this many characters of them are refused.
ITEM_CHARS = 50_000_000
#: Words of a passage for the decomposition, and rank of the latent space.
PASSAGE, RANK = 200, 48


def collect_items(items: DataFrame, key: str, text: str) -> list[tuple[int, list[str]]]:
    """Key and words of each item with words; refuses more than ITEM_CHARS characters. Repeated rows count once, null keys not at all."""
    rows = items.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).distinct()
    size = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > ITEM_CHARS:
        raise ValueError(f"the items have {size} characters; at most {ITEM_CHARS} are held by every worker: pass them in parts")
    return sorted((k, w) for k, t in rows.collect() if (w := words_of(t)))


def indexed(documents: DataFrame, key: str, text: str, vocabulary: dict[str, int]) -> DataFrame:
    """``key`` and the sequence of its text's words as numbers of the vocabulary, written to the shared folder; -1 stands for a run of others."""
    kind = documents.schema[key].dataType.simpleString()
    known = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = known.value.get
        for part, texts in rows_of(batches):
            flat, ends = [], [0]
            for t in texts:
                if t:
                    flat.append(np.fromiter(map(get, words_of(t), repeat(-1)), np.int32))
                    own = flat[-1]
                    if len(own) > 1:
                        flat[-1] = own[np.concatenate(([True], (own[1:] >= 0) | (own[:-1] >= 0)))]
                    ends.append(ends[-1] + len(flat[-1]))
                else:
                    ends.append(ends[-1])
            yield pa.RecordBatch.from_arrays([part.column(0), lists(np.array(ends), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)))], ["key", "words"])

    rows = documents.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t"))
    return write_scratch(rows.mapInArrow(index, f"key {kind}, words array<int>"))


def flattened(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a column of lists."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]


def document_counts(words: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary is, and how many documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, docs = np.zeros(size + 1, np.int64), 0
        for b in batches:
            offsets, w = flattened(b.column(0))
            doc = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            pairs = np.unique(doc[w >= 0] * np.int64(size) + w[w >= 0])
            n[:size] += np.bincount(pairs % size, minlength=size)
            docs += b.num_rows
        n[size] = docs
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["w", "n"])

    out = np.zeros(size + 1, np.int64)
    for w, n in words.select("words").mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n")).collect():
        out[w] = n
    return out[:size], int(out[size])


def _passages(w: np.ndarray, offsets: np.ndarray, weights: np.ndarray, length: int, rows: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """TF-IDF rows of unit length of a batch's passages, in blocks of them, sparse: passage (from 0), word and value, in order of both."""
    size = len(weights)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inner = np.arange(len(w)) - offsets[:-1][doc]
    new = np.ones(len(w), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (inner[1:] // length != inner[:-1] // length)
    passage = np.cumsum(new) - 1
    passage, w = passage[w >= 0], w[w >= 0]
    for first in range(0, int(passage[-1]) + 1 if len(w) else 0, rows):
        a, b = np.searchsorted(passage, (first, first + rows))
        if a == b:
            continue
        at, n = np.unique((passage[a:b] - first) * np.int64(size) + w[a:b], return_counts=True)
        p, word = at // size, at % size
        value = n * weights[word]
        norm = np.sqrt(np.bincount(p, value * value, minlength=rows))
        yield p, word, value / np.maximum(norm, 1e-12)[p]


def summed(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur, which are in order, and the sum of each one's rows."""
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(x, first, axis=0)


def gram_times(words: DataFrame, weights: np.ndarray, q: np.ndarray, length: int) -> np.ndarray:
    """(A' A) q for the matrix A of all passages, by one pass over the corpus; rows of A are sparse, so a vocabulary of millions is no matter."""
    given = words.sparkSession.sparkContext.broadcast((weights, q.astype(np.float32)))
    r = q.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, q = given.value
        z = np.zeros(q.shape)
        for b in batches:
            offsets, w = flattened(b.column(0))
            for p, word, value in _passages(w, offsets, weights, length):
                v = value.astype(np.float32)[:, None]
                seen, y = summed(p, v * q[word])
                order = np.argsort(word, kind="stable")
                own, part = summed(word[order], (v * y[np.searchsorted(seen, p)])[order])
                z[own] += part
        at = np.flatnonzero(z.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), lists(np.arange(len(at) + 1) * r, pa.array(z[at].ravel(), pa.float64()))], ["w", "z"])

    sums = words.select("words").mapInArrow(multiply, "w int, z array<double>").groupBy("w").agg(*(F.sum(F.col("z")[i]).alias(f"z{i}") for i in range(r)))
    out = np.zeros(q.shape)
    for row in sums.collect():  # as many rows as the vocabulary of the items has words
        out[row[0]] = row[1:]
    return out


def latent_space(words: DataFrame, size: int, *, rank: int = RANK, passage: int = PASSAGE, rounds: int = 1, seed: int = 3) -> np.ndarray:
    """A vector for each word: its idf times its row of the right singular vectors of the TF-IDF matrix of all passages, by randomised SVD."""
    n, docs = document_counts(words, size)
    weights = np.log((1 + docs) / (1 + n)) + 1
    rank = min(rank, size)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, rank)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(gram_times(words, weights, q, passage) + 1e-9 * q)[0]
    small = q.T @ gram_times(words, weights, q, passage)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    v = q @ turn[:, ::-1]
    return weights[:, None] * v


def whole_numbers(latent: np.ndarray) -> np.ndarray:
    """The vectors as integers: sums over windows are then the same whatever is added first."""
    top = np.abs(latent).max() if latent.size else 0
    return np.round(latent * ((1 << 20) / top if top else 0)).astype(np.int32)


def window_sums(vectors: np.ndarray, w: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The latent vectors of the windows of ``length`` words that start at ``starts``; all words of ``w`` are in the vocabulary."""
    total = np.zeros((len(w) + 1, vectors.shape[1]), np.int32)
    np.cumsum(vectors[w], axis=0, dtype=np.int32, out=total[1:])
    return total[starts + length] - total[starts]  # differences hold even where the sums wrap around


def sign_code(x: np.ndarray) -> np.ndarray:
    bits = np.zeros((len(x), 64), np.uint8)
    bits[:, : min(64, x.shape[1])] = x[:, :64] > 0
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def runs(w: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Positions at which ``length`` words of the vocabulary follow each other within one text; ``ends`` are the ends of texts."""
    if len(w) < length:
        return np.zeros(0, np.int64)
    stop = np.zeros(len(w) + 1, np.int64)
    stop[1:] = np.cumsum(w < 0)
    at = np.arange(len(w) - length + 1)
    fine = stop[at + length] == stop[at]
    text = np.zeros(len(w) + 1, np.int64)
    np.add.at(text, ends[ends < len(w)], 1)
    text = np.cumsum(text)
    return at[fine & (text[at] == text[at + length - 1])]


def leaked(documents: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "item_text", least_words: int = 10, least_cosine: float = 0.999, rank: int = RANK, verify: bool = True) -> DataFrame:
    """Every pair of a document and an item that have at least ``least_words`` consecutive words in common: ``doc_key``, ``item_key``.

    A word is a maximal run of letters and digits, lower-cased. Null, empty and blank texts, items of fewer words and rows with a null
    key have no pairs; repeated rows change nothing; empty tables give no rows; other columns are ignored.

    The latent space is fitted on all documents. The windows of ``least_words`` words of the items are kept by the signs of their latent
    vectors; a document's windows with the same signs and a cosine of at least ``least_cosine`` to one of them are candidates, and a candidate
    holds if the longest common subsequence of both windows is all of their words (with ``verify`` off all candidates hold: what retrieval alone
    gives). Windows of the same words have the same vector to the last bit, so none is missed.
    """
    spark = documents.sparkSession
    kind = documents.schema[doc_key].dataType.simpleString()
    own = [(k, w) for k, w in collect_items(items, item_key, item_text) if len(w) >= least_words]
    out = f"`{doc_key}` {kind}, `{item_key}` long"
    if not own:
        return spark.createDataFrame([], out)
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in own for w in ws}))}
    words = indexed(documents, doc_key, doc_text, vocabulary)
    vectors = whole_numbers(latent_space(words, len(vocabulary), rank=rank))
    sizes = np.array([len(ws) for _, ws in own])
    flat = np.array([vocabulary[w] for _, ws in own for w in ws], np.int32)
    at = runs(flat, np.cumsum(sizes), least_words)  # the items' windows are places in their words; vectors of windows are summed where they are needed
    codes = np.concatenate([sign_code(latent_windows(vectors, flat, at[i : i + 100_000], least_words)) for i in range(0, len(at), 100_000)])
    order = np.argsort(codes, kind="stable")
    number = np.repeat(np.arange(len(own), dtype=np.int32), sizes)[at]
    given = spark.sparkContext.broadcast((vectors, codes[order], flat, at[order], number[order], np.array([k for k, _ in own], np.int64)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, codes, flat, places, number, keys = given.value
        unique, first = np.unique(codes, return_index=True)
        many = np.diff(np.concatenate((first, [len(codes)])))
        for b in batches:
            offsets, w = flattened(b.column(1))
            starts = runs(w, offsets[1:], least_words)
            docs, items = [], []
            for at in range(0, len(starts), 20_000):
                s = starts[at : at + 20_000]
                low = s[0]
                part = w[low : s[-1] + least_words]
                x = window_sums(vectors, np.where(part < 0, 0, part), s - low, least_words)
                c = sign_code(x)
                i = np.minimum(np.searchsorted(unique, c), len(unique) - 1)
                hit = np.flatnonzero(unique[i] == c)
                n = many[i[hit]]
                mine = np.repeat(hit, n)
                other = np.repeat(first[i[hit]], n) + np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
                for a in range(0, len(mine), 50_000):  # in blocks, however many windows share their signs
                    p, q = mine[a : a + 50_000], other[a : a + 50_000]
                    u, v = x[p].astype(np.float64), latent_windows(vectors, flat, places[q], least_words).astype(np.float64)
                    size = np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v))
                    near = np.einsum("ij,ij->i", u, v) >= least_cosine * size - 1e-9 * size
                    p, q = p[near], q[near]
                    if verify:  # a common subsequence as long as both windows: the same words in the same order
                        same = (w[s[p][:, None] + np.arange(least_words)] == flat[places[q][:, None] + np.arange(least_words)]).all(1)
                        p, q = p[same], q[same]
                    docs.append(np.searchsorted(offsets, s[p], "right") - 1)
                    items.append(keys[number[q]])
            if docs:
                pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pairs[0])), pa.array(pairs[1], pa.int64())], [doc_key, item_key])

    return words.mapInArrow(search, out).distinct()


def latent_windows(vectors: np.ndarray, flat: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The latent vectors of the windows at ``places``, word by word: exact as integers, whatever else is summed with them."""
    out = np.zeros((len(places), vectors.shape[1]), np.int32)
    for i in range(length):
        out += vectors[flat[places + i]]
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence: a row of the table is one integer, whose zero bits are its steps."""
    places: dict[int, int] = {}
    for i, x in enumerate(b.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full
    for x in a.tolist():
        if m := places.get(x, 0):
            row = ((row + (row & m)) | (row & ~m)) & full
    return len(b) - row.bit_count()


def window_starts(lengths: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of texts of so many words: its text, and its first word there. The last ones of a text may be cut by its end."""
    n = -(-np.maximum(1, lengths - window // 2) // stride)
    text = np.repeat(np.arange(len(lengths)), n)
    return text, (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * stride


def paraphrased(documents: DataFrame, items: DataFrame, *, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "item_text", window: int = 48, least_words: int = 10, least_cosine: float = 0.8, least_common: float = 0.5, telling: int = 5, least_telling: float = 0.6, rank: int = RANK) -> DataFrame:
    """Documents with a passage that says what an item says: ``doc_key``, ``item_key``, ``cosine`` and ``common`` of their best passage.

    An item is cut in windows of ``window`` words, half overlapping; a shorter item or rest is a window of its own. Passages are windows of
    ``window`` words at a stride of a quarter, of a half for shorter windows of items; these are also compared with passages of their length or up
    to a fifth more at a stride of an eighth, as in a longer passage the words around them would outweigh them. Candidates have a cosine of at least
    ``least_cosine`` in the latent space. They hold if the longest common subsequence covers at least ``least_common`` of the item's window and
    if the passage has at least ``least_telling`` of the item window's ``telling`` rarest words (the answer, as far as a text without marked answers has one).
    Only words of the items' vocabulary take part. Special rows are treated as by :func:`leaked`.
    """
    spark = documents.sparkSession
    kind = documents.schema[doc_key].dataType.simpleString()
    own = [(k, w) for k, w in collect_items(items, item_key, item_text) if len(w) >= least_words]
    out = f"`{doc_key}` {kind}, `{item_key}` long, cosine double, common double"
    if not own:
        return spark.createDataFrame([], out)
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in own for w in ws}))}
    words = indexed(documents, doc_key, doc_text, vocabulary)
    latent = latent_space(words, len(vocabulary), rank=rank)
    n, _ = document_counts(words, len(vocabulary))
    chunks = []
    for k, ws in own:
        ids = np.array([vocabulary[w] for w in ws], np.int32)
        for a in range(0, max(1, len(ids) - window // 2), window // 2):
            part = ids[a : a + window]
            rare = np.unique(part)[np.argsort(n[np.unique(part)], kind="stable")][:telling]
            chunks.append((k, part, rare))
    sums = np.stack([latent[c].sum(0) for _, c, _ in chunks])
    sums /= np.maximum(np.sqrt((sums**2).sum(1)), 1e-12)[:, None]
    sizes = [window]
    while sizes[-1] > least_words:
        sizes.append(max(least_words, sizes[-1] * 5 // 6))
    fits = np.array([min(c for c in sizes if c >= len(part)) for _, part, _ in chunks])
    searched = [(window, max(1, window // 4), np.flatnonzero(fits == window)), (window, window // 2, np.flatnonzero(fits < window))]
    searched = [x for x in searched if len(x[2])]
    searched += [(c, max(1, c // 8), np.flatnonzero(fits == c)) for c in sizes[1:] if (fits == c).any()]
    rarest = np.full((len(chunks), telling), -2, np.int32)  # -2 is no word's number
    for j, (_, _, rare) in enumerate(chunks):
        rarest[j, : len(rare)] = rare
    given = spark.sparkContext.broadcast((whole_numbers(latent), sums.astype(np.float32), chunks, rarest, searched))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums, chunks, rarest, searched = given.value
        needed = least_telling * (rarest >= 0).sum(1)
        for b in batches:
            offsets, w = flattened(b.column(1))
            lengths = np.add.reduceat(np.append(w >= 0, False).astype(np.int64), offsets[:-1]) * (np.diff(offsets) > 0) if b.num_rows else np.zeros(0, np.int64)
            w = w[w >= 0]
            first = np.cumsum(lengths) - lengths
            enough = np.flatnonzero(lengths >= least_words)
            plans = []
            for size, stride, which in searched:
                text, at = window_starts(lengths[enough], size, stride)
                doc = enough[text]
                start, stop = first[doc] + at, np.minimum(at + size, lengths[doc]) + first[doc]
                # a passage with fewer of all these windows' rarest words has too few of each one's
                rare = np.zeros(len(vectors), bool)
                rare[rarest[which][rarest[which] >= 0]] = True
                seen = np.concatenate(([0], np.cumsum(rare[w])))
                some = seen[stop] - seen[start] >= needed[which].min()
                plans.append((size, which, sums[which].T, doc[some], start[some], stop[some]))
            best: dict[tuple[int, int], tuple[float, float]] = {}
            for low in range(0, len(w), 20_000):
                part = w[low : low + 20_000 + window]
                total = np.zeros((len(part) + 1, vectors.shape[1]), np.int32)
                np.cumsum(vectors[part], axis=0, dtype=np.int32, out=total[1:])  # differences hold even where the sums wrap around
                for size, which, turned, doc, start, stop in plans:
                    begin, end = np.searchsorted(start, (low, low + 20_000))
                    for a in range(begin, end, 4_096):
                        z = min(a + 4_096, end)
                        x = (total[stop[a:z] - low] - total[start[a:z] - low]).astype(np.float32)
                        x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-12)[:, None]
                        s = x @ turned
                        i, j = np.nonzero(s >= least_cosine)
                        if not len(i):
                            continue
                        cosine, i, j = s[i, j], i + a, which[j]
                        has = np.zeros(len(i), np.int64)
                        for q in range(0, len(i), 10_000):
                            at = start[i[q : q + 10_000], None] + np.arange(size)
                            passage = np.where(at < stop[i[q : q + 10_000], None], w[np.minimum(at, len(w) - 1)], -1)
                            has[q : q + 10_000] = sum((passage == r[:, None]).any(1).astype(np.int64) for r in rarest[j[q : q + 10_000]].T)
                        fine = np.flatnonzero(has >= needed[j])
                        for q in fine[np.argsort(-cosine[fine], kind="stable")].tolist():
                            k, own, _ = chunks[j[q]]
                            pair, c = (int(doc[i[q]]), k), float(cosine[q])
                            if pair in best and best[pair][0] > c:
                                continue
                            common = common_subsequence(own, w[start[i[q]] : stop[i[q]]]) / len(own)
                            if common >= least_common:
                                best[pair] = max(best.get(pair, (0.0, 0.0)), (c, common))
            if best:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([d for d, _ in best])), pa.array([k for _, k in best], pa.int64()), pa.array([c for c, _ in best.values()]), pa.array([c for _, c in best.values()])], [doc_key, item_key, "cosine", "common"])

    rows = words.mapInArrow(search, out)
    return rows.groupBy(doc_key, item_key).agg(F.max(F.struct("cosine", "common")).alias("m")).select(doc_key, item_key, "m.cosine", "m.common")
