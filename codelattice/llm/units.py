"""Words, white space and batches of the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: The characters of Unicode's White_Space property; Java's (?U)\s and Python's \s differ from it and from each other.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Maximal runs of letters and digits (general categories L and N).
WORD = re.compile(r"[^\W_]+")
#: Maximal runs of other than white space.
TOKEN = re.compile(f"[^{WHITE}]+")


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text. Lower-casing is by word: that of İ adds a mark, and that of Σ looks at its neighbours."""
    if "İ" in text or "Σ" in text:
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


class Hashes(dict):
    """Word to 64-bit hash, with a bound on what is kept."""

    most = 1_000_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def rotated(h: np.ndarray, by: int) -> np.ndarray:
    return (h << np.uint64(by)) | (h >> np.uint64(64 - by))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit integers."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def rows_of(batches: Iterator[pa.RecordBatch], most_chars: int = 8_000_000) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with the list of its second column (a text), in slices of a bounded number of characters."""
    for b in batches:
        size = max(1, b.num_rows)
        per = max(1, int(most_chars / max(1.0, b.column(1).nbytes / size)))
        for at in range(0, b.num_rows, per):
            part = b.slice(at, per)
            yield part, part.column(1).to_pylist()
