"""Encoding texts with a public byte-level BPE vocabulary, by an automaton compiled from its merges."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.units import lists, rows_of

#: How this family of vocabularies splits a text before the merges (a fixed value, as published with them).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabulary files: printable bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_vocabulary(path: str) -> dict:
    """Token bytes by id, the id of each byte, and the merges (left, right, merged) in rank order, of a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, ids = byte_letters(), model["vocab"]
    raw = {t: bytes(letters[c] for c in t) for t in ids if all(c in letters for c in t)}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
    made = {c for _, _, c in merges}
    return {"bytes": {ids[t]: b for t, b in raw.items() if len(b) == 1 or ids[t] in made}, "merges": merges}


class MergeAutomaton:
    """A deterministic automaton over tokens that accepts exactly the token sequences which the merges make.

    It starts as one state with an arc for every byte. Each merge u, v -> w then applies a gadget: the state p that all arcs u lead
    to gets a copy without the arc v, to which the arcs u are redirected, and wherever u may go a new arc w leads to where v led from
    p. A copy is kept as the difference from its origin (the arc it lost, and when), and of the arcs of a state a row is filled in as
    they are first asked for; so the table stays near the size of the merges rather than of states times tokens.

    Of all token sequences that spell a given byte string the automaton accepts one. Encoding walks the bytes through the trie of the
    tokens, and keeps for each position the one state in which the automaton can be there.
    """

    def __init__(self, vocabulary: dict):
        spelled: dict[int, bytes] = vocabulary["bytes"]
        size = max(spelled) + 1
        self.spelled = spelled
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        self.lost: dict[tuple[int, int], int] = {}
        self.target = {t: 0 for t in spelled}
        origin, owner = [0], [-1]
        for rank, (u, v, w) in enumerate(vocabulary["merges"]):
            if (u, v) in self.lost or self.left[w] >= 0:  # a token is made by its first merge only
                continue
            reached = self.target[v]
            origin.append(self.target[u])
            owner.append(u)
            self.target[u] = len(origin) - 1
            # u = v: the arc w leads to the state before its copy, in which another u may follow
            self.target[w] = reached
            self.lost[u, v] = rank
            self.left[w], self.right[w], self.born[w] = u, v, rank
        self.states = len(origin)
        self.rows: dict[int, dict[int, bool]] = {}
        self.speaker = {s: t for t, s in self.target.items()}  # any token whose arcs lead to the state
        self.trie: dict = {}
        for t, b in spelled.items():
            node = self.trie
            for x in b:
                node = node.setdefault(x, {})
            node[-1] = t

    def may_follow(self, u: int, v: int) -> bool:
        """Whether the state that u leads to still has the arc v, from the gadgets' differences."""
        left, right, born, lost = self.left, self.right, self.born, self.lost
        limit = float("inf")  # gadgets of this rank or later hadn't been applied when the arcs looked at came about
        while True:
            if lost.get((u, v), limit) < limit:
                return False
            if born[u] > born[v]:  # u's target is that of its right part when u came about
                limit, u = born[u], right[u]
            elif born[v] >= 0:  # the arc v is there if that of its left part was; an equal merge further left goes first
                limit, v = born[v] + (born[u] < born[v]) * 0.5, left[v]
            else:
                return True

    def encode(self, word: bytes) -> list[int]:
        n = len(word)
        came: list = [None] * (n + 1)  # the token by which each position is reached
        for i in range(n):
            if i and came[i] is None:
                continue
            row = None
            if i:
                state = self.target[came[i]]
                row = self.rows.get(state)
                if row is None:
                    row = self.rows[state] = {}
                speaker = self.speaker[state]
            node = self.trie
            for j in range(i, n):
                node = node.get(word[j])
                if node is None:
                    break
                t = node.get(-1)
                if t is None or came[j + 1] is not None:
                    continue
                if row is None:
                    ok = self.starts(t)
                else:
                    ok = row.get(t)
                    if ok is None:
                        ok = row[t] = self.may_follow(speaker, t)
                if ok:
                    came[j + 1] = t
        ids, j = [], n
        while j > 0:
            t = came[j]
            ids.append(t)
            j -= len(self.spelled[t])
        return ids[::-1]

    def starts(self, t: int) -> bool:
        """The start state keeps the arcs of tokens that the merges really make: all inner pairs hold when their token came about."""
        ok = self.rows.setdefault(-1, {}).get(t)
        if ok is None:
            u, v = self.left[t], self.right[t]
            ok = u < 0 or (self.starts(u) and self.starts(v) and self._held(u, v, self.born[t]))
            self.rows[-1][t] = ok
        return ok

    def _held(self, u: int, v: int, rank: int) -> bool:
        """Whether u and v could stand side by side when the merge of this rank came."""
        left, right, born, lost = self.left, self.right, self.born, self.lost
        limit = rank
        while True:
            if lost.get((u, v), limit) < limit:
                return False
            if born[u] > born[v]:
                limit, u = born[u], right[u]
            elif born[v] >= 0:
                limit, v = born[v] + (born[u] < born[v]) * 0.5, left[v]
            else:
                return True

    def decode(self, ids: Sequence[int]) -> bytes:
        """The labels of the arcs, one after the other."""
        return b"".join(self.spelled[i] for i in ids)


class Encoder:
    """Splits texts and encodes the words, keeping the ids of words seen before, up to a bound."""

    most = 400_000

    def __init__(self, vocabulary: dict, pattern: str = PATTERN):
        self.automaton, self.split = MergeAutomaton(vocabulary), regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.ids, self.offsets = array("i"), array("q", [0])
        self.known = _Known(self)

    def add(self, word: str) -> int:
        self.ids.extend(self.automaton.encode(word.encode("utf-8", "surrogatepass")))
        self.offsets.append(len(self.ids))
        return len(self.offsets) - 2

    def encode_batch(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """List offsets and ids; an empty and a null text have none."""
        if len(self.known) > self.most:
            self.forget()
        known, split = self.known, self.split
        at, ends = array("q"), [0]
        for t in texts:
            if t:
                at.extend(map(known.__getitem__, split(t)))
            ends.append(len(at))
        at = np.frombuffer(at, np.int64) if len(at) else np.zeros(0, np.int64)
        offsets, ids = np.array(self.offsets, np.int64), np.array(self.ids, np.int32)
        starts = offsets[at]
        sizes = offsets[at + 1] - starts
        total = np.concatenate(([0], np.cumsum(sizes)))
        picked = np.repeat(starts - total[:-1], sizes) + np.arange(total[-1])
        return total[ends], ids[picked]


class _Known(dict):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: str) -> int:
        k = self[word] = self.encoder.add(word)
        return k


_encoders: dict[str, Encoder] = {}


def encode_documents(df: DataFrame, key: str, text: str, path: str, *, pattern: str = PATTERN) -> DataFrame:
    """``key`` and ``ids`` of every row: the token ids of its text by the vocabulary file at ``path``, without special tokens.

    Text is taken as it is: no normalisation, and strings that look like special tokens are ordinary text. An empty and a null
    text give an empty list. Every row comes out, repeated ones as often as they are there; a null key stays null. An empty
    table gives no rows. Other columns are ignored. The driver reads the file; what is broadcast is bounded by the vocabulary.
    """
    vocabulary = df.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    kind, name = df.schema[key].dataType.simpleString(), f"{path}|{pattern}"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _encoders:
            _encoders[name] = Encoder(vocabulary.value, pattern)
        encoder = _encoders[name]
        for part, texts in rows_of(batches):
            offsets, ids = encoder.encode_batch(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), lists(offsets, pa.array(ids, pa.int32()))], [key, "ids"])

    return df.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("_t")).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, key: str, ids: str, path: str) -> DataFrame:
    """``key`` and ``text``: the labels of the ids' arcs, as text. A null list gives null."""
    spelled = df.sparkSession.sparkContext.broadcast(load_vocabulary(path)["bytes"])
    kind = df.schema[key].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [None if x is None else b"".join(map(spelled.value.__getitem__, x)).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.string())], [key, "text"])

    return df.select(F.col(key).alias("_k"), F.col(ids).alias("_i")).mapInArrow(decode, f"`{key}` {kind}, text string")
