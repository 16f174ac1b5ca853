"""Encoders of text to token vectors: the protocol, and one that needs no model."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Texts that are encoded at once are at most so many, and of so many characters together unless one alone has more; a batch of token vectors has at most so many numbers.
TEXTS, CHARACTERS, NUMBERS = 256, 1 << 17, 1 << 20


class TokenEncoder(Protocol):
    """One matrix (tokens by dimensions) for each text. ``is_query`` may change how a text is prepared."""

    def encode(self, texts: list[str], *, is_query: bool) -> list[np.ndarray]: ...


class HashEncoder:
    """A vector for each white-space token, from the hexadecimal digits of its md5: deterministic, and the same in any engine."""

    dim = 32

    def encode(self, texts: list[str], *, is_query: bool = False) -> list[np.ndarray]:
        return [np.array([self.vector(t) for t in text.split()]).reshape(-1, self.dim) for text in texts]

    def vector(self, token: str) -> np.ndarray:
        v = np.array([int(c, 16) for c in hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()]) - 7.5
        return v / np.sqrt((v * v).sum())


class OnnxEncoder:
    """Token vectors of an exported model: ``model`` is an ONNX file, ``tokenizer`` a tokenizer file; both are opened by each worker, once.

    The model takes ``input_ids`` and ``attention_mask`` and gives one vector for each token; vectors get length 1 unless ``normalise`` is off.
    Texts are cut to ``length`` tokens (queries to ``query_length``, and filled up to it with ``fill`` if that is given); ``prefix`` and ``query_prefix`` come first.
    """

    def __init__(self, model: str, tokenizer: str, *, length: int = 300, query_length: int = 32, fill: int | None = None, prefix: str = "", query_prefix: str = "", batch: int = 32, normalise: bool = True):
        self.model, self.tokenizer, self.length, self.query_length, self.fill = model, tokenizer, length, query_length, fill
        self.prefix, self.query_prefix, self.batch, self.normalise = prefix, query_prefix, batch, normalise
        self._open = None

    def __getstate__(self):
        return self.__dict__ | {"_open": None}

    def _opened(self):
        if self._open is None:
            import onnxruntime
            import tokenizers

            self._open = onnxruntime.InferenceSession(self.model), tokenizers.Tokenizer.from_file(self.tokenizer)
        return self._open

    def encode(self, texts: list[str], *, is_query: bool = False) -> list[np.ndarray]:
        session, tokenizer = self._opened()
        most, prefix, out = (self.query_length, self.query_prefix, []) if is_query else (self.length, self.prefix, [])
        for at in range(0, len(texts), self.batch):
            ids = [e.ids[:most] for e in tokenizer.encode_batch([prefix + t for t in texts[at : at + self.batch]])]
            if is_query and self.fill is not None:
                ids = [x + [self.fill] * (most - len(x)) for x in ids]
            width = max([1, *map(len, ids)])
            given = np.zeros((len(ids), width), np.int64)
            mask = np.zeros((len(ids), width), np.int64)
            for i, x in enumerate(ids):
                given[i, : len(x)], mask[i, : len(x)] = x, 1
            vectors = session.run(None, {"input_ids": given, "attention_mask": mask})[0]
            for v, x in zip(vectors, ids, strict=True):  # what was filled up for the batch is no token
                v = np.asarray(v[: len(x)], np.float32)
                out.append(v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-12) if self.normalise else v)
        return out


class FileTokenizer:
    """A tokenizer file as what passaging needs: ids of texts without special tokens, and the text of ids. Opened by each worker, once."""

    def __init__(self, path: str):
        self.path, self._open = path, None

    def __getstate__(self):
        return {"path": self.path, "_open": None}

    def _opened(self):
        if self._open is None:
            import tokenizers

            self._open = tokenizers.Tokenizer.from_file(self.path)
        return self._open

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self._opened().encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[int]) -> str:
        return self._opened().decode(ids)


def encode(df: DataFrame, key: str, text: str, encoder: TokenEncoder, *, is_query: bool = False) -> DataFrame:
    """(``key``, tok, v): a row for each token of each text. Null texts have none. The encoder is sent to the workers."""
    kind = df.schema[key].dataType.simpleString()
    held = df.sparkSession.sparkContext.broadcast(encoder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in _parts(b.column(1)):
                out = held.value.encode(texts, is_query=is_query)
                yield from _token_rows(b.column(0).slice(at, len(texts)), out, key)

    return df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"`{key}` {kind}, tok int, v array<float>")


def _parts(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Texts in runs of TEXTS and CHARACTERS at most, each with the number of its first one."""
    first, own, size = 0, [], 0
    for at in range(len(texts)):
        t = texts[at].as_py()
        if own and (len(own) == TEXTS or size + len(t) > CHARACTERS):
            yield first, own
            first, own, size = at, [], 0
        own.append(t)
        size += len(t)
    if own:
        yield first, own


def _token_rows(keys: pa.Array, matrices: list[np.ndarray], key: str) -> Iterator[pa.RecordBatch]:
    """A row for each row of each key's matrix, in batches of NUMBERS numbers at most; the numbers never become Python's."""
    for i, x in enumerate(matrices):
        matrices[i] = np.asarray(x, np.float32)
    n = np.array([len(x) for x in matrices], np.int64)
    if not n.sum():
        return
    dim = next(x.shape[1] for x in matrices if len(x))
    of, tok = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    v = np.concatenate([x for x in matrices if len(x)])
    step = max(1, NUMBERS // max(1, dim))
    for at in range(0, len(of), step):
        part = v[at : at + step]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * dim, pa.int32()), pa.array(part.ravel()))
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(of[at : at + step])), pa.array(tok[at : at + step], pa.int32()), lists], [key, "tok", "v"])
