"""Codebook training: objectives with closed-form gradients, AdamW, temperature, and restarts of unused centroids."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.operators.indexing import sample_exactly
from codelattice.operators.vectors import matrix
from codelattice.session import write_scratch

#: Rows up to which training runs on the driver.
TRAIN_ROWS = 500_000
_EPS = 1e-12


@dataclass
class Objective:
    weighted: bool = False
    soft: bool = False
    max_difference: bool = False
    kmeans: bool = False
    entropy: float = 0.0
    initial_temperature: float = 1.0
    final_temperature: float = 0.01
    anneal_steps: int | None = None

    def __post_init__(self) -> None:
        if (self.kmeans or self.entropy) and not self.soft:
            raise ValueError("the k-means objective and the entropy term need soft assignments")


def temperature(step: int, o: Objective, max_steps: int) -> float:
    """Cosine from the initial to the final temperature; the final one from then on."""
    steps = o.anneal_steps or max_steps
    if step >= steps:
        return o.final_temperature
    return o.final_temperature + (o.initial_temperature - o.final_temperature) * (1 + math.cos(math.pi * step / steps)) / 2


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def loss_and_gradient(c: np.ndarray, d: np.ndarray, q: np.ndarray, o: Objective, t: float = 1.0) -> tuple[float, np.ndarray]:
    """The loss of a batch ``d`` for queries ``q``, and its gradient by the centroids ``c``."""
    sim = d @ c.T
    near = sim.argmax(1)
    p = softmax(sim / t) if o.soft else None
    a = p @ c if o.soft else c[near]
    n, b = len(q), len(d)
    grad, through_p = np.zeros_like(c), 0.0
    qa, qd = q @ a.T, q @ d.T
    if o.weighted:
        if n != b:
            raise ValueError("the weighted loss needs as many queries as vectors")
        dr = d @ (d - a).T
        r = qa * (1 + dr) - qd
    else:
        r = qa - qd
    norm = np.sqrt((r * r).sum(1))
    loss = float(norm.mean())
    u = r / np.maximum(norm, _EPS)[:, None] / n
    if o.weighted:
        ga = (u * (1 + dr)).T @ q - (u * qa).T @ d
    else:
        ga = u.T @ q
    if o.max_difference:  # against what stands for the vector: its centroid, or the mix of all
        second = second_best(sim, near)
        loss += float((q @ c[second].T - qa).mean())
        step = q.sum(0) / (n * b)
        np.add.at(grad, second, step)
        ga = ga - step
    if o.kmeans:
        nd, na = np.sqrt((d * d).sum(1)), np.maximum(np.sqrt((a * a).sum(1)), _EPS)
        cos = (d * a).sum(1) / (nd * na)
        loss += float(1 - cos.mean())
        ga = ga - (d / (nd * na)[:, None] - cos[:, None] * a / (na * na)[:, None]) / b
    if o.entropy:
        k, mean = len(c), p.mean(0)
        loss += o.entropy * float((np.log(1 / k) - np.log(mean + 1e-8)).sum() / k) / k
        through_p = np.broadcast_to(-o.entropy / (k * k * (mean + 1e-8)) / b, p.shape)
    if o.soft:
        h = ga @ c.T + through_p
        grad += p.T @ ga + (p * (h - (p * h).sum(1, keepdims=True))).T @ d / t
    else:
        np.add.at(grad, near, ga)
    return loss, grad


def second_best(sim: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The centroid of the second-largest product of each row, of equal ones the first; the best one where there is no other."""
    if sim.shape[1] < 2:
        return near
    rest = sim.copy()
    rest[np.arange(len(sim)), near] = -np.inf
    return rest.argmax(1)


def touched(c: np.ndarray, d: np.ndarray, second: bool) -> np.ndarray:
    """The centroids that a batch's hard objectives depend on, ascending: the best of each vector, and with ``second`` the second-best. In blocks of centroids."""
    kept: tuple[np.ndarray, np.ndarray] | None = None
    for at in range(0, len(c), 65_536):
        s = d @ c[at : at + 65_536].T
        k = min(2 if second else 1, s.shape[1])
        top = s.argmax(1)[:, None] if k == 1 else np.stack([s.argmax(1), second_best(s, s.argmax(1))], 1)
        got = np.take_along_axis(s, top, 1), top + at
        if kept is not None:
            both = np.concatenate((kept[0], got[0]), 1), np.concatenate((kept[1], got[1]), 1)
            order = np.lexsort((both[1], -both[0]), axis=1)[:, : 2 if second else 1]
            got = np.take_along_axis(both[0], order, 1), np.take_along_axis(both[1], order, 1)
        kept = got
    return np.unique(kept[1])


def step_gradient(c: np.ndarray, d: np.ndarray, q: np.ndarray, o: Objective, t: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The loss of a batch, the centroids it has a gradient for, and that gradient. Hard objectives touch as many centroids as vectors at most (or twice)."""
    if o.soft:
        loss, g = loss_and_gradient(c, d, q, o, t)
        return loss, np.arange(len(c)), g
    own = touched(c, d, o.max_difference)
    loss, g = loss_and_gradient(c[own], d, q, o, t)
    return loss, own, g


def errors(c: np.ndarray, d: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centroid of each vector and the error |Q(c - d)|, in blocks of vectors, centroids and queries."""
    near, error = np.zeros(len(d), np.int64), np.zeros(len(d))
    for at in range(0, len(d), 4_096):
        x = d[at : at + 4_096]
        best = np.full(len(x), -np.inf)
        for k in range(0, len(c), 65_536):
            s = x @ c[k : k + 65_536].T
            top = s.max(1)
            near[at : at + 4_096] = np.where(top > best, s.argmax(1) + k, near[at : at + 4_096])
            best = np.maximum(best, top)
        for k in range(0, len(q), 4_096):
            error[at : at + 4_096] += (((c[near[at : at + 4_096]] - x) @ q[k : k + 4_096].T) ** 2).sum(1)
    return near, np.sqrt(error)


def every_so_many(x: np.ndarray, most: int) -> np.ndarray:
    """Every (number // most)-th row: up to about twice ``most``."""
    return x[:: max(1, len(x) // most)]


def restart_unused(c: np.ndarray, d: np.ndarray, q: np.ndarray, used: np.ndarray | None = None) -> np.ndarray:
    """Centroids that no vector is assigned to (or that aren't ``used``) become the vectors of the largest error |Q(c - d)|, in turn."""
    near, error = errors(c, d, q)
    dead = np.flatnonzero(np.bincount(near, minlength=len(c)) == 0 if used is None else ~used)
    worst = np.argsort(-error, kind="stable")[: len(dead)]
    c = c.copy()
    c[dead[: len(worst)]] = d[worst]
    return c


@dataclass
class Optimizer:
    """AdamW with a rate that rises over ``warmup`` steps and then falls linearly to 0, and gradients clipped to the norm ``clip``."""

    c: np.ndarray
    steps: int
    rate: float = 1e-2
    decay: float = 0.0
    clip: float = 1.0
    warmup: int = 0
    at: int = 0
    m: np.ndarray | None = None
    v: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.m = np.zeros_like(self.c) if self.m is None else self.m
        self.v = np.zeros_like(self.c) if self.v is None else self.v

    def learning_rate(self) -> float:
        if self.at < self.warmup:
            return self.rate * self.at / self.warmup
        return self.rate * max(0.0, (self.steps - self.at) / max(1, self.steps - self.warmup))

    def step(self, own: np.ndarray, g: np.ndarray) -> None:
        """One step by the gradient ``g`` of the centroids ``own``; that of the others is 0."""
        norm = np.sqrt((g * g).sum())
        g = g * min(1.0, self.clip / max(norm, _EPS)) if self.clip else g
        lr = self.learning_rate()
        self.at += 1
        self.m *= 0.9
        self.v *= 0.999
        self.m[own] += 0.1 * g
        self.v[own] += 0.001 * g * g
        self.c -= lr * (self.m / (1 - 0.9**self.at) / (np.sqrt(self.v / (1 - 0.999**self.at)) + 1e-8) + self.decay * self.c)


def train(
    vectors: np.ndarray, k: int, *, objective: Objective | None = None, queries: np.ndarray | None = None, initial: np.ndarray | None = None, steps: int = 200, batch: int = 256, rate: float = 1e-2, decay: float = 0.0, clip: float = 1.0, warmup: int = 0,
    restart: bool = False, most_queries: int = 8_192, seed: int = 42, resume: dict | None = None, save: Callable[[dict], None] | None = None, save_steps: int = 500,
) -> tuple[np.ndarray, list[float]]:
    """Centroids after ``steps`` steps of AdamW on one machine, and the loss of each step. Everything is seeded, and an epoch's order depends on its
    number alone: a training that goes on from a state that ``save`` was given (every ``save_steps`` steps) is the same as one that wasn't stopped.

    With ``restart``, at the end of an epoch unused centroids start again (see :func:`restart_unused`), by all training queries, or without such by up to about
    twice ``most_queries`` of the vectors.
    """
    o = objective or Objective()
    x = vectors.astype(np.float64)
    if initial is None and len(x) < k:
        raise ValueError(f"{k} centroids can't start from {len(x)} vectors")
    first = np.random.default_rng(seed).permutation(len(x))[:k]
    opt = Optimizer((x[first] if initial is None else initial).astype(np.float64).copy(), steps, rate, decay, clip, warmup)
    if resume:
        opt.c, opt.m, opt.v, opt.at = (resume[n] for n in ("c", "m", "v", "at"))
    losses, per = [], max(1, -(-len(x) // batch))
    for step in range(opt.at, steps):
        epoch, part = divmod(step, per)
        if part == 0 or step == opt.at:
            order = np.random.default_rng((seed, epoch)).permutation(len(x))
        if part == 0 and epoch and restart:
            opt.c = restart_unused(opt.c, x, every_so_many(x, most_queries) if queries is None else queries)
        d = x[order[part * batch : part * batch + batch]]
        loss, own, g = step_gradient(opt.c, d, d if queries is None else queries, o, temperature(step, o, steps))
        losses.append(loss)
        opt.step(own, g)
        if save and opt.at % save_steps == 0 and opt.at < steps:
            save({"c": opt.c, "m": opt.m, "v": opt.v, "at": opt.at})
    return opt.c, losses


def gradient_of(rows: DataFrame, c: np.ndarray, q: np.ndarray | None, o: Objective, t: float, batch: int) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss of the batches of ``rows`` (v), the centroids with a gradient, and the mean gradient: each task makes those of its own batches.

    As where several devices train together, a batch lies within one task, and gradients are averaged by batch. Sums are taken by centroid
    before the driver gets them, a row for each centroid that was touched.
    """
    spark = rows.sparkSession
    given = spark.sparkContext.broadcast((c.astype(np.float32), q))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, q = given.value
        c, held, n, loss = c.astype(np.float64), [], 0, 0.0
        sums: dict[int, np.ndarray] = {}

        def one(d: np.ndarray) -> float:
            value, own, g = step_gradient(c, d, d if q is None else q, o, t)
            for i, row in zip(own.tolist(), g, strict=True):
                sums[i] = sums[i] + row if i in sums else row
            return value

        for b in batches:
            held.append(matrix(b.column(0)))
            while sum(map(len, held)) >= batch:
                x = np.concatenate(held)
                loss, n, held = loss + one(x[:batch]), n + 1, [x[batch:]]
        if held and len(x := np.concatenate(held)):
            loss, n = loss + one(x), n + 1
        if n:
            sums[-1] = np.concatenate(([loss, n], np.zeros(max(0, c.shape[1] - 2))))  # the row -1 has the loss and the number of batches
        yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int64()), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.float64()))], ["cid", "g"])

    dim = max(2, c.shape[1])
    parts = rows.select("v").mapInArrow(partial, "cid long, g array<double>")
    got = parts.groupBy("cid").agg(F.array(*(F.sum(F.get("g", F.lit(i))) for i in range(dim))).alias("g")).toArrow()
    given.unpersist()
    ids, g = got["cid"].to_numpy(), matrix(got["g"])
    head = g[ids == -1]
    if not len(head):
        return 0.0, np.zeros(0, np.int64), np.zeros((0, c.shape[1]))
    loss, n = head[0, :2]
    order = np.argsort(ids[ids >= 0])
    return loss / n, ids[ids >= 0][order], g[ids >= 0][order][:, : c.shape[1]] / n


def train_distributed(
    vectors: DataFrame, k: int, *, objective: Objective | None = None, queries: np.ndarray | None = None, initial: np.ndarray | None = None, steps: int = 200, batch: int = 2_048, rows_a_step: int = 500_000, rate: float = 1e-2, decay: float = 0.0, clip: float = 1.0, warmup: int = 0,
    restart: bool = False, most_queries: int = 8_192, seed: int = 42, resume: dict | None = None, save: Callable[[dict], None] | None = None, save_steps: int = 50,
) -> tuple[np.ndarray, list[float]]:
    """As :func:`train`, for any number of vectors (v): the driver holds the centroids and their moments only, gradients are made beside the vectors.

    The vectors are written once in parts of about ``rows_a_step`` rows, by hash; a step is a job over one part. The start is ``k`` of the vectors,
    those of the smallest hashes, or ``initial``.
    """
    o, spark = objective or Objective(), vectors.sparkSession
    rows = vectors.select("v").withColumn("h", F.xxhash64("v", F.lit(seed)))
    total = rows.count()
    if initial is None and total < k:
        raise ValueError(f"{k} centroids can't start from {total} vectors")
    parts = max(1, round(total / rows_a_step))
    kept = write_scratch(rows.withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).repartition("part", F.pmod(F.shiftright("h", 20), F.lit(max(1, spark.sparkContext.defaultParallelism)))), by="part")
    start = initial if initial is not None else matrix(sample_exactly(kept.select(F.concat_ws(",", "h", F.col("v").cast("string")).alias("_k"), "v"), "_k", k, seed).select("v").toArrow()["v"])
    opt = Optimizer(start.astype(np.float64).copy(), steps, rate, decay, clip, warmup)
    if resume:
        opt.c, opt.m, opt.v, opt.at = (resume[n] for n in ("c", "m", "v", "at"))
    losses = []
    for step in range(opt.at, steps):
        if restart and step and step % parts == 0:
            q = queries if queries is not None else matrix(sample_exactly(kept.select(F.col("h").cast("string").alias("_k"), "v"), "_k", most_queries, seed).select("v").toArrow()["v"])
            opt.c = restarted(kept, opt.c, q)
        order = np.random.default_rng((seed, step // parts)).permutation(parts)
        loss, own, g = gradient_of(kept.where(F.col("part") == int(order[step % parts])), opt.c, queries, o, temperature(step, o, steps), batch)
        losses.append(loss)
        opt.step(own, g)
        if save and opt.at % save_steps == 0 and opt.at < steps:
            save({"c": opt.c, "m": opt.m, "v": opt.v, "at": opt.at})
    return opt.c, losses


def restarted(vectors: DataFrame, c: np.ndarray, q: np.ndarray) -> np.ndarray:
    """:func:`restart_unused` over any number of vectors (v): which centroids are used, and each task's worst vectors, come to the driver."""
    spark = vectors.sparkSession
    given = spark.sparkContext.broadcast((c, q))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, q = given.value
        for b in batches:
            near, error = errors(c, matrix(b.column(0)), q)
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(error), b.column(0)], ["cid", "error", "v"])

    rated = write_scratch(vectors.select("v").mapInArrow(rate, "cid long, error double, v array<float>"))
    dead = np.setdiff1d(np.arange(len(c)), rated.select("cid").distinct().toArrow()["cid"].to_numpy())
    if not len(dead):
        return c
    worst = matrix(rated.orderBy(F.col("error").desc(), F.xxhash64("v")).limit(len(dead)).select("v").toArrow()["v"])
    c = c.copy()
    c[dead[: len(worst)]] = worst
    return c


def save_state(spark: SparkSession, path: str, state: dict) -> None:
    """A training state as a table of rows (cid, c, m, v) and the number of steps, in a folder of its own that is named last."""
    from codelattice.sources.sinks import write_text

    frame = pa.table({"cid": np.arange(len(state["c"])), **{n: pa.array(state[n].tolist(), pa.list_(pa.float64())) for n in ("c", "m", "v")}})
    spark.createDataFrame(frame).write.mode("overwrite").parquet(f"{path}/checkpoint-{state['at']}")
    write_text(spark, f"{path}/checkpoint.txt", str(state["at"]))


def load_state(spark: SparkSession, path: str) -> dict | None:
    from codelattice.sources.sinks import read_text

    at = read_text(spark, f"{path}/checkpoint.txt")
    if at is None:
        return None
    t = spark.read.parquet(f"{path}/checkpoint-{int(at)}").orderBy("cid").toArrow()
    return {"at": int(at), **{n: matrix(t[n]).copy() for n in ("c", "m", "v")}}


def train_codebook(vectors: DataFrame, k: int, *, most: int = TRAIN_ROWS, order: str | None = None, **options) -> DataFrame:
    """Centroids (cid, v) trained on the rows of ``v``: on the driver where there are at most ``most``, else beside the vectors.

    Both ways optimise the same objective over all rows; with more of them a step takes as many batches as a part of the rows has.
    """
    if vectors.count() > most:
        c, _ = train_distributed(vectors, k, **options)
    else:
        rows = vectors.select(*([order] if order else []), "v").toArrow()
        x = matrix(rows["v"])
        x = x[np.argsort(rows[order].to_numpy(), kind="stable")] if order else x[np.lexsort(x.T[::-1])]
        c, _ = train(x, k, **options)
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(c)], "cid int, v array<float>")
