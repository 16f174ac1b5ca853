"""Queries over the training of codebooks: objectives, temperature, start and a step of the optimiser, against SQL.

A batch is 128 token vectors of ``embeddings`` in a row, which are their own queries; the codebook is that of the labels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.catalogue import _SEARCH, Fixture, query
from codelattice.operators import codebook, indexing
from codelattice.operators.codebook import Objective

_T, _LAMBDA = 0.5, 0.3
_BATCH = f"""
    {_SEARCH},
    b AS MATERIALIZED (SELECT pid // 16 AS batch, tok, dt.v, c.v AS a, cid FROM da JOIN dt USING (pid, tok) JOIN c USING (cid)),
    xy AS MATERIALIZED (SELECT x.batch, x.tok AS x, y.tok AS y, y.cid, list_dot_product(x.v, y.v) AS qd, list_dot_product(x.v, y.a) AS qa, list_dot_product(x.v, y.v) - list_dot_product(x.v, y.a) AS dr FROM b x JOIN b y ON x.batch = y.batch)"""
_SOFT = f"""
    ds AS MATERIALIZED (SELECT batch, tok, cid, list_dot_product(b.v, c.v) AS s FROM (SELECT batch, tok, v FROM b) b CROSS JOIN c),
    p AS MATERIALIZED (SELECT batch, tok, cid, s, exp(s / {_T}) / sum(exp(s / {_T})) OVER (PARTITION BY tok) AS p FROM ds),
    sxy AS MATERIALIZED (SELECT x.batch, x.tok AS x, y.tok AS y, sum(y.p * x.s) AS qa FROM p x JOIN p y ON x.batch = y.batch AND x.cid = y.cid GROUP BY x.batch, x.tok, y.tok),
    soft AS (SELECT batch, avg(n) AS loss FROM (SELECT sxy.batch, sxy.x, sqrt(sum(power(sxy.qa - xy.qd, 2))) AS n FROM sxy JOIN xy ON xy.x = sxy.x AND xy.y = sxy.y GROUP BY sxy.batch, sxy.x) GROUP BY batch)"""
_HARD = "hard AS (SELECT batch, avg(n) AS loss FROM (SELECT batch, x, sqrt(sum(power(qa - qd, 2))) AS n FROM xy GROUP BY batch, x) GROUP BY batch)"
_SECOND = "second AS MATERIALIZED (SELECT batch, tok, cid FROM (SELECT batch, tok, cid, row_number() OVER (PARTITION BY tok ORDER BY round(list_dot_product(b.v, c.v), 9) DESC, cid) AS r FROM (SELECT batch, tok, v FROM b) b CROSS JOIN c) WHERE r = 2), sq AS (SELECT x.batch, x.tok AS x, s.tok AS y, list_dot_product(x.v, c.v) AS q2 FROM b x JOIN second s ON s.batch = x.batch JOIN c ON c.cid = s.cid)"


def _loss(spark: SparkSession, d: str, o: Objective) -> DataFrame:
    f = Fixture(spark, d)
    book = np.stack(f.centroids.orderBy("cid").toPandas()["v"]).astype(float)  # a row for each label

    def loss(b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(b["v"]).astype(float)
        return pd.DataFrame({"batch": [b["batch"].iloc[0]], "loss": [round(codebook.loss_and_gradient(book, x, x, o, _T)[0], 6)]})

    return f.tokens.select(F.expr("pid div 16").alias("batch"), "v").groupBy("batch").applyInPandas(loss, "batch long, loss double")


@query(f"WITH {_BATCH} SELECT batch, round(avg(n), 6) AS loss FROM (SELECT batch, x, sqrt(sum(power(qa * (1 + dr) - qd, 2))) AS n FROM xy GROUP BY batch, x) GROUP BY batch")
def loss_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _loss(spark, d, Objective(weighted=True))


@query(f"WITH {_BATCH}, {_SOFT} SELECT batch, round(loss, 6) AS loss FROM soft")
def loss_soft(spark: SparkSession, d: str) -> DataFrame:
    return _loss(spark, d, Objective(soft=True))


@query(f"WITH {_BATCH}, {_HARD}, {_SECOND} SELECT hard.batch, round(any_value(loss) + avg(q2 - qa), 6) AS loss FROM hard JOIN sq ON sq.batch = hard.batch JOIN xy ON xy.x = sq.x AND xy.y = sq.y GROUP BY hard.batch")
def loss_max_difference(spark: SparkSession, d: str) -> DataFrame:
    return _loss(spark, d, Objective(max_difference=True))


@query(f"WITH {_BATCH}, {_SOFT}, {_SECOND} SELECT soft.batch, round(any_value(loss) + avg(q2 - qa), 6) AS loss FROM soft JOIN sq ON sq.batch = soft.batch JOIN sxy ON sxy.x = sq.x AND sxy.y = sq.y GROUP BY soft.batch")
def loss_max_difference_soft(spark: SparkSession, d: str) -> DataFrame:
    """The second-best centroid against the mix of centroids that stands for a vector."""
    return _loss(spark, d, Objective(soft=True, max_difference=True))


@query(f"""
    WITH {_BATCH}, {_SOFT}, g AS (SELECT x.cid AS i, y.cid AS j, list_dot_product(x.v, y.v) AS g FROM c x CROSS JOIN c y),
    a2 AS (SELECT x.batch, x.tok, sum(x.p * y.p * g) AS a2 FROM p x JOIN p y ON x.tok = y.tok JOIN g ON g.i = x.cid AND g.j = y.cid GROUP BY x.batch, x.tok),
    k AS (SELECT p.batch, p.tok, sum(p * s) / sqrt(any_value(a2.a2)) / sqrt(any_value(list_dot_product(b.v, b.v))) AS cos FROM p JOIN a2 ON a2.tok = p.tok JOIN b ON b.tok = p.tok GROUP BY p.batch, p.tok)
    SELECT soft.batch, round(any_value(loss) + 1 - avg(cos), 6) AS loss FROM soft JOIN k ON k.batch = soft.batch GROUP BY soft.batch""")
def loss_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return _loss(spark, d, Objective(soft=True, kmeans=True))


@query(f"""
    WITH {_BATCH}, {_SOFT}, m AS (SELECT batch, cid, avg(p) AS p FROM p GROUP BY batch, cid), k AS (SELECT CAST(count(*) AS DOUBLE) AS k FROM c)
    SELECT soft.batch, round(any_value(loss) + {_LAMBDA} * sum((ln(1 / k) - ln(m.p + 1e-8)) / k) / any_value(k), 6) AS loss FROM soft JOIN m ON m.batch = soft.batch CROSS JOIN k GROUP BY soft.batch""")
def loss_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _loss(spark, d, Objective(soft=True, entropy=_LAMBDA))


@query("SELECT CAST(s AS INT) AS step, round(CASE WHEN s >= 80 THEN 0.01 ELSE 0.01 + 0.99 * (1 + cos(pi() * s / 80.0)) / 2 END, 6) AS temperature FROM range(0, 101) t(s)")
def temperatures(spark: SparkSession, d: str) -> DataFrame:
    o = Objective(soft=True, anneal_steps=80)
    return spark.createDataFrame([(s, round(codebook.temperature(s, o, 100), 6)) for s in range(101)], "step int, temperature double")


@query("SELECT vec_id AS tok FROM embeddings QUALIFY row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || ':42')) <= 32")
def initial_centroids(spark: SparkSession, d: str) -> DataFrame:
    """The vectors a codebook of 32 starts from where it is trained beside them: those of the smallest hashes."""
    return indexing.sample_exactly(Fixture(spark, d).tokens, "tok", 32).select("tok")


@query(f"""
    WITH {_BATCH}, n AS (SELECT batch, x, sqrt(sum(power(qa - qd, 2))) AS n, count(*) AS m FROM xy GROUP BY batch, x),
    u AS (SELECT xy.batch, xy.x, xy.cid, sum((qa - qd) / greatest(n, 1e-12) / m) AS u FROM xy JOIN n ON n.x = xy.x GROUP BY xy.batch, xy.x, xy.cid),
    g AS (SELECT u.batch, u.cid, i, sum(u * b.v[i]) AS g FROM u JOIN b ON b.tok = u.x CROSS JOIN range(1, 65) t(i) GROUP BY u.batch, u.cid, i),
    f AS (SELECT batch, least(1.0, 1.0 / greatest(sqrt(sum(g * g)), 1e-12)) AS f FROM g GROUP BY batch),
    w AS (SELECT bs.batch, c.cid, t.i AS i, c.v[t.i] AS c, coalesce(g.g * f.f, 0) AS g FROM f bs CROSS JOIN c CROSS JOIN range(1, 65) t(i) LEFT JOIN g ON g.batch = bs.batch AND g.cid = c.cid AND g.i = t.i LEFT JOIN f ON f.batch = bs.batch)
    SELECT batch, cid, CAST(i AS INT) AS i, round(c - 0.01 * (g / (abs(g) + 1e-8) + 0.1 * c), 5) AS c FROM w""")
def optimizer_step(spark: SparkSession, d: str) -> DataFrame:
    """The centroids after a first step of AdamW by the main objective: clipped gradient, moments, rate 0.01 and decay 0.1."""
    f = Fixture(spark, d)
    rows = f.centroids.orderBy("cid").toPandas()
    cids, book = rows["cid"].to_numpy(), np.stack(rows["v"]).astype(float)

    def step(b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(b["v"]).astype(float)
        opt = codebook.Optimizer(book.copy(), 1, rate=0.01, decay=0.1)
        _, own, g = codebook.step_gradient(opt.c, x, x, Objective(), 1.0)
        opt.step(own, g)
        k, dim = book.shape
        return pd.DataFrame({"batch": b["batch"].iloc[0], "cid": np.repeat(cids, dim), "i": np.tile(np.arange(1, dim + 1), k), "c": np.round(opt.c.ravel(), 5)})

    return f.tokens.select(F.expr("pid div 16").alias("batch"), "v").groupBy("batch").applyInPandas(step, "batch long, cid int, i int, c double")
