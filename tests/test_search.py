"""The search against a loop over dense matrices."""

import numpy as np
import pytest

from codelattice.operators import indexing, searching, vectors
from codelattice.operators.vectors import Codebook, best_centroids, dot

from .helpers import rows


def frame(spark, x, names):
    return spark.createDataFrame([(*k, [float(y) for y in v]) for k, v in x], names)


@pytest.fixture(scope="module", params=[(1, 5), (2, 8), (3, 30)])
def case(request, spark):
    nprobe, topk = request.param
    rng = np.random.default_rng(nprobe)
    c = np.round(rng.normal(size=(3 if nprobe == 2 else 6, 5)), 2)
    d = np.round(rng.normal(size=(40, 5)), 2)
    q = np.round(rng.normal(size=(9, 5)), 2)
    return {
        "nprobe": nprobe, "topk": topk, "c": c, "d": d, "q": q,
        "centroids": frame(spark, [((i,), v) for i, v in enumerate(c)], "cid int, v array<float>"),
        "tokens": frame(spark, [((i // 2, i), v) for i, v in enumerate(d)], "pid long, tok int, v array<float>"),
        "queries": frame(spark, [((f"q{i // 3}", i), v) for i, v in enumerate(q)], "qid string, tok int, v array<float>"),
    }


def expected(x, weighted):
    c, d, q = (x[k].astype(np.float32).astype(float) for k in "cdq")
    n_docs, k = 20, len(c)
    w = np.full((n_docs, k), np.nan)
    for i, v in enumerate(d):
        near = np.argmax(np.round(v @ c.T, 9))
        value = max(-1.0, v @ (v - c[near]) + 1) if weighted else 1.0
        w[i // 2, near] = np.nanmax([w[i // 2, near], value])
    first, final = {}, {}
    for qid in range(3):
        total = np.zeros(n_docs)
        for v in q[3 * qid : 3 * qid + 3]:
            s = np.round(v @ c.T, 9)
            probe = np.argsort(-s, kind="stable")[: x["nprobe"]]
            for p in range(n_docs):
                held = [w[p, j] * s[j] for j in probe if not np.isnan(w[p, j])]
                total[p] += 0 if not held else max(held) if len(held) == x["nprobe"] else max(0, *held)
        top = sorted(range(n_docs), key=lambda p: (-round(total[p], 9), p))[: x["topk"]]
        first |= {(f"q{qid}", p): total[p] for p in top}
        for p in top:
            codes = np.flatnonzero(~np.isnan(w[p]))
            final[f"q{qid}", p] = sum((v @ c.T)[codes].max() for v in q[3 * qid : 3 * qid + 3])
    return first, final


@pytest.mark.parametrize("weighted", [False, True])
def test_first_stage_and_rerank(case, weighted):
    x = case
    posts = indexing.postings(indexing.assignments(x["tokens"], x["centroids"], ["pid", "tok"]), weighted=weighted)
    top = searching.top_passages(searching.first_stage(searching.probes(x["queries"], x["centroids"], x["nprobe"]), posts, x["nprobe"]), x["queries"], 20, x["topk"])
    first, final = expected(x, weighted)
    assert {(r.qid, r.pid): round(r.score, 6) for r in top.collect()} == {k: round(v, 6) for k, v in first.items()}
    got = searching.rerank(top, posts, x["queries"], x["centroids"])
    assert {(r.qid, r.pid): round(r.score, 5) for r in got.collect()} == {k: round(v, 5) for k, v in final.items()}


def test_blocks_of_the_codebook_give_the_same(case, monkeypatch):
    x = case
    posts = indexing.postings(indexing.assignments(x["tokens"], x["centroids"], ["pid", "tok"]))

    def results():
        best = best_centroids(x["queries"], x["centroids"], ["tok"], 2)
        return rows(best.select("tok", "cid", "rank", "score")), rows(searching.search(x["queries"], x["centroids"], posts, 20, nprobe=x["nprobe"], topk=x["topk"])), best

    one = results()
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 25)
    monkeypatch.setattr(vectors, "PASS_ROWS", 3)
    assert len(Codebook(x["centroids"]).blocks) > 1
    several = results()
    assert several[:2] == one[:2]
    plan = several[2]._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") == one[2]._jdf.queryExecution().toString().count("MapInArrow") and "Union" not in plan  # one pass over the vectors
    monkeypatch.setattr(vectors, "CODEBOOK_BYTES", 10)
    with pytest.raises(ValueError, match="at most"):
        Codebook(x["centroids"])


def test_the_best_of_a_block_with_ties():
    rng = np.random.default_rng(2)
    c = rng.integers(-1, 2, (40, 3)).astype(float)
    v = rng.integers(-2, 3, (50, 3)).astype(float)
    cids = np.arange(40) * 3
    for n in (1, 2, 7, 39, 40, 99):
        s, who = vectors.top_of_block(v, cids, c, n)
        order = np.lexsort((np.broadcast_to(cids, (50, 40)), -(v @ c.T)), axis=1)[:, :n]
        assert (who == cids[order]).all() and (s == np.take_along_axis(v @ c.T, order, 1)).all()


def test_expression_and_blocks_agree(case):
    from pyspark.sql import functions as F

    pairs = case["queries"].withColumnRenamed("v", "q").join(case["centroids"].where("cid = 1"))
    got = {r.tok: round(r.s, 6) for r in pairs.select("tok", dot(F.col("q"), F.col("v")).alias("s")).collect()}
    from codelattice.operators.vectors import all_scores

    assert got == {r.tok: round(r.score, 6) for r in all_scores(case["queries"], case["centroids"], ["tok"]).where("cid = 1").collect()}


def test_zeros_beat_negative_scores_however_many(spark):
    """Of the queries one has more negative scores than are asked for, one some, one none at all, one enough positive ones."""
    scored = [("many", p, -1.0 - p) for p in range(0, 30, 2)] + [("some", 0, 2.0), ("some", 1, -1.0), ("some", 2, 0.0)] + [("fine", p, 1.0 + p) for p in range(9)]
    queries = spark.createDataFrame([(q,) for q in ("many", "some", "fine", "none")], "qid string")
    got = searching.top_passages(spark.createDataFrame(scored, "qid string, pid long, score double"), queries, 40, 5).collect()
    want = {"many": [(p, 0.0) for p in (1, 3, 5, 7, 9)], "some": [(0, 2.0), *((p, 0.0) for p in (2, 3, 4, 5))], "none": [(p, 0.0) for p in range(5)], "fine": [(p, 1.0 + p) for p in (8, 7, 6, 5, 4)]}
    assert {q: [(r.pid, r.score) for r in sorted(got, key=lambda r: r.rank) if r.qid == q] for q in want} == want


def test_pooling_and_limit(spark):
    scored = spark.createDataFrame([("q", 0, 1.0), ("q", 1, 3.0), ("q", 2, 3.0), ("q", 3, -1.0)], "qid string, pid long, score double")
    mapping = spark.createDataFrame([(0, "b"), (1, "b"), (2, "a"), (3, "")], "pid long, doc_id string")
    assert rows(searching.pool(scored, mapping, 2).select("doc_id", "score", "rank")) == {("a", 3.0, 1), ("b", 3.0, 2)}
    assert searching.pool(scored, None, None).count() == 4


def test_index_checks(spark):
    sparse = spark.createDataFrame([(0, 1, 1.0), (2, 1, 1.0)], "pid long, cid int, w double")
    with pytest.raises(ValueError, match="dense"):
        indexing.check_dense(sparse)
    with pytest.raises(ValueError, match="range"):
        indexing.check_range(sparse, 1)
    merged = indexing.merge([sparse, spark.createDataFrame([(2, 5, 2.0)], "pid long, cid int, w double")])
    assert rows(merged.select("pid", "cid")) == {(0, 1), (2, 5)}
    assert rows(indexing.code_map(spark.createDataFrame([(0, [3, 3, 1])], "pid long, cids array<int>"))) == {(0, 3, 1.0), (0, 1, 1.0)}


def test_sample_size():
    assert [indexing.sample_size(n) for n in (1_000, 100_000, 8_841_823)] == [1_000, 55_426, 521_173]
    assert indexing.sample_size(100, given=7) == 7
