"""Nearest vectors, clusters and top N: against plain loops, and on odd rows."""

import cProfile
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelattice.llm import knn, mixture, topn, vectors
from codelattice.llm.vectors import hash_bound, sample_units, split_hot, survey, unit

from ..helpers import rows

DIM = 12
COLUMNS = "sample_id long, v array<float>, tile string, name string, kind string, id string"


def samples(spark, copies=40):
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(25, DIM)))
    x = np.concatenate([(c + rng.normal(scale=0.05, size=(rng.integers(1, 30), DIM))) * rng.uniform(0.1, 9) for c in centres])
    x = np.concatenate([x, rng.normal(size=(30, DIM)), 2 * x[:5]]).astype(np.float16).astype(np.float32)
    ids = rng.permutation(10 * len(x))[: len(x)]
    data = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    data += [(int(10**6 + i), x[7].tolist()) for i in range(copies)]  # one vector under many ids
    bad = [(1, None), (2, []), (3, [1.0] * (DIM - 1)), (4, [0.0] * DIM), (5, [float("nan")] * DIM), (6, [float("inf")] + [1.0] * (DIM - 1)), (7, [None] + [1.0] * (DIM - 1)), (None, x[0].tolist())]
    bad = [(k if k is None else -k, v) for k, v in bad]
    more = ("x",) * 4
    df = spark.createDataFrame([(*r, *more) for r in [*data, *data[:9], *bad]], COLUMNS).repartition(4)
    data.sort()
    return df, np.array([k for k, _ in data]), unit(np.array([v for _, v in data], np.float32))


def neighbours(owners, kind, ids, u, k=5, least=0.8):
    out = set()
    for o, v in owners:
        s = np.round(u @ v, 9)
        near = sorted((-c, int(i)) for c, i in zip(s, ids) if c >= least and not (kind == "sample" and i == o))[:k]
        out |= {(kind, int(o), i) for _, i in near}
    return out


@pytest.mark.parametrize(("tile", "hot", "sample"), [(12_000, 1_000, 65_536), (60, 20, 65_536), (12_000, 1_000, 24)])
def test_nearest(spark, monkeypatch, tile, hot, sample):
    monkeypatch.setattr(vectors, "HOT", hot)
    df, ids, u = samples(spark)
    c = np.random.default_rng(9).normal(size=(6, DIM)).astype(np.float32)
    asked = [(100 + i, v.tolist()) for i, v in enumerate(np.concatenate([c, u[:20].astype(np.float32)]))] + [(99, None), (98, [0.0] * DIM)]
    got = knn.nearest(df, "sample_id", "v", queries=spark.createDataFrame(asked, "cid int, v array<float>"), dim=DIM, cell=80, tile=tile, sample=sample)
    got = [(r.kind, r.owner_id, r.neighbour_id) for r in got.collect()]
    uc = unit(np.array([v for _, v in asked[:-2]], np.float32))
    want = neighbours(zip(ids, u), "sample", ids, u) | neighbours(zip(range(100, 126), uc), "centroid", ids, u)
    assert len(got) == len(set(got)) and set(got) <= want | set(got)
    assert len(set(got) & want) >= 0.99 * len(want) and len(set(got) - want) <= 0.01 * len(want)


def test_more_samples_find_the_leaders_one_has_not(spark):
    rng = np.random.default_rng(12)
    x = np.repeat(unit(rng.normal(size=(300, 40))), 10, axis=0)
    x = unit(x + 0.02 * rng.normal(size=x.shape)).astype(np.float32)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    first, rest = knn.led_first(base, 40, 3_000, unit(x[:100]), 10_000, 20)
    assert len(first[0]) > 200 and rest[1] * len(rest[0]) < 1_500
    assert knn.led_first(base, 40, 3_000, unit(x[:400]), 10_000, 20) == (None, None)
    assert len(knn.led_first(base, 40, 3_000, unit(x[:100]), 5, 20)[0][0]) == 10  # as many as are allowed are there


def test_nearest_of_nothing(spark):
    df, _, _ = samples(spark)
    assert knn.nearest(df.limit(0), "sample_id", "v", dim=DIM).count() == 0
    assert knn.nearest(df.where("sample_id < 0"), "sample_id", "v", dim=DIM).count() == 0


def test_a_vector_is_in_every_cell_within_the_margin():
    u = unit(np.random.default_rng(4).normal(size=(1_500, DIM)))
    cells = knn.PivotCells(u[:800], 1_500, 0.3, cell=20)
    _, mask = cells.scores(u)
    s = u.astype(np.float32) @ cells.pivots.T
    best = s.argmax(1)
    apart = np.linalg.norm(cells.pivots[best][:, None] - cells.pivots[None], axis=2)
    led = (u.astype(np.float32) @ cells.leaders.T).max(1) if len(cells.leaders) else np.zeros(len(u))
    within = s.max(1)[:, None] - s <= 0.3 * apart - 1e-5
    within[led >= cells.near[1] - 1e-5] = False
    assert within.sum(1).max() > 8 and mask[:, cells.first :][within].all()


def based(spark, data, parts=1):
    return spark.createDataFrame(data, "id long, v array<float>").coalesce(parts)


def test_copies_take_no_places_of_the_sample(spark):
    x = np.random.default_rng(2).normal(size=(50, DIM)).astype(np.float32)
    base = based(spark, [(i, x[0].tolist()) for i in range(2_000)] + [(2_000 + i, v.tolist()) for i, v in enumerate(x)])
    assert survey(base, DIM)[0] == 50 and len(sample_units(base, DIM, 60, 50)) == 50


@pytest.mark.parametrize("seed", range(5))
def test_few_distinct_vectors_in_many_rows(spark, seed):
    x = np.random.default_rng(seed).normal(size=(3, DIM)).astype(np.float32)
    df = spark.range(20_000).select(F.col("id").alias("sample_id"), F.element_at(F.array(*(F.array(*map(F.lit, v.tolist())) for v in x)), (F.col("id") % 3 + 1).cast("int")).cast("array<float>").alias("v"))
    assert knn.nearest(df, "sample_id", "v", dim=DIM).count() == 100_000
    assert mixture.clusters(df, "sample_id", "v", dim=DIM).count() == 20_000


def test_a_sample_is_never_empty_where_a_vector_is_usable(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3, DIM)).astype(np.float32)
    assert len(sample_units(based(spark, [(i, x[i].tolist()) for i in range(3)]), DIM, 2, 3)) == 2
    unusable = spark.range(50_000).select("id", F.array_repeat(F.lit(0.0), DIM).cast("array<float>").alias("v"))
    one = based(spark, [(7, rng.normal(size=DIM).tolist())])
    base = unusable.union(one)
    assert survey(base, DIM)[0] == 1 and len(sample_units(base, DIM, 4096, 1)) == 1
    assert survey(unusable, DIM)[0] == 0 and len(sample_units(unusable, DIM, 4096, 0)) == 0
    assert len(sample_units(base, DIM, 4096, 10**12)) == 1  # the count is far too high: nothing is below the bound


def test_the_bound_of_hashes_holds_for_any_number_of_rows():
    for n in (10, 10**6, 10**12, 10**18):
        share = (1.3 * 65_536 + 200) / max(n, 10**5)
        assert abs((hash_bound(share) + 2**63) / 2**64 - share) <= 1e-9 * share + 1e-18


def test_a_vector_in_half_of_the_rows_is_one_row_of_its_tile(spark):
    df, ids, u = samples(spark, 3_000)
    base = df.where("sample_id is not null").select(F.col("sample_id").alias("id"), "v")
    distinct, hot = survey(base, DIM, 100)
    cold, whole = split_hot(base, hot, 6, DIM)
    assert hot.count() == 1 and whole.count() == 1 and cold.count() + 3_001 <= base.count()
    assert whole.first()["ids"] == sorted(i for i, v in zip(ids, u) if abs(v @ u[-1] - 1) < 1e-12)[:6]


def test_clusters_with_copies_in_many_batches(spark, monkeypatch):
    monkeypatch.setattr(vectors, "REPEATED", 100)
    x = unit(np.random.default_rng(17).normal(size=(40, DIM))).astype(np.float16).astype(np.float32)
    df = spark.createDataFrame([(i, x[i % 40].tolist()) for i in range(3_200)], "sample_id long, v array<float>").repartition(20, "sample_id")
    largest, before = [], mixture.grouped

    def counted(rows, key, function, schema):
        if key == "tile":
            largest.append(rows.groupBy(key).count().agg(F.max("count")).first()[0])
        return before(rows, key, function, schema)

    monkeypatch.setattr(mixture, "grouped", counted)
    got = mixture.clusters(df, "sample_id", "v", dim=DIM, least=0.999)
    assert rows(got) == {(i % 40, i, i % 40) for i in range(3_200)} and got.count() == 3_200
    assert largest == [40]


def test_a_block_of_vectors_does_not_take_the_components_parameters_again(monkeypatch):
    calls, before = [], mixture._coefficients
    u = unit(np.random.default_rng(18).normal(size=(300, DIM)))
    m = mixture.Mixture(u, 300, cell=20)
    monkeypatch.setattr(mixture, "_coefficients", lambda *a: calls.append(1) or before(*a))
    monkeypatch.setattr(mixture, "BLOCK", 64)
    m._ready = None
    home, mask = m.scores(u)
    assert len(calls) == 1 and mask[np.arange(300), home].all()


def test_copies_in_many_batches_are_one_row_of_a_tile(spark, monkeypatch):
    monkeypatch.setattr(vectors, "REPEATED", 100)
    x = unit(np.random.default_rng(14).normal(size=(40, DIM))).astype(np.float16).astype(np.float32)
    df = spark.createDataFrame([(i, x[i % 40].tolist()) for i in range(1_200)], "sample_id long, v array<float>").repartition(30, "sample_id")
    largest, before = [], knn.grouped

    def counted(rows, key, function, schema):
        largest.append(rows.groupBy(key).count().agg(F.max("count")).first()[0])
        return before(rows, key, function, schema)

    monkeypatch.setattr(knn, "grouped", counted)
    got = knn.nearest(df, "sample_id", "v", dim=DIM, least=0.999).select("owner_id", "neighbour_id")
    assert rows(got) == {(i, j) for i in range(1_200) for j in [j for j in range(i % 40, 1_200, 40) if j != i][:5]} and got.count() == 6_000
    assert largest[0] <= 40


def test_scores_of_many_cells_take_little_memory():
    rng = np.random.default_rng(15)
    cells = knn.PivotCells(unit(rng.normal(size=(2_000, 8))), 2_000, 0.12, cell=40)
    cells.leaders = unit(rng.normal(size=(150_000, 8))).astype(np.float32)
    cells.cell_of, cells.first, cells.tiles = np.arange(150_000) % 100, 100, np.ones(100 + len(cells.pivots), np.int64)
    u = unit(rng.normal(size=(256, 8)))
    tracemalloc.start()
    cells.scores(u)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    cells.tiles = np.ones(40_000, np.int64)
    assert cells.rows() * 40_000 <= vectors.FLAGS


def test_pairs_of_ids_are_ranked_in_parts(monkeypatch):
    rng = np.random.default_rng(16)
    u = unit(rng.normal(size=(60, DIM)))
    points = [(p, [3 * i, 3 * i + 1, 3 * i + 2]) for i, p in enumerate(vectors.pack(u.astype(np.float32)))]
    owners = [(p, i, 0) for p, i in points]
    whole = knn.search_tile(points, owners, DIM, 5, 0.3, 20, 12)
    monkeypatch.setattr(knn, "PAIRS", 10)
    parts = knn.search_tile(points, owners, DIM, 5, 0.3, 20, 12)
    assert len(whole[1]) == 900 and {(*map(int, x), float(c)) for *x, c in zip(*whole[0], whole[1])} == {(*map(int, x), float(c)) for *x, c in zip(*parts[0], parts[1])}


def test_collisions_find_what_is_near():
    rng = np.random.default_rng(1)
    u = unit(rng.normal(size=(400, 96)))
    near = unit(u[:50] + 0.03 * rng.normal(size=(50, 96)))
    c = knn.Collisions(u, near, 20, 12)
    assert c.candidates(np.arange(50), 0.37)[np.arange(50), np.arange(50)].mean() > 0.97
    assert c.candidates(np.arange(50), 0.37).mean() < 0.03


def grouped(ids, u, least=0.8, size=3):
    label, out = mixture.connected(u, least), set()
    s = u @ u.T >= least
    for i in range(len(u)):  # connected() itself, by the definition
        assert (label[s[i]] == label[i]).all()
    for g in range(label.max() + 1):
        p = np.flatnonzero(label == g)
        if len(p) < size:
            continue
        total = u[p].sum(0)
        mean = np.round((u[p] @ total - (u[p] ** 2).sum(1)) / (len(p) - 1), 9)
        typical = min(zip(-mean, ids[p]))[1]
        out |= {(int(ids[p].min()), int(i), int(typical)) for i in ids[p]}
    return out


@pytest.mark.parametrize(("copies", "tile", "margin"), [(40, 12_000, 0.5), (200, 12_000, 0.5), (10, 60, 0.5), (10, 12_000, 3.0), (201, 12_000, 0.5)])
def test_clusters(spark, monkeypatch, copies, tile, margin):
    monkeypatch.setattr(mixture, "CELL", 40)
    monkeypatch.setattr(vectors, "HOT", 100 if copies == 201 else 1_000)
    df, ids, u = samples(spark, copies)
    got = mixture.clusters(df, "sample_id", "v", dim=DIM, tile=tile, margin=margin)
    assert rows(got) == grouped(ids, u) and got.count() == len(rows(got))


@pytest.mark.parametrize(("size", "dim", "least"), [(1, 4, 0.8), (700, 3, 0.9999), (700, 3, 0.8), (700, 6, 0.95), (700, 24, 0.8)])
def test_connected_sets_are_those_of_all_pairs(size, dim, least):
    u = unit(np.random.default_rng(7).normal(size=(size, dim)))
    want, near = np.arange(size), u @ u.T >= least
    while True:
        least_near = np.where(near, want, size).min(1)
        if (least_near == want).all():
            break
        want = least_near
    label = mixture.connected(u, least)
    assert len({*zip(label.tolist(), want.tolist())}) == len({*label.tolist()}) == len({*want.tolist()})


def test_lone_vectors_are_not_looked_at_one_by_one():
    u = unit(np.random.default_rng(5).normal(size=(3_000, 96)))
    profile = cProfile.Profile()
    label = profile.runcall(mixture.connected, u, 0.8)
    assert len({*label.tolist()}) == 3_000 and sum(x.callcount for x in profile.getstats()) < 2_000


def test_clusters_read_the_table_four_times(spark):
    df, ids, u = samples(spark)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    got = mixture.clusters(df.mapInArrow(counted, df.schema), "sample_id", "v", dim=DIM)
    assert rows(got) == grouped(ids, u)
    assert seen.value <= 4 * df.count()  # to count, for mean and covariances, into shares, and to place; then from what was placed


def test_a_vector_is_in_every_component_within_the_margin():
    u = unit(np.random.default_rng(6).normal(size=(900, DIM)))
    m = mixture.Mixture(u, 900, 3.0, cell=15)
    _, mask = m.scores(u)
    x = m.reduced(u).astype(np.float64)
    d = x[:, None] - m.means
    s = np.log(m.weights) - 0.5 * (np.log(2 * np.pi * m.variances) + d * d / m.variances).sum(2)
    slope, best = d / m.variances, s.argmax(1)
    apart = np.linalg.norm(slope[np.arange(len(u)), best][:, None] - slope, axis=2)
    row, col = np.nonzero(s.max(1)[:, None] - s <= 3.0 * apart - 1e-3)
    assert np.bincount(row).max() > 12 and mask[row, m.cell_of[col]].all()


def test_a_fit_never_holds_all_vectors_by_all_components():
    u = unit(np.random.default_rng(4).normal(size=(16_000, DIM)))
    tracemalloc.start()
    m = mixture.Mixture(u, 25_000_000, support=(10**6,), rounds=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(m.weights) == 2_000 and peak < 100e6  # 16,000 x 2,000 numbers are 128 MB


@pytest.mark.parametrize(("share_rows", "tile"), [(200_000, 12_000), (600, 300)])
def test_the_mixture_is_of_all_vectors(spark, monkeypatch, share_rows, tile):
    monkeypatch.setattr(mixture, "SHARE", 1_000, raising=False)
    monkeypatch.setattr(mixture, "SHARE_ROWS", share_rows, raising=False)
    rng = np.random.default_rng(11)
    centres = unit(rng.normal(size=(150, 24)))
    x = np.concatenate([c + rng.normal(scale=0.07, size=(rng.integers(1, 50), 24)) for c in centres] + [rng.normal(size=(6_000, 24))])[:4_700].astype(np.float32)
    ids = rng.permutation(10 * len(x))[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "sample_id long, v array<float>").repartition(4)
    used, broadcast = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: used.append(v) or broadcast(v))
    got = mixture.clusters(df, "sample_id", "v", dim=24, tile=tile)
    order, u = np.argsort(ids), unit(x)
    assert rows(got) == grouped(ids[order], u[order])
    m = next(v for v in used if isinstance(v, mixture.Mixture))
    _, mask = m.scores(u)
    assert np.abs(m.mean - u.mean(0)).max() < 1e-9 and np.abs(m.scale - u.std(0)).max() < 1e-9
    assert abs(m.weights.sum() - 1) < 1e-6 and np.abs(m.weights @ m.means).max() < 1e-3  # the mean of what it was fitted on
    assert (m.tiles == np.maximum(1, np.ceil(mask.sum(0) / tile))).all() and (m.tiles.max() > 1) == (tile == 300)


def test_clusters_of_nothing_and_components(spark):
    df, ids, _ = samples(spark)
    assert mixture.clusters(df.limit(0), "sample_id", "v", dim=DIM).count() == 0
    assert mixture.clusters(df.where("sample_id < 0"), "sample_id", "v", dim=DIM).count() == 0
    parts = mixture.mixture_groups(df, "sample_id", "v", dim=DIM).collect()
    assert len(parts) == len(ids) == len({r.sample_id for r in parts})
    assert mixture.mixture_groups(df.limit(0), "sample_id", "v", dim=DIM).count() == 0


def test_as_many_groups_as_are_asked_for(spark):
    df, ids, u = samples(spark, 30)
    df = df.withColumn("kind", F.when(F.col("sample_id") % 3 == 0, "a").when(F.col("sample_id") % 3 == 1, "b"))
    got = mixture.mixture_groups(df, "sample_id", "v", by="kind", numbers={"a": 25, "b": 10**6}, dim=DIM).collect()
    assert {r.sample_id for r in got} == {*ids.tolist()} and len(got) == len(ids)
    of = {k: [r for r in got if r.kind == k] for k in ("a", "b", None)}
    assert len({r.component for r in of["a"]}) == 25
    assert len({r.component for r in of["b"]}) == len({tuple(np.round(u[ids.tolist().index(r.sample_id)], 9)) for r in of["b"]})
    for k, own in of.items():
        for c in {r.component for r in own}:
            members = [r for r in own if r.component == c]
            assert {r["size"] for r in members} == {len(members)} and len({r.typical_id for r in members}) == 1 and members[0].typical_id in {r.sample_id for r in members}


def test_a_mixture_finds_its_groups():
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(12, DIM)))
    truth = rng.integers(0, 12, 3_000)
    u = unit(centres[truth] + 0.05 * rng.normal(size=(3_000, DIM)))
    for k in (12, None):
        f = mixture.fitted_mixture(u[:1_500], k)
        home, _ = mixture.densest(f, u[1_500:])
        pure = sum(np.bincount(truth[1_500:][home == c]).max() for c in np.unique(home)) / 1_500
        assert pure > 0.95 and (k is None or len(f["w"]) == 12)
    w, m, v = f["w"], f["m"], f["v"]
    x = ((u - f["mean"]) / f["scale"]) @ f["turn"]
    d = x[:, None] - m
    s = np.log(w) - 0.5 * (np.log(2 * np.pi * v) + d * d / v).sum(2)
    assert (mixture.densest(f, u)[0] == s.argmax(1)).mean() > 0.999


# -- top N

RUN = "qid string, did string, s double, g string, d string, rank string, i string"


def run_rows():
    rng = random.Random(2)
    data = [("hot", f"d{rng.randrange(900)}", rng.choice([1.0, 2.5, 2.5, rng.random()])) for _ in range(4000)]
    data += [(f"q{rng.randrange(400)}", f"d{rng.randrange(30)}", float(rng.randrange(4))) for _ in range(6000)]
    data += [("z", "é", 0.0), ("z", "z", -0.0), ("z", "Z", 0.0), ("z", "😀", float("inf")), ("z", "a", float("-inf")), ("tie", "", 1.0), ("", "x", 1.0)]
    bad = [(None, "d", 1.0), ("q0", None, 9.0), ("q0", "d", None), ("q0", "d", float("nan"))]
    return data, bad


@pytest.mark.parametrize(("file_rows", "group_rows"), [(1_000_000, 4096), (700, 64), (150, 16)])
def test_top_n(spark, file_rows, group_rows):
    data, bad = run_rows()
    df = spark.createDataFrame([(*r, *("x",) * 4) for r in data + bad + data[:50]], RUN).repartition(7)
    best = {}
    for q, d, s in data:
        best.setdefault(q, {})[d] = max(s, best.get(q, {}).get(d, s))
    want = {(q, d, s + 0.0, i + 1) for q, own in best.items() for i, (d, s) in enumerate(sorted(own.items(), key=lambda x: (-x[1], x[0].encode()))[:10])}
    got = topn.top_n(df, "qid", "did", "s", 10, file_rows=file_rows, row_group_rows=group_rows)
    assert rows(got) == want and got.count() == len(want)
    assert topn.top_n(df.limit(0), "qid", "did", "s", 10).count() == 0
    assert topn.top_n(df.where("did is null"), "qid", "did", "s", 10).count() == 0


def test_a_clustered_table_stays(spark, tmp_path):
    df = spark.createDataFrame([(f"q{i % 7}", f"d{i % 50}", float(i * 31 % 101)) for i in range(3_000)], "qid string, did string, s double")
    path = topn.cluster_by_group(df, "qid", "did", "s", file_rows=500, row_group_rows=50, path=str(tmp_path / "t"))
    for n in (1, 3, 10):
        assert rows(topn.top_n_clustered(spark, path, n, group="qid", item="did", score="s")) == rows(topn.top_n(df, "qid", "did", "s", n))
    with pytest.raises(ValueError, match="at least 1"):
        topn.top_n_clustered(spark, path, 0)


def test_row_groups_of_a_hot_group_are_skipped(spark):
    df = spark.createDataFrame([("hot", f"d{i}", float(i % 997)) for i in range(20_000)], "qid string, did string, s double")
    path = topn.cluster_by_group(df, "qid", "did", "s", file_rows=10_000, row_group_rows=500)
    counts: dict[str, int] = {}
    for f in spark.read.parquet(path).inputFiles():
        list(topn.top_of_file(f, 10, counts))
    assert counts["skipped"] > 0.7 * counts["seen"]
