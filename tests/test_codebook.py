import numpy as np
import pytest

from codelattice.operators import codebook
from codelattice.operators.codebook import Objective, Optimizer, gradient_of, load_state, loss_and_gradient, restart_unused, restarted, save_state, step_gradient, temperature, touched, train, train_distributed

RNG = np.random.default_rng(0)
D, Q, C = RNG.normal(size=(7, 4)), RNG.normal(size=(7, 4)), RNG.normal(size=(5, 4))


@pytest.mark.parametrize("o", [Objective(), Objective(weighted=True), Objective(soft=True), Objective(max_difference=True), Objective(soft=True, max_difference=True), Objective(weighted=True, max_difference=True), Objective(soft=True, kmeans=True), Objective(soft=True, entropy=0.3)])
def test_gradient_is_that_of_the_loss(o):
    t, e = 0.7, 1e-6
    _, g = loss_and_gradient(C, D, Q, o, t)
    for i in range(C.shape[0]):
        for j in range(C.shape[1]):
            up, down = C.copy(), C.copy()
            up[i, j] += e
            down[i, j] -= e
            slope = (loss_and_gradient(up, D, Q, o, t)[0] - loss_and_gradient(down, D, Q, o, t)[0]) / (2 * e)
            assert abs(slope - g[i, j]) < 1e-6


def test_objectives_that_need_soft_assignments():
    with pytest.raises(ValueError, match="soft"):
        Objective(kmeans=True)
    with pytest.raises(ValueError, match="soft"):
        Objective(entropy=1.0)


def test_temperature():
    o = Objective(initial_temperature=1.0, final_temperature=0.1)
    assert temperature(0, o, 10) == 1.0 and temperature(10, o, 10) == 0.1 and abs(temperature(5, o, 10) - 0.55) < 1e-12


def test_training_lowers_the_loss_and_repeats():
    x = np.concatenate([RNG.normal(m, 0.1, size=(200, 6)) for m in (-2, 0, 3)])
    c, losses = train(x, 8, steps=150, rate=0.05)
    assert np.mean(losses[-10:]) < np.mean(losses[:10])
    assert (train(x, 8, steps=150, rate=0.05)[0] == c).all()
    with pytest.raises(ValueError, match="centroids"):
        train(x[:3], 8)


def test_restart_takes_the_vectors_of_largest_error():
    c = np.array([[1.0, 0.0], [-9.0, -9.0]])
    d = np.array([[1.0, 0.1], [1.0, 5.0], [1.1, 0.0]])
    out = restart_unused(c, d, d, np.array([True, False]))
    assert (out[1] == d[1]).all() and (out[0] == c[0]).all()


@pytest.mark.parametrize("o", [Objective(), Objective(weighted=True), Objective(max_difference=True)])
def test_only_touched_centroids_have_a_gradient(o):
    loss, g = loss_and_gradient(C, D, Q, o)
    loss2, own, part = step_gradient(C, D, Q, o, 1.0)
    rest = np.setdiff1d(np.arange(len(C)), own)
    assert abs(loss - loss2) < 1e-12 and np.allclose(g[own], part) and not g[rest].any()


def test_touched_in_blocks():
    c, d = RNG.normal(size=(70_000, 3)), RNG.normal(size=(20, 3))
    order = np.argsort(-(d @ c.T), axis=1, kind="stable")
    assert (touched(c, d, True) == np.unique(order[:, :2])).all() and (touched(c, d, False) == np.unique(order[:, 0])).all()


def test_rate_rises_and_falls():
    o = Optimizer(np.zeros((1, 1)), 10, rate=1.0, warmup=4)
    seen = []
    for _ in range(10):
        seen.append(o.learning_rate())
        o.step(np.array([0]), np.array([[1.0]]))
    assert seen == [0.0, 0.25, 0.5, 0.75, 1.0, *(x / 6 for x in (5, 4, 3, 2, 1))]


def test_training_that_was_stopped_goes_on_as_if_it_was_not(spark, tmp_path):
    x = RNG.normal(size=(300, 5))
    options = {"steps": 40, "batch": 64, "restart": True}
    whole, losses = train(x, 6, **options)

    def stop(state):
        save_state(spark, str(tmp_path), state)
        raise InterruptedError

    with pytest.raises(InterruptedError):
        train(x, 6, **options, save=stop, save_steps=17)
    state = load_state(spark, str(tmp_path))
    again, rest = train(x, 6, **options, resume=state)
    assert state["at"] == 17 and np.allclose(again, whole) and np.allclose(rest, losses[17:])
    assert load_state(spark, str(tmp_path / "none")) is None


def frame(spark, x):
    return spark.createDataFrame([([float(y) for y in v],) for v in x], "v array<float>")


@pytest.mark.parametrize("o", [Objective(), Objective(max_difference=True), Objective(soft=True, entropy=0.2)])
def test_gradients_of_tasks_are_those_of_batches(spark, o):
    x = RNG.normal(size=(64, 4)).astype(np.float32).astype(float)
    c = RNG.normal(size=(6, 4)).astype(np.float32).astype(float)
    parts = [loss_and_gradient(c, x[a : a + 16], Q, o, 0.5) for a in range(0, 64, 16)]
    loss, own, g = gradient_of(frame(spark, x).coalesce(1), c, Q, o, 0.5, 16)
    want = np.mean([p[1] for p in parts], axis=0)
    full = np.zeros_like(c)
    full[own] = g
    assert abs(loss - np.mean([p[0] for p in parts])) < 1e-6 and np.allclose(full, want, atol=1e-6)


def test_training_beside_the_vectors(spark):
    x = np.concatenate([RNG.normal(m, 0.1, size=(100, 4)) for m in (-2, 0, 3)]).astype(np.float32)
    df = frame(spark, x).repartition(3)
    c, losses = train_distributed(df, 5, steps=12, batch=32, rows_a_step=100, rate=0.05, restart=True)
    assert c.shape == (5, 4) and np.mean(losses[-3:]) < np.mean(losses[:3])
    assert codebook.train_codebook(df, 5, most=10, steps=2, batch=32).count() == 5
    with pytest.raises(ValueError, match="centroids"):
        train_distributed(df, 301, steps=1)


def test_restarts_are_the_same_beside_the_vectors(spark):
    x = RNG.normal(size=(60, 4)).astype(np.float32).astype(float)
    c = np.concatenate([x[:3], np.full((2, 4), -50.0) * x[3:5]])
    assert np.allclose(restarted(frame(spark, x), c, Q), restart_unused(c, x, Q))
