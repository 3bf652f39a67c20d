"""Guided search on known surfaces, and variance shares against integration on a grid."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starflow.operators import learn, search
from starflow.operators.search import Choice, Number
from starflow.operators.trees import Forest, Tree

SPACE = {
    "x": Number(-5, 5), "rate": Number(1e-4, 1, log=True), "depth": Number(1, 20, whole=True), "mode": Choice(("p", "q", "r")),
    "layers": Number(1, 2, whole=True), "width": Number(4, 64, whole=True, when=lambda p: p["layers"] == 2),
}


def surface(p):
    if not p:
        return -100.0
    bonus = {"p": 0.0, "q": 1.0, "r": 0.3}[p["mode"]] - (abs(p["width"] - 40) / 30 if p["layers"] == 2 else 0.8)
    return bonus - (p["x"] - 2) ** 2 / 4 - (math.log10(p["rate"]) + 2) ** 2 - abs(p["depth"] - 7) / 5


def test_guided_search_beats_random_draws():
    best = lambda seed, start: max(v for _, v in search.searched(surface, SPACE, 80, seed, start=start))
    guided, blind = [best(s, 10) for s in range(12)], [best(s, 80) for s in range(12)]
    assert np.mean(guided) > np.mean(blind) + 0.3 and sum(g > b for g, b in zip(guided, blind)) >= 9


def test_settings_stay_in_their_space_and_repeat():
    done = search.searched(surface, SPACE, 60, 4, first=[{}])
    assert done[0] == ({}, -100.0) and done == search.searched(surface, SPACE, 60, 4, first=[{}])
    for p, _ in done[1:]:
        assert -5 <= p["x"] <= 5 and 1e-4 <= p["rate"] <= 1 and p["depth"] in range(1, 21) and p["mode"] in "pqr"
        assert ("width" in p) == (p["layers"] == 2) and (p["layers"] == 1 or p["width"] in range(4, 65))
    assert search.searched(surface, SPACE, 0, 1) == []


def test_parzen_density():
    for seen in ([], [0.1, 0.11, 0.7], [1.0] * 40):
        made = search.Parzen(seen, (0.0, 1.0))
        grid = (np.arange(20_000) + 0.5) / 20_000
        density = np.exp([made.log_density(x) for x in grid])
        assert density.mean() == pytest.approx(1, abs=1e-3)
        drawn = [made.draw(random.Random(i)) for i in range(3000)]
        assert np.mean(drawn) == pytest.approx((grid * density).mean(), abs=0.03) and 0 <= min(drawn) <= max(drawn) <= 1


def grown(draw, width, depth, low, high):
    """A random tree over a box."""
    nodes = []

    def grow(d, box):
        i = len(nodes)
        nodes.append(None)
        if d == 0 or draw.random() < 0.2:
            nodes[i] = (-1, 0.0, 0, 0, draw.gauss(0, 1))
            return i
        f = draw.randrange(width)
        t = draw.uniform(*box[f])
        left = grow(d - 1, [*box[:f], (box[f][0], t), *box[f + 1 :]])
        right = grow(d - 1, [*box[:f], (t, box[f][1]), *box[f + 1 :]])
        nodes[i] = (f, t, left, right, 0.0)
        return i

    grow(depth, list(zip(low, high)))
    f, t, l, r, v = (np.array(x) for x in zip(*nodes))
    return Tree(f, t, l, r, v[:, None], np.ones(len(f)))


def test_variance_shares_equal_integration():
    draw, low, high = random.Random(3), [0.0, -2.0, 10.0], [1.0, 2.0, 50.0]
    tree = grown(draw, 3, 5, low, high)
    axes = [np.linspace(a, b, 120, endpoint=False) + (b - a) / 240 for a, b in zip(low, high)]
    cube = tree.values(np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3))[:, 0].reshape(120, 120, 120)
    single, double = search.variance_shares(Forest([tree], [1.0]), np.array(low), np.array(high))
    alone = [cube.mean(tuple({0, 1, 2} - {j})).var() / cube.var() for j in range(3)]
    assert single == pytest.approx(alone, abs=0.02)
    for i, j in ((0, 1), (0, 2), (1, 2)):
        both = cube.mean(3 - i - j).var() / cube.var() - alone[i] - alone[j]
        assert double[i, j] == double[j, i] == pytest.approx(both, abs=0.02)


def test_variance_shares_of_an_additive_function():
    """One split a column, four boxes: shares are exact and nothing is left for the pair."""
    f, t, l, r = np.array([0, 1, -1, -1, 1, -1, -1]), np.array([0.5, 0.25, 0, 0, 0.25, 0, 0]), np.array([1, 2, 0, 0, 5, 0, 0]), np.array([4, 3, 0, 0, 6, 0, 0])
    tree = Tree(f, t, l, r, np.array([0, 0, 0.0, 4.0, 0, 2.0, 6.0])[:, None], np.ones(7))
    single, double = search.variance_shares(Forest([tree], [1.0]), np.zeros(3), np.ones(3))
    assert single == pytest.approx([1 / 4, 3 / 4, 0]) and double == pytest.approx(np.zeros((3, 3)), abs=1e-12)


def test_importances_of_trials(spark):
    draw = random.Random(1)
    trials = []
    for i in range(120):
        p = {"a": draw.uniform(0, 1), "b": draw.uniform(0, 1), "c": draw.uniform(0, 1), "same": 3} | ({"rare": 1.0} if i % 2 else {})
        trials.append({"trial": i, "score": 3 * p["a"] + (p["b"] > 0.5) * (p["c"] > 0.5), "both": p["a"] + 2 * (p["b"] > 0.5) * (p["c"] > 0.5), "seconds": p["c"], "params": p})
    found = {r.setting: r.importance for r in learn.setting_importances(spark, trials).collect()}
    assert found["a"] > 0.6 and found["a"] > 3 * max(found["b"], found["c"]) and found["same"] == found["rare"] == 0
    pairs = learn.setting_interactions(spark, trials, "both").collect()
    assert pairs[0].setting == "b x c" and pairs[0].importance > 0.15 and pairs[1].importance < 0.1
    assert learn.setting_importances(spark, trials, "seconds").first().setting == "c"
    assert [r.importance for r in learn.setting_importances(spark, trials[:1]).collect()] == [0.0] * 4


def test_guided_search_of_a_model(spark):
    draw = random.Random(2)
    rows = [(i, x := draw.gauss(0, 1), y := draw.gauss(0, 1), "ab"[int(x * y > 0)]) for i in range(160)]
    df = spark.createDataFrame(rows, "id long, x double, y double, label string")
    space = {"maxDepth": Number(1, 6, whole=True), "numTrees": Number(3, 12, whole=True)}
    model, params, trials = learn.optimise(df, ["x", "y"], trials=6, k=2, start=3, space=space)
    assert [t["trial"] for t in trials] == list(range(1, 7)) and trials[0]["params"] == {} and all(t["seconds"] > 0 for t in trials)
    best = max(trials, key=lambda t: t["score"])
    assert params == best["params"] and model.transform(df).where(F.col("class") == F.col("label")).count() > 120
    assert learn.model_params({"layers": 2, "width_1": 9, "width_2": 5, "maxIter": 7}) == {"hidden": [9, 5], "maxIter": 7}
    nn, _, seen = learn.optimise(df, ["x", "y"], kind="nn", trials=2, k=2, start=1, space=learn.SPACES["nn"] | {"maxIter": Number(5, 9, whole=True)})
    assert len(seen) == 2 and nn.transform(df).count() == 160


def test_selection_summary(spark):
    state = {"a": "accepted", "b": "accepted", "c": "accepted", "d": "rejected", "e": "rejected", "f": "tentative"}
    history = [(t, f, v + t / 10, False) for t in (1, 2) for f, v in zip("abcdef", (5.0, 4.0, 2.0, 0.5, 0.7, 1.0))] + [(t, f"shadow_{f}", t * 0.1 * (k + 1), True) for t in (1, 2) for k, f in enumerate("ab")]
    rows = lambda **k: [(r.place, r.feature, round(r["mean"], 6), round(r.deviation, 6), r.kind) for r in learn.selection_summary(spark, state, history, **k).orderBy("place").collect()]
    assert rows(top=1, rejected=1) == [(1, "a", 5.15, 0.05, "accepted"), (2, "Other Accepted", 3.15, 0.05, "other"), (3, "Mean Shadow", 0.225, 0.075, "shadow"), (4, "e", 0.85, 0.05, "rejected")]
    assert [r[1] for r in rows(rejected=True)] == ["a", "b", "c", "Mean Shadow", "e", "d"]
    assert [r[1] for r in rows(top=2, other=False, shadow=False)] == ["a", "b"] and [r[1] for r in rows(top=9)] == ["a", "b", "c", "Mean Shadow"]
