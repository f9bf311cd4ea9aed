"""Clustering and hard negatives against brute force, over ties, copies, awkward rows and small cells."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from sievegrid.llm import clustering, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, vec string, rank int"


def rows(seed=1, n=280, size=64, hot=90):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(size)] for _ in range(6)]
    made = []
    for i in range(n):
        c = i % 6
        v = [x + rng.gauss(0, 0.15) for x in centres[c]]
        made.append([i * 5, v, rng.choice([c, c, c, (c + 3) % 10])])
    for i in range(hot):
        made[3 * i][1] = list(made[0][1])  # copies of one vector
    made += [[7, None, 1], [11, [None] * size, 2], [13, [float("nan")] * size, 2], [17, [math.inf] + [0.0] * (size - 1), 3], [19, [0.0] * size, None], [None, [0.1] * size, 2], [100_000, [0.0] * size, 9], [200_000, [-3.0] * size, 9]]
    return [(*m, "clash", "clash", 1) for m in made]


def kept(made, scale, size=None):
    return [(r[0], r[2], np.floor(scale * np.array(r[1], np.float32).astype(float)).astype(int)) for r in made if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1]) and size in (None, len(r[1]))]


def plain_clusters(made, k, rounds):
    ok = kept(made, 1024, 64)
    x = np.array([r[2] for r in ok])
    order = sorted((i for i in range(len(ok))), key=lambda i: (ok[i][0] is None, hashlib.sha256(f"3:{ok[i][0]}".encode()).hexdigest(), ok[i][2].tolist()))
    c = x[order[:k]].copy()
    for step in range(rounds + 1):
        d = ((x[:, None, :] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        for j in range(len(c) if step < rounds else 0):
            if (a == j).any():
                c[j] = x[a == j].sum(0) // (a == j).sum()
    m = d[np.arange(len(a)), a]
    return Counter((ok[i][0], int(a[i]), int(m[i]), int(m[a == a[i]].sum()), int(m.sum()), hashlib.sha256(",".join(map(str, c[a[i]].tolist())).encode()).hexdigest()) for i in range(len(ok)))


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (1, 2), (400, 1), (3, 0)])
def test_clusters(spark, k, rounds):
    made = [*rows(), (5, [0.5] * 63, 1, None, None, None)]
    got = Counter(map(tuple, clustering.cluster(spark.createDataFrame([*made, made[1]], SCHEMA), k, rounds).collect()))
    assert got == plain_clusters([*made, made[1]], k, rounds)


def test_bounds_save_distances_and_hold():
    rng = np.random.default_rng(2)
    centers = rng.integers(-4000, 4000, (8, 64))
    x = (centers[rng.integers(0, 8, 3000)] + rng.integers(-300, 300, (3000, 64))).astype(np.int64)
    state = clustering.rescanned(x, centers, 3)
    for _ in range(5):
        new = centers + rng.integers(-20, 20, centers.shape)
        shift = np.sqrt(((new - centers) ** 2).sum(1)) * (1 + clustering.MARGIN)
        cluster, nexts = state[0], state[2]
        upper, low, rest = clustering.moved_bounds(cluster, state[1], nexts, state[3], state[4], shift)
        *state, scanned = clustering.assigned(x, new, cluster, upper, nexts, low, rest)
        d = ((x[:, None, :] - new[None]) ** 2).sum(2)
        assert (state[0] == d.argmin(1)).all() and scanned < len(x)
        true = np.sqrt(d)
        assert (state[1] >= true[np.arange(len(x)), state[0]]).all()
        assert (state[3] <= np.take_along_axis(true, state[2], 1)).all()
        centers = new
    far = rng.integers(-4000, 4000, centers.shape)  # a jump: nearly everything is scanned again
    shift = np.sqrt(((far - centers) ** 2).sum(1)) * (1 + clustering.MARGIN)
    upper, low, rest = clustering.moved_bounds(state[0], state[1], state[2], state[3], state[4], shift)
    got = clustering.assigned(x, far, state[0], upper, state[2], low, rest)[0]
    assert (got == ((x[:, None, :] - far[None]) ** 2).sum(2).argmin(1)).all()


def test_clusters_of_an_empty_table(spark):
    assert clustering.cluster(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_negatives(made, every):
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in kept(made, 256) if i is not None and lab is not None]
    first = {}
    for r in sorted(ok, key=lambda r: (r[0], r[1], r[2].tolist())):
        first.setdefault(r[0], r)
    ok = list(first.values())
    x, out = np.array([r[2] for r in ok]), Counter()
    for a, (i, lab, v) in enumerate(ok):
        if i % every:
            continue
        s = x @ v
        order = sorted((j for j in range(len(ok)) if j != a), key=lambda j: (-s[j], ok[j][0]))
        for p in [j for j in order if ok[j][1] == lab][:5]:
            fit = [j for j in order if ok[j][1] != lab and 80 * s[p] <= 100 * s[j] <= 100 * s[p]][:5]
            out.update((i, ok[p][0], k + 1, ok[j][0], int(s[p]), int(s[j])) for k, j in enumerate(fit))
    return out


@pytest.mark.parametrize(("cell", "group", "near"), [(16_384, 2048, 4), (16, 3, 1)])
def test_hard_negatives(spark, monkeypatch, cell, group, near):
    monkeypatch.setattr(hard_negatives, "CELL", cell)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    monkeypatch.setattr(hard_negatives, "NEAR", near)
    made = rows()
    repeated = [*made, made[4], (made[5][0], [0.2] * 64, 3, None, None, None)]
    got = Counter(map(tuple, hard_negatives.mine(spark.createDataFrame(repeated, SCHEMA), every=20).collect()))
    assert got == plain_negatives(repeated, 20) and len(got) > 200


def test_hard_negatives_of_small_tables(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = spark.createDataFrame([(100, [0.1] * 64, 1, None, None, None), (3, [0.1] * 64, 2, None, None, None)], SCHEMA)
    assert hard_negatives.mine(alone).count() == 0
    zero = [(i, [0.0] * 4, i % 2, None, None, None) for i in range(100, 112)]
    assert Counter(map(tuple, hard_negatives.mine(spark.createDataFrame(zero, SCHEMA)).collect())) == plain_negatives(zero, 100)
