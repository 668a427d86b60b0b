"""Small clusters whose members are far from each other are found, however the vectors are divided into partitions."""

import collections

import numpy as np

from shardloom.llm import p04_clusters as CL
from shardloom.llm.vectors import usable_vectors


def spread(rng, n, low, high):
    c = rng.standard_normal(64)
    c /= np.linalg.norm(c)
    x = rng.standard_normal((n, 64))
    x -= (x @ c)[:, None] * c
    x -= x.mean(axis=0)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = rng.uniform(low, high, (n, 1))
    return cos * c + np.sqrt(1 - cos**2) * x


def test_wide_and_small_clusters(spark):
    rng = np.random.default_rng(4)
    sizes = [(12, 0.785, 0.8), (12, 0.8, 0.83), (30, 0.77, 0.8), (100, 0.765, 0.78), (300, 0.85, 0.95)]
    x = np.concatenate([spread(rng, *s) for s in sizes] + [rng.standard_normal((400, 64))])
    truth = np.repeat(np.arange(6), [s[0] for s in sizes] + [400])
    order = rng.permutation(len(x))
    rows = [(f"r{i:04d}", x[i].astype("f4").tolist(), 1) for i in order]
    df = spark.createDataFrame(rows, "rec_id string, vec array<float>, encoded_at int").repartition(12)
    groups = collections.defaultdict(list)
    for r in CL.find_clusters(usable_vectors(df)).collect():
        groups[r.cluster].append(truth[int(r.rec[1:])])
    assert sorted(tuple(set(g)) for g in groups.values()) == [(0,), (1,), (2,), (3,), (4,)]
    assert all(len(g) >= 0.9 * sizes[g[0]][0] for g in groups.values())
