import random

import numpy as np
import pyarrow as pa

from passagemill.llm import components as module
from passagemill.llm.common import stage
from passagemill.llm.components import components


def plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {x: root(x) for x in parent}


def test_rounds_have_small_plans(spark, shared):
    """Spark keeps the plan and metrics of every query in the driver: a round is one join and three exchanges."""
    rng = random.Random(4)
    edges = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(1500, 1600)] * 2
    exchanges = []

    def write(df, name):
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return stage(df, name)

    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b", write=write).collect()
    got = {r.node: r.root for r in rows}
    assert len(got) == len(rows) and got == plain(edges)
    assert max(exchanges[1:]) <= 3 and len(exchanges) <= 10


def test_blocks_of_any_size(monkeypatch):
    rng = random.Random(5)
    for size in (1, 3, 1 << 18):
        monkeypatch.setattr(module, "BLOCK", size)
        for _ in range(60):
            pairs = [(rng.randint(-20, 20), rng.randint(-20, 20)) for _ in range(rng.randint(1, 60))]
            edges = sorted((max(p), min(p)) for p in pairs if p[0] != p[1])
            cut = sorted(rng.randint(0, len(edges)) for _ in range(3))
            frames = [pa.RecordBatch.from_arrays([pa.array(np.array([e[i] for e in edges[a:b]], np.int64)) for i in (0, 1)], names=["u", "v"]) for a, b in zip([0, *cut], [*cut, len(edges)])]
            fewer = [tuple(r.values()) for f in module._contracted(iter(frames)) for r in f.to_pylist()]
            hung = [tuple(r.values()) for f in module._hung(iter(frames)) for r in f.to_pylist()]
            assert len(fewer) <= len(edges) and plain(fewer) == plain(edges)
            assert len(hung) <= len(edges) and plain([h[:2] for h in hung]) == plain(edges)
            assert sorted(h[0] for h in hung if h[2]) == sorted({u for u, _ in edges})
