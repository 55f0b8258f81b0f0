"""Components and layers against plain searches, and sequences cut into chunks against plain loops."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import components, ordered


def plain_layers(edges, nodes):
    after = {n: {d for s, d in edges if s == n and d in nodes} for n in nodes}

    def reach(n):
        seen, todo = {n}, [n]
        while todo:
            for d in after[todo.pop()] - seen:
                seen.add(d)
                todo.append(d)
        return seen

    reached = {n: reach(n) for n in nodes}
    of = {n: min(m for m in reached[n] if n in reached[m]) for n in nodes}
    layer = {}

    def depth(c):
        if c not in layer:
            layer[c] = max((depth(of[s]) + 1 for s in nodes for d in after[s] if of[d] == c and of[s] != c), default=0)
        return layer[c]

    return {n: (of[n], depth(of[n])) for n in nodes}


def test_components_and_layers(spark):
    rng = random.Random(9)
    graphs = {f"g{k}": ([(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)], {f"n{i}" for i in range(n)}) for k, (n, m) in enumerate([(1, 0), (3, 2), (12, 10), (12, 14), (20, 22), (30, 60)])}
    graphs["chain"] = ([(f"c{90 - i}", f"c{89 - i}") for i in range(30)] + [("c75", "c80"), ("c70", "elsewhere")], {f"c{i}" for i in range(60, 91)})
    edges = spark.createDataFrame([(k, *e, 1) for k, (es, _) in graphs.items() for e in es * 2], "repo_id string, src string, dst string, node int")
    nodes = spark.createDataFrame([(k, n) for k, (_, ns) in graphs.items() for n in ns], "repo_id string, node string")
    got = {}
    for r in components.layers(edges, nodes).collect():
        got.setdefault(r.repo_id, {})[r.node] = (r.component, r.layer)
    assert got == {k: plain_layers(es, ns) for k, (es, ns) in graphs.items()}
    assert components.layers(edges.limit(0), nodes.limit(0)).count() == 0


@pytest.mark.parametrize("most", [64, 12])
def test_small_graphs_are_a_row_and_others_take_rounds(spark, monkeypatch, most):
    rng = random.Random(11)
    graphs = {f"g{n}-{m}": ([(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)], {f"n{i}" for i in range(n)}) for n, m in [(2, 2), (12, 13), (13, 15), (63, 70), (64, 66), (64, 120), (65, 70)]}
    in_rounds, size = [], components.layers_in_rounds
    monkeypatch.setattr(components, "MOST_BITS", most)
    monkeypatch.setattr(components, "layers_in_rounds", lambda es, ns: in_rounds.extend(r.repo_id for r in ns.select("repo_id").distinct().collect()) or size(es, ns))
    edges = spark.createDataFrame([(k, *e) for k, (es, _) in graphs.items() for e in es], "repo_id string, src string, dst string")
    nodes = spark.createDataFrame([(k, n) for k, (_, ns) in graphs.items() for n in ns], "repo_id string, node string")
    got = {}
    for r in components.layers(edges, nodes).collect():
        got.setdefault(r.repo_id, {})[r.node] = (r.component, r.layer)
    assert got == {k: plain_layers(es, ns) for k, (es, ns) in graphs.items()}
    assert sorted(in_rounds) == sorted(k for k, (_, ns) in graphs.items() if len(ns) > most)
    if most == 64:
        found = {(r.repo_id, r.node): r.component for r in components.strong_components(edges, nodes).collect()}
        assert found == {(k, n): c for k, rows in got.items() for n, (c, _) in rows.items()}


@pytest.fixture
def sequence(spark):
    rng = random.Random(10)
    rows = [(rng.choice("aaaab"), i, rng.random() < 0.6, rng.choice([0, 1, 3, 40, 90])) for i in range(400)] + [("whole", i, True, 1) for i in range(60)] + [("none", i, False, 99) for i in range(20)] + [(None, i, i % 3 > 0, 7) for i in range(9)]
    rng.shuffle(rows)
    return sorted(rows, key=lambda r: (str(r[0]), r[1])), spark.createDataFrame(rows, "key string, at int, hit boolean, size long").repartition(5)


@pytest.mark.parametrize("chunk", [1, 7])
def test_islands_across_chunks(sequence, chunk):
    rows, df = sequence
    want = []
    for key, own in groupby(rows, key=lambda r: r[0]):
        for hit, run in groupby(own, key=lambda r: r[2]):
            run = list(run)
            if hit and len(run) >= 2:
                want.append((key, run[0][1], run[-1][1], len(run)))
    got = ordered.islands(df, F.col("hit"), ["at"], ["key"], chunk=chunk)
    assert sorted(map(str, map(tuple, got.select("key", "first", "last", "length").collect()))) == sorted(map(str, want))
    assert ordered.islands(df.limit(0), F.col("hit"), ["at"], ["key"]).count() == 0


@pytest.mark.parametrize(("chunk", "budget"), [(7, 100), (150, 10**6), (1 << 15, 0)])
def test_budget_across_chunks(sequence, chunk, budget):
    rows, df = sequence
    want = []
    for key, own in groupby(rows, key=lambda r: r[0]):
        left = budget
        for _, at, _, size in own:
            if size <= left:
                left -= size
                want.append((key, at))
    got = ordered.budgeted(df, "size", budget, ["at"], ["key"], chunk=chunk)
    assert sorted(map(str, map(tuple, got.select("key", "at").collect()))) == sorted(map(str, want))
    assert got.columns == df.columns
