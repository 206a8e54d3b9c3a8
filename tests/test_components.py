import random

from pairloom.operators.components import connected_components
from pairloom.plans import tables


def union_find(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in root}


def test_components_equal_union_find(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(1000, 1121)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(180)]
    edges += [(500, k) for k in range(501, 600)] + [(700, 700), (None, 3), (4, None), (900, 901), (900, 901)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.component for r in got} == union_find(edges)
    assert len(got) == len({r.node for r in got})


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_scope_deletes_what_was_written_in_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "folder", lambda _: f"file://{tmp_path}")
    with tables.scope(spark):
        labels = connected_components(spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long"), "a", "b")
        out = tables.written(tables.written(labels, "inner"), "outer", kept=True)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["outer"]
    assert sorted((r.node, r.component) for r in out.collect()) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
