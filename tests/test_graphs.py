import random

from tessella.operators import audit, graphs


def reach(edges, starts):
    after = {}
    for s, t in edges:
        after.setdefault(s, set()).add(t)
    seen, todo = set(starts), list(starts)
    while todo:
        for t in after.get(todo.pop(), ()):
            if t not in seen:
                seen.add(t)
                todo.append(t)
    return seen


def cyclic(edges):
    """Nodes that reach themselves."""
    return {n for n in {x for e in edges for x in e} if n in reach(edges, [t for s, t in edges if s == n])}


def table(spark, edges):
    return spark.createDataFrame(edges, "source string, target string")


def some_graphs():
    """Random graphs sparse and dense, one without cycles, a long chain, one that ends in a ring with a tail, loops."""
    edges = []
    for seed, n, m in ((1, 12, 14), (2, 30, 30), (3, 40, 36), (4, 20, 30)):
        rnd = random.Random(seed)
        drawn = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        edges += [(f"g{seed}-{a}", f"g{seed}-{b}") for a, b in drawn if seed < 4 or a < b]
    for name in ("open", "ring"):
        edges += [(f"{name}{i:04d}", f"{name}{i + 1:04d}") for i in range(150)]
    edges += [("ring0150", "ring0140"), ("ring0145", "tail"), ("tail", "tail2")]
    return [*edges, ("a", "a"), ("a", "b"), ("x", "a")]


def test_nodes_on_and_behind_cycles(spark):
    edges = some_graphs()
    found, rounds = graphs.behind_cycles(table(spark, [*edges, *edges[:3], (None, "open0001"), ("open0001", None)]))
    got = sorted(r.node for r in found.collect())
    assert got == sorted(reach(edges, cyclic(edges)))
    assert {f"ring{i:04d}" for i in range(140, 151)} | {"tail", "tail2", "a", "b"} <= set(got)
    assert not [n for n in got if n.startswith(("open", "g4"))] and rounds <= 25  # of chains of 150


def test_nodes_between_cycles(spark):
    edges = [("p", "q"), ("q", "p"), ("q", "r"), ("r", "s"), ("s", "s"), ("s", "t"), ("u", "p")]
    back = [(b, a) for a, b in edges]
    assert {r.node for r in graphs.on_cycles(table(spark, edges)).collect()} == reach(edges, cyclic(edges)) & reach(back, cyclic(edges)) == {"p", "q", "r", "s"}
    assert audit.cyclic_nodes(table(spark, [])).count() == 0
