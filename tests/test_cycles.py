"""Strongly connected components and witnesses against a plain depth-first version."""

import random
from collections import defaultdict, deque

from repograin.operators import cycles


def tarjan(edges):
    """Components by node, iteratively."""
    out = defaultdict(list)
    for a, b in edges:
        out[a].append(b)
    index, low, stack, on, found = {}, {}, [], set(), []
    for root in {x for e in edges for x in e}:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(out[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    group = set()
                    while node not in group:
                        group.add(stack.pop())
                    on -= group
                    found.append(group)
    return [g for g in found if len(g) > 1]


def shortest(edges, group):
    """Length of the shortest cycle through the least node of a component."""
    root, far = min(group), {min(group): 0}
    queue = deque([root])
    while queue:
        a = queue.popleft()
        for x, b in edges:
            if x == a and b in group:
                if b == root:
                    return far[a] + 1
                if b not in far:
                    far[b] = far[a] + 1
                    queue.append(b)


def check(spark, by_repo):
    df = spark.createDataFrame([(r, a, b) for r, es in by_repo.items() for a, b in es], "repo string, src string, dst string")
    got = defaultdict(list)
    for r in cycles.witnesses(df, ["repo"]).collect():
        got[r["repo"]].append(r)
    for repo, edges in by_repo.items():
        groups = {min(g): g for g in tarjan([e for e in edges if e[0] != e[1]])}
        rings = {r["component"]: r for r in got[repo] if r["length"] > 1}
        assert set(rings) == set(groups)
        for name, r in rings.items():
            nodes = r["cycle"].split(">")
            assert r["modules"] == len(groups[name]) and nodes[0] == name and len(nodes) == len(set(nodes)) == r["length"] == shortest([e for e in edges if e[0] != e[1]], groups[name])
            assert all((a, b) in set(edges) for a, b in zip(nodes, nodes[1:] + nodes[:1]))
        assert sorted(r["cycle"] for r in got[repo] if r["length"] == 1) == sorted({a for a, b in edges if a == b})


def ring(n, name="m"):
    return [(f"{name}{i:03}", f"{name}{(i + 1) % n:03}") for i in range(n)]


def test_rings_loops_chains_and_hubs(spark):
    hub = [("hub", f"s{i}") for i in range(300)] + [(f"s{i}", "hub") for i in range(0, 300, 7)]
    chain = [(f"c{i:02}", f"c{i + 1:02}") for i in range(15)] + [("c15", "c15"), ("c15", "c15")]
    check(spark, {
        "four": ring(4), "forty": ring(40) + [("m000", "tail"), ("tail", "end")], "hub": hub, "chain": chain,
        "bridged": ring(3, "a") + ring(5, "b") + [("a001", "b002"), ("a000", "a000")], "none": [("x", "y"), ("x", "z")], "figure eight": ring(4, "p") + [("p000", "q"), ("q", "r"), ("r", "p000")],
    })


def test_random_graphs_equal_plain_version(spark):
    rnd = random.Random(5)
    graphs = {}
    for g in range(12):
        names = [f"n{i:02}" for i in range(18)]
        graphs[f"r{g}"] = sorted({(a, b) for a in names for b in names if rnd.random() < 0.03 + g * 0.012})
    check(spark, graphs)


def test_empty_graph(spark):
    assert cycles.witnesses(spark.createDataFrame([], "repo string, src string, dst string"), ["repo"]).collect() == []
