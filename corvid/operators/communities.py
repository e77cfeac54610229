"""One level of greedy modularity, for the graph of one document."""

from __future__ import annotations

from collections.abc import Hashable, Iterable

#: Most passes over the nodes.
PASSES = 100


def modularity(nodes: list[Hashable], edges: Iterable[tuple[Hashable, Hashable, float]], resolution: float) -> list[list[Hashable]]:
    """Groups of nodes, in the order of their first members.

    Edges have no direction; parallel ones add up. Nodes are visited in order, and each moves
    to the neighbouring group with the strictly best gain, the first met winning ties, until
    a pass moves none. Without any weight each node stays alone.
    """
    at = {u: k for k, u in enumerate(nodes)}
    near: list[list[tuple[int, float]]] = [[] for _ in nodes]
    degree = [0.0] * len(nodes)
    for a, b, w in edges:
        if a in at and b in at:
            for x, y in ((at[a], at[b]), (at[b], at[a])):
                near[x].append((y, w))
                degree[x] += w
    total = sum(degree)
    if len(nodes) < 2 or not total:
        return [[u] for u in nodes]
    group, weight = list(range(len(nodes))), list(degree)
    for _ in range(PASSES):
        moved = False
        for u in range(len(nodes)):
            home = group[u]
            weight[home] -= degree[u]
            pull = {home: 0.0}
            for v, w in near[u]:
                # The loops of a node do not pull it home.
                if v != u or group[v] != home:
                    pull[group[v]] = pull.get(group[v], 0.0) + w
            gain = {g: 2 * w / total - resolution * degree[u] * weight[g] / total**2 for g, w in pull.items()}
            best = max(gain, key=gain.__getitem__)
            group[u] = best if gain[best] > gain[home] else home
            weight[group[u]] += degree[u]
            moved |= group[u] != home
        if not moved:
            break
    out: dict[int, list[Hashable]] = {}
    for u, g in zip(nodes, group, strict=True):
        out.setdefault(g, []).append(u)
    return list(out.values())
