"""Clustering of weighted matches ``(p1, p2, weight)``; greedy methods run inside connected components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.operators.components import connected_components


def component_clusters(edges: DataFrame, threshold: float, profiles: DataFrame | None = None) -> DataFrame:
    """``profile_id, cluster_id`` by connected components of edges at or over the threshold; with ``profiles`` also singletons."""
    found = connected_components(edges.where(F.col("weight") >= threshold)).select(F.col("node").alias("profile_id"), F.col("component").alias("cluster_id"))
    if profiles is None:
        return found
    alone = profiles.select("profile_id").distinct().join(found, "profile_id", "left_anti")
    return found.unionByName(alone.select("profile_id", F.col("profile_id").alias("cluster_id")))


def _center(edges: pd.DataFrame, merge: bool = False) -> dict[int, int]:
    weights: dict[int, list[float]] = {}
    for a, b, w in edges.itertuples(index=False):
        weights.setdefault(a, []).append(w), weights.setdefault(b, []).append(w)
    mean = {n: sum(w) / len(w) for n, w in weights.items()}
    center: dict[int, int] = {}
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b, _ in edges.itertuples(index=False):
        if a not in center and b not in center:
            c = a if (mean[a], -a) >= (mean[b], -b) else b
            center[a] = center[b] = c
        elif a in center and b in center:
            if merge and (center[a] == a or center[b] == b):
                root[max(find(center[a]), find(center[b]))] = min(find(center[a]), find(center[b]))
        else:
            known, new = (a, b) if a in center else (b, a)
            center[new] = known if center[known] == known else new
    return {n: find(c) if merge else c for n, c in center.items()}


def _unique(edges: pd.DataFrame) -> dict[int, int]:
    out: dict[int, int] = {}
    for a, b, _ in edges.itertuples(index=False):
        if a not in out and b not in out:
            out[a] = out[b] = min(a, b)
    return out


def _markov(edges: pd.DataFrame, rounds: int = 20, cut: float = 1e-3) -> dict[int, int]:
    nodes = np.unique(edges[["p1", "p2"]].to_numpy())
    a, b = np.searchsorted(nodes, edges["p1"]), np.searchsorted(nodes, edges["p2"])
    m = np.eye(len(nodes))
    m[a, b] = m[b, a] = edges["weight"]
    m /= m.sum(0)
    for _ in range(rounds):
        new = (m @ m) ** 2
        new /= new.sum(0)
        if np.abs(new - m).max() < 1e-6:
            break
        m = new
    near = (m > cut) | (m > cut).T
    label = np.arange(len(nodes))
    while True:
        lower = np.where(near, label[None], label[:, None]).min(1)
        if (lower == label).all():
            return {int(n): int(nodes[x]) for n, x in zip(nodes, label, strict=True)}
        label = lower


def _ricochet(edges: pd.DataFrame) -> dict[int, int]:
    near: dict[int, dict[int, float]] = {}
    for a, b, w in edges.itertuples(index=False):
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    seed_of: dict[int, int] = {}
    held: dict[int, set[int]] = {}
    pull = lambda n: near[n].get(seed_of[n], 0.0) if n in seed_of else 0.0

    def move(n: int, seed: int) -> int | None:
        before = seed_of.get(n)
        if before is not None:
            held[before].discard(n)
        seed_of[n] = seed
        held[seed].add(n)
        return before

    for n in sorted(near, key=lambda n: (-sum(near[n].values()) / len(near[n]), n)):
        won = [v for v, w in near[n].items() if v not in held and w > pull(v)]
        if not won:
            continue
        held[n] = set()
        left = {move(v, n) for v in [n, *won]}
        for seed in sorted(s for s in left if s is not None and s != n and held.get(s) == {s}):
            others = [(-w, v) for v, w in near[seed].items() if v in held and v != seed]
            if others:
                move(seed, min(others)[1])
                del held[seed]
    return {n: seed_of.get(n, n) for n in near}


def _community(flow: list[dict[int, float]], source: int, sink: int) -> set[int]:
    """The smallest source side of a minimum cut; ``flow`` holds the capacities by node and is used up."""
    while True:
        came, queue = {source: source}, [source]
        for u in queue:
            for v, c in flow[u].items():
                if c > 1e-12 and v not in came:
                    came[v] = u
                    queue.append(v)
            if sink in came:
                break
        else:
            return set(came)
        path, v = [], sink
        while v != source:
            path.append((came[v], v))
            v = came[v]
        least = min(flow[u][v] for u, v in path)
        for u, v in path:
            flow[u][v] -= least
            flow[v][u] = flow[v].get(u, 0.0) + least


def _cut(edges: pd.DataFrame, alpha: float) -> dict[int, int]:
    nodes = [int(n) for n in np.unique(edges[["p1", "p2"]].to_numpy())]
    at, sink = {n: i for i, n in enumerate(nodes)}, len(nodes)
    net: list[dict[int, float]] = [{sink: alpha} for _ in nodes] + [dict.fromkeys(range(sink), 0.0)]
    for a, b, w in edges.itertuples(index=False):
        net[at[a]][at[b]] = net[at[b]][at[a]] = w
    label: dict[int, int] = {}
    for i in sorted(range(sink), key=lambda i: (-sum(net[i].values()), i)):
        if i not in label:
            # communities are nested or apart, so a later one takes in the earlier ones that it holds
            label |= dict.fromkeys(_community([dict(n) for n in net], i, sink), i)
    least: dict[int, int] = {}
    for i in range(sink):
        least.setdefault(label[i], nodes[i])
    return {nodes[i]: least[label[i]] for i in range(sink)}


def _in_components(edges: DataFrame, threshold: float, method: Callable[[pd.DataFrame], dict[int, int]]) -> DataFrame:
    strong = edges.where(F.col("weight") > threshold).select("p1", "p2", "weight")
    parts = connected_components(strong).select(F.col("node").alias("p1"), "component")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = frame.sort_values(["weight", "p1", "p2"], ascending=[False, True, True])[["p1", "p2", "weight"]]
        found = method(own)
        return pd.DataFrame({"profile_id": list(found), "cluster_id": list(found.values())})

    return strong.join(parts, "p1").groupBy("component").applyInPandas(run, "profile_id long, cluster_id long")


def center_clusters(edges: DataFrame, threshold: float) -> DataFrame:
    """Greedy by falling weight: of two free ends the one of higher mean weight is a centre; a free end joins a centre."""
    return _in_components(edges, threshold, _center)


def merge_center_clusters(edges: DataFrame, threshold: float) -> DataFrame:
    """As centre clustering; clusters whose centre meets another cluster's member are merged."""
    return _in_components(edges, threshold, lambda e: _center(e, merge=True))


def unique_mapping_clusters(edges: DataFrame, threshold: float) -> DataFrame:
    """Greedy one-to-one matches by falling weight."""
    return _in_components(edges, threshold, _unique)


def markov_clusters(edges: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Markov clustering of each component: expansion and squaring until the flow is stable."""
    return _in_components(edges, threshold, _markov)


def ricochet_clusters(edges: DataFrame, threshold: float) -> DataFrame:
    """Sequential rippling: by falling mean weight a node becomes a seed if it draws others from their seeds.

    A seed left alone joins the nearest other seed.
    """
    return _in_components(edges, threshold, _ricochet)


def cut_clusters(edges: DataFrame, threshold: float, alpha: float = 0.3) -> DataFrame:
    """Minimum cuts from a sink that every node is tied to by ``alpha``: a larger one gives smaller clusters."""
    return _in_components(edges, threshold, lambda e: _cut(e, alpha))
