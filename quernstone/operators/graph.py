"""Graphs of counted pairs: degrees, betweenness, components, edge metrics, communities.

Betweenness and communities work on a vocabulary that counting has bounded; max_nodes states the bound and exceeding it is an error.
"""

from __future__ import annotations

import heapq
from collections import defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written


def both_ways(edges: DataFrame) -> DataFrame:
    a = edges.select(F.col("item_a").alias("node"), F.col("item_b").alias("other"), "weight")
    return a.unionByName(edges.select(F.col("item_b").alias("node"), F.col("item_a").alias("other"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def without_isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(both_ways(edges).select("node").distinct(), "node", "left_semi")


def top_neighbours(edges: DataFrame, k: int = 3) -> DataFrame:
    w = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    return both_ways(edges).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def brandes(adjacency: dict, sources: list, weighted: bool, tolerance: float = 0.0) -> dict:
    """Sum of dependencies of the given sources. Weighted: distances are 1 / weight, and equal only if their floats are (within tolerance)."""
    total: dict = defaultdict(float)
    for s in sources:
        order, before, paths, dist = [], defaultdict(list), defaultdict(float, {s: 1.0}), {}
        if weighted:
            heap, best, tick = [(0.0, 0, s, s)], {s: 0.0}, 0
            while heap:
                d, _, pred, v = heapq.heappop(heap)
                if v in dist:
                    continue
                dist[v] = d
                order.append(v)
                for u, w in adjacency[v]:
                    t = d + 1.0 / w
                    if u not in dist and (u not in best or t < best[u] - tolerance):
                        best[u] = t
                        tick += 1
                        heapq.heappush(heap, (t, tick, v, u))
                        paths[u], before[u] = paths[v], [v]
                    elif u not in dist and abs(t - best[u]) <= tolerance:
                        paths[u] += paths[v]
                        before[u].append(v)
        else:
            dist, queue = {s: 0}, deque([s])
            while queue:
                v = queue.popleft()
                order.append(v)
                for u, _ in adjacency[v]:
                    if u not in dist:
                        dist[u] = dist[v] + 1
                        queue.append(u)
                    if dist[u] == dist[v] + 1:
                        paths[u] += paths[v]
                        before[u].append(v)
        delta: dict = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    return total


def betweenness(edges: DataFrame, weighted: bool = True, max_nodes: int = 20_000, max_edges: int = 500_000, tolerance: float = 0.0) -> DataFrame:
    """(node, betweenness), normalised by 2 / ((n - 1)(n - 2)); exact. The graph is broadcast, its sources are dealt out."""
    rows = edges.select("item_a", "item_b", "weight").limit(max_edges + 1).collect()
    if len(rows) > max_edges:
        raise ValueError(f"more than {max_edges} edges: raise the least weight")
    adjacency: dict = defaultdict(list)
    for a, b, w in sorted(rows):
        adjacency[a].append((b, w))
        adjacency[b].append((a, w))
    n = len(adjacency)
    if n > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes: raise the least weight")
    spark = edges.sparkSession
    graph = spark.sparkContext.broadcast(dict(adjacency))
    scale = 1.0 if n <= 2 else 1.0 / ((n - 1) * (n - 2))  # each unordered pair is met from both its ends
    nodes = both_ways(edges).select("node").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            total = brandes(graph.value, b["node"].tolist(), weighted, tolerance)
            yield pd.DataFrame({"node": list(total), "part": list(total.values())}, columns=["node", "part"])

    kind = edges.schema["item_a"].dataType.simpleString()
    parts = nodes.repartition("node").mapInPandas(run, f"node {kind}, part double")
    return nodes.join(parts.groupBy("node").agg(F.sum("part").alias("part")), "node", "left").select("node", (F.coalesce("part", F.lit(0.0)) * scale).alias("betweenness"))


def pair_centrality(pairs: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    """Adds centrality_mean, _max and _geometric of both ends (0 for a node without one)."""
    for side in ("item_a", "item_b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col(value).alias(f"c_{side}")), side, "left")
    a, b = (F.greatest(F.coalesce(f"c_{x}", F.lit(0.0)), F.lit(0.0)) for x in ("item_a", "item_b"))
    return pairs.withColumns({"centrality_mean": (a + b) / 2, "centrality_max": F.greatest(a, b), "centrality_geometric": F.sqrt(a * b)}).drop("c_item_a", "c_item_b")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): smallest node reachable. Labels halve their distance each round; each round is written, so lineage doesn't grow."""
    nbrs = written(both_ways(edges.withColumn("weight", F.lit(1))).select("node", "other").distinct(), "neighbours")
    label = nbrs.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component"))
    for _ in range(max_rounds):
        near = nbrs.join(label.withColumnsRenamed({"node": "other", "component": "c"}), "other").groupBy("node").agg(F.min("c").alias("c"))
        step = label.join(near, "node").select("node", F.least("component", "c").alias("component"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = step.join(jump, "component", "left").select("node", F.least("component", F.coalesce("up", "component")).alias("component"))
        new = written(new, "labels")
        changed = new.join(label.withColumnRenamed("component", "old"), "node").filter("component <> old").limit(1).count()
        label = new
        if not changed:
            return label
    raise ValueError("components did not settle")


def graph_statistics(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, components, largest component."""
    c = components(edges)
    sizes = c.groupBy("component").agg(F.count("*").alias("n"))
    x = sizes.agg(F.count("*").alias("components"), F.max("n").alias("largest"), F.sum("n").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges")))
    return x.withColumn("density", F.coalesce(F.try_divide(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)))


def edge_metrics(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Adds community_a, community_b and same_community from (node, community)."""
    for side, name in (("item_a", "community_a"), ("item_b", "community_b")):
        edges = edges.join(partition.select(F.col("node").alias(side), F.col("community").alias(name)), side, "left")
    return edges.withColumn("same_community", F.col("community_a") == F.col("community_b"))


def cross_community(metrics: DataFrame) -> DataFrame:
    x = metrics.filter(~F.col("same_community"))
    return x.groupBy(F.least("community_a", "community_b").alias("low"), F.greatest("community_a", "community_b").alias("high")).agg(F.count("*").alias("n_edges"), F.sum("weight").alias("weight"))


def louvain(edges: list[tuple], rounds: int = 20) -> dict:
    """Communities of a bounded edge list by greedy modularity moves, then numbered by falling weighted degree and smallest member.

    Deterministic: nodes are visited in order, ties go to the smallest community."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    owner = {v: v for v in nodes}
    level = {(a, b): float(w) for a, b, w in edges}
    total = sum(level.values()) or 1.0
    while True:
        weight: dict = defaultdict(float)
        near: dict = defaultdict(dict)
        for (a, b), w in level.items():
            weight[a] += w
            weight[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0.0) + w
                near[b][a] = near[b].get(a, 0.0) + w
        where = {v: v for v in weight}
        inside, moved_any = dict(weight), False
        for _ in range(rounds):
            moved = False
            for v in sorted(weight):
                inside[where[v]] -= weight[v]
                links: dict = defaultdict(float)
                for u, w in near[v].items():
                    links[where[u]] += w
                gain = lambda c, v=v, links=links: links.get(c, 0.0) - inside.get(c, 0.0) * weight[v] / (2 * total)
                best = max(sorted({where[v], *links}), key=lambda c: (round(gain(c), 12), c == where[v]))
                moved |= best != where[v]
                where[v] = best
                inside[best] = inside.get(best, 0.0) + weight[v]
            moved_any |= moved
            if not moved:
                break
        owner = {v: where.get(c, c) for v, c in owner.items()}
        if not moved_any:
            break
        merged: dict = defaultdict(float)
        for (a, b), w in level.items():
            merged[tuple(sorted((where[a], where[b])))] += w
        level = dict(merged)
    strength: dict = defaultdict(float)
    for a, b, w in edges:
        strength[owner[a]] += w
        strength[owner[b]] += w
    members: dict = defaultdict(list)
    for v, c in owner.items():
        members[c].append(v)
    order = sorted(members, key=lambda c: (-strength[c], min(members[c])))
    return {v: i for i, c in enumerate(order) for v in members[c]}


def modularity(edges: list[tuple], community: dict) -> float:
    total = sum(w for *_, w in edges)
    inner, degree = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        degree[community[a]] += w
        degree[community[b]] += w
        if community[a] == community[b]:
            inner[community[a]] += w
    return sum(inner[c] / total - (degree[c] / (2 * total)) ** 2 for c in degree)


def communities(edges: DataFrame, max_edges: int = 500_000) -> DataFrame:
    rows = [tuple(r) for r in edges.select("item_a", "item_b", F.col("weight").cast("double")).limit(max_edges + 1).collect()]
    if len(rows) > max_edges:
        raise ValueError(f"more than {max_edges} edges: raise the least weight")
    return edges.sparkSession.createDataFrame(sorted(louvain(rows).items()), f"node {edges.schema['item_a'].dataType.simpleString()}, community int")
