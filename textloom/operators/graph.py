"""Graphs as edge tables: adjacency, paths, centrality, components, cliques, surgery.

Edges are (src, dst, weight, length, type); weight is importance, so an edge costs 1 - weight / 2.  Iterations are joins on
the edge table; where lineage would grow, ``checkpoint`` cuts it in the shared folder if the session names one.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions.lineage import cut as _cut


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Of directed edges added twice the first stays."""
    both = edges.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(Window.partitionBy("src", "dst").orderBy("_new"))
    return both.withColumn("_r", first).where("_r = 1").drop("_r", "_new")


def remove_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("id")
    return edges.join(n, edges.src == n.id, "left_anti").join(n, F.col("dst") == n.id, "left_anti")


def subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the given nodes."""
    n = nodes.select("id")
    return edges.join(n, edges.src == n.id, "left_semi").join(n, F.col("dst") == n.id, "left_semi")


def links(edges: DataFrame) -> DataFrame:
    """(id, other) neighbours in both directions, each once."""
    return edges.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionAll(edges.select("dst", "src")).where("id <> other").distinct()


def adjacency(edges: DataFrame, directed: bool = False, backwards: bool = False, stochastic: bool = False, heuristic: Column | None = None) -> DataFrame:
    """(a, b, cost): costs, mirrored unless directed; stochastic ones sum to 1 for each a.

    Of repeated edges the last one counts, by a column ``ordinal`` of the edges; without one the cheapest.
    """
    cost = 1 - 0.5 * F.coalesce(F.col("weight"), F.lit(0.0)) + (F.lit(0.0) if heuristic is None else heuristic)
    a, b = ("dst", "src") if backwards else ("src", "dst")
    rest = [F.col("ordinal").alias("_n")] if "ordinal" in edges.columns else []
    out = edges.select(F.col(a).alias("a"), F.col(b).alias("b"), cost.alias("cost"), *rest)
    if not directed:
        out = out.unionAll(out.select(F.col("b").alias("a"), F.col("a").alias("b"), *out.columns[2:]))
    out = out.groupBy("a", "b").agg((F.max_by("cost", "_n") if "_n" in out.columns else F.min("cost")).alias("cost"))
    return out.withColumn("cost", F.col("cost") / F.sum("cost").over(Window.partitionBy("a"))) if stochastic else out


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, links, degree): neighbours, as a share of all nodes."""
    n = nodes.agg(F.count("*").alias("n"))
    c = links(edges).groupBy("id").agg(F.count("*").alias("links"))
    return nodes.select("id").join(c, "id", "left").fillna(0, ["links"]).crossJoin(F.broadcast(n)).select("id", "links", (F.col("links") / F.col("n")).alias("degree"))  # one row


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(density, complete, dense, sparse); density is 2 E / (n (n - 1)), dense above 0.65, sparse below 0.35."""
    n = nodes.agg(F.count("*").alias("n"))
    d = edges.agg(F.count("*").alias("e")).crossJoin(n).select((2.0 * F.col("e") / F.greatest(F.col("n") * (F.col("n") - 1), F.lit(1))).alias("density"))  # one row each
    return d.select("density", (F.col("density") == 1).alias("complete"), (F.col("density") > 0.65).alias("dense"), (F.col("density") < 0.35).alias("sparse"))


def prune(nodes: DataFrame, edges: DataFrame, depth: int = 0) -> tuple[DataFrame, DataFrame]:
    """Without nodes that have ``depth`` links or fewer."""
    out = degrees(nodes, edges).where(F.col("links") <= depth)
    return nodes.join(out.select("id"), "id", "left_anti"), remove_nodes(edges, out)


def neighborhood(edges: DataFrame, start: DataFrame, depth: int = 1, traversable: Column | None = None) -> DataFrame:
    """(id, distance) of nodes within ``depth`` steps of the starting nodes, breadth first."""
    steps = links(edges if traversable is None else edges.where(traversable))
    seen = start.select("id").distinct().withColumn("distance", F.lit(0))
    for d in range(1, depth + 1):
        new = seen.where(F.col("distance") == d - 1).join(steps, "id").select(F.col("other").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        seen = seen.unionAll(new.withColumn("distance", F.lit(d)))
    return seen


def fringe(nodes: DataFrame, edges: DataFrame, depth: int = 0) -> DataFrame:
    """(id) of leaves, with what is ``depth`` steps around them."""
    return neighborhood(edges, degrees(nodes, edges).where("links = 1"), depth).select("id").distinct()


def paths(edges: DataFrame, start, end, length: int = 4, directed: bool = False) -> DataFrame:
    """(path) of all simple paths with at most ``length`` nodes."""
    e = edges.select("src", "dst") if directed else links(edges).select(F.col("id").alias("src"), F.col("other").alias("dst"))
    at = e.sparkSession.createDataFrame([([start],)], f"path array<{dict(e.dtypes)['src']}>")
    found = at.where(F.lit(start == end) & F.lit(length >= 1))
    for _ in range(length - 1):
        at = at.join(e, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
        found = found.unionAll(at.where(F.element_at("path", -1) == end))
        at = at.where(F.element_at("path", -1) != end)
    return found


def shortest_paths(edges: DataFrame, sources: DataFrame, directed: bool = False, heuristic: Column | None = None, most: int | None = None) -> DataFrame:
    """(source, id, distance, path) by relaxing all edges until nothing improves; of equal paths the smaller one is kept.

    With ``most`` it raises if something still improves after so many rounds.
    """
    adj = adjacency(edges, directed, heuristic=heuristic).persist()
    s = F.col("id")
    best = sources.select(s.alias("source"), s.alias("id"), F.lit(0.0).alias("distance"), F.array(s).alias("path"))
    front = best
    for i in count():
        moved = front.join(adj, front.id == adj.a).where(~F.array_contains("path", F.col("b"))).select("source", F.col("b").alias("id"), (F.col("distance") + F.col("cost")).alias("distance"), F.concat("path", F.array("b")).alias("path"))
        moved = moved.groupBy("source", "id").agg(F.min(F.struct("distance", "path")).alias("x")).select("source", "id", "x.distance", "x.path")
        old = best.select("source", "id", F.col("distance").alias("_d"))
        front = moved.join(old, ["source", "id"], "left").where(F.col("_d").isNull() | (F.col("distance") < F.col("_d") - 1e-12)).drop("_d")
        front = _cut(front)
        if front.isEmpty():
            break
        if most is not None and i + 1 >= most:
            raise RuntimeError(f"paths still improve after {most} rounds")
        best = best.join(front.select("source", "id"), ["source", "id"], "left_anti").unionAll(front)
        if i % 3 == 2:
            best = _cut(best)
    return best


def all_pairs(nodes: DataFrame, edges: DataFrame, directed: bool = False, own_edge: bool = False, most: int | None = None) -> DataFrame:
    """(source, id, distance, path) between all reachable pairs.

    With ``own_edge`` a node without outgoing edges has twice its cheapest edge as the distance to itself instead of 0.
    """
    out = shortest_paths(edges, nodes, directed, most=most)
    if own_edge:
        loops = nodes.select("id").join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
        twice = adjacency(edges, directed=False).groupBy(F.col("a").alias("id")).agg((2 * F.min("cost")).alias("twice"))
        out = out.join(loops.join(twice, "id"), "id", "left").withColumn("distance", F.when((F.col("source") == F.col("id")) & F.col("twice").isNotNull(), F.col("twice")).otherwise(F.col("distance"))).select("source", "id", "distance", "path")
    return out


def betweenness(nodes: DataFrame, edges: DataFrame, directed: bool = False, normalized: bool = True, groups: int = 64) -> DataFrame:
    """(id, betweenness): weighted Brandes. Sources are dealt over tasks; the graph's adjacency must fit a worker (checked)."""
    adj = adjacency(edges, directed)
    if adj.count() > 5_000_000:
        raise ValueError("the adjacency is too large to send to every worker; take a subgraph")
    table: dict = {}
    for r in adj.toLocalIterator():
        table.setdefault(r["a"], []).append((r["b"], r["cost"]))
    sent = nodes.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        import heapq

        import pandas as pd

        total: dict = {}
        for pdf in batches:
            for s in pdf["id"].tolist():
                order, before, count, dist = [], {s: []}, {s: 1.0}, {}
                queue, best = [(0.0, 0, s, s)], {s: 0.0}
                serial = 0
                while queue:
                    d, _, via, v = heapq.heappop(queue)
                    if v in dist:
                        continue
                    dist[v] = d
                    order.append(v)
                    for w, cost in sent.value.get(v, ()):
                        new = d + cost
                        if w not in dist and (w not in best or new < best[w] - 1e-12):
                            best[w], count[w], before[w] = new, 0.0, []
                            serial += 1
                            heapq.heappush(queue, (new, serial, v, w))
                        if w not in dist and abs(new - best[w]) <= 1e-12:
                            count[w] += count[v]
                            before[w].append(v)
                share = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        share[v] += count[v] / count[w] * (1 + share[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + share[w]
        if total:
            yield pd.DataFrame({"id": list(total), "b": list(total.values())})

    kind = dict(nodes.dtypes)["id"]
    parts = nodes.select("id").repartition(groups, "id").mapInPandas(run, f"id {kind}, b double").groupBy("id").agg(F.sum("b").alias("b"))
    out = nodes.select("id").join(parts, "id", "left").fillna(0.0, ["b"])
    if not normalized:
        return out.select("id", F.col("b").alias("betweenness"))
    top = out.agg(F.max("b").alias("top"))
    return out.crossJoin(F.broadcast(top)).select("id", (F.col("b") / F.when(F.col("top") == 0, 1).otherwise(F.col("top"))).alias("betweenness"))  # one row


def eigenvector(nodes: DataFrame, edges: DataFrame, backwards: bool = True, normalized: bool = True, rating: DataFrame | None = None, iterations: int = 100, tolerance: float = 1e-4) -> DataFrame:
    """(id, eigenvector) by power iteration from an even start: v(a) = sum over b of 0.01 + v(b) G(a, b) rating(a)."""
    g = adjacency(edges, directed=True, backwards=backwards)
    if rating is not None:
        g = g.join(rating.select(F.col("id").alias("a"), "rating"), "a", "left").withColumn("cost", F.col("cost") * F.coalesce("rating", F.lit(1.0))).drop("rating")
    g = g.persist()
    n = nodes.count()
    v = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("v"))
    for _ in range(iterations):
        s = g.join(v.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum(0.01 + F.col("v") * F.col("cost")).alias("s"))
        new = v.join(s.withColumnRenamed("a", "id"), "id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
        total = new.agg(F.sum("s")).first()[0] or 1.0
        new = _cut(new.select("id", F.col("v").alias("old"), (F.col("s") / total).alias("v")))
        moved = new.agg(F.sum(F.abs(F.col("v") - F.col("old")))).first()[0]
        v = new.select("id", "v")
        if moved < n * tolerance:
            break
    if not normalized:
        return v.withColumnRenamed("v", "eigenvector")
    top = v.agg(F.max("v")).first()[0] or 1.0
    return v.select("id", (F.col("v") / top).alias("eigenvector"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each connected component, by minimum labels with pointer jumping, until none changes."""
    both = links(edges).persist()
    label = nodes.select("id", F.col("id").alias("component"))
    before = None
    while True:
        near = both.join(label, both.other == label.id).groupBy(both.id).agg(F.min("component").alias("m"))
        new = label.join(near, "id", "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = new.select(F.col("id").alias("j"), F.col("component").alias("c"))
        label = _cut(new.join(jump, F.col("component") == F.col("j"), "left").select("id", F.least("component", "c").alias("component")))
        state = label.agg(F.sum(F.xxhash64("id", "component").cast("decimal(38,0)"))).first()[0]
        if state == before:
            break
        before = state
    return label


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) with a < b < c all linked."""
    e = links(edges).where("id < other")
    ab, bc, ac = (e.select(F.col("id").alias(x), F.col("other").alias(y)) for x, y in ("ab", "bc", "ac"))
    return ab.join(bc, "b").join(ac, ["a", "c"]).select("a", "b", "c")


def cliques(edges: DataFrame, least: int = 3, most: int | None = None) -> DataFrame:
    """(nodes) of cliques of at least ``least`` nodes that no other node extends, grown node by node in order.

    With ``most`` it raises if there are cliques of more nodes.
    """
    e = links(edges).persist()
    level = e.where("id < other").select(F.array("id", "other").alias("nodes"))
    found = level.limit(0)
    for size in count(2):
        grown = level.join(e, F.element_at("nodes", -1) == F.col("id")).where(F.col("other") > F.element_at("nodes", -1))
        grown = grown.select("nodes", "other", F.explode("nodes").alias("n")).join(e.select(F.col("id").alias("n"), "other"), ["n", "other"]).groupBy("nodes", "other").agg(F.count("*").alias("c")).where(F.col("c") == size)
        nxt = grown.select(F.concat("nodes", F.array("other")).alias("nodes"))
        fits = level.select("nodes", F.explode("nodes").alias("id")).join(e, "id").groupBy("nodes", "other").agg(F.count("*").alias("c")).where(F.col("c") == size).select("nodes").distinct()
        whole = level.join(fits, "nodes", "left_anti")
        if size >= least:
            found = found.unionAll(whole)
        level = _cut(nxt)
        if level.isEmpty():
            return found
        if most is not None and size >= most:
            raise RuntimeError(f"there are cliques of more than {most} nodes")


def unlink(edges: DataFrame, a, b=None) -> DataFrame:
    """Without the edges between a and b, or all of a's."""
    of = lambda x, y: (F.col("src") == x) & (F.col("dst") == y)
    return edges.where(~((F.col("src") == a) | (F.col("dst") == a))) if b is None else edges.where(~(of(a, b) | of(b, a)))


def redirect(edges: DataFrame, a, b) -> DataFrame:
    """All of a's edges go to b; edges that would loop or repeat go."""
    swap = lambda c: F.when(F.col(c) == a, F.lit(b)).otherwise(F.col(c)).alias(c)
    return edges.select(swap("src"), swap("dst"), *[c for c in edges.columns if c not in ("src", "dst")]).where("src <> dst").dropDuplicates(["src", "dst"])


def cut(edges: DataFrame, a) -> DataFrame:
    """Remove a, linking each of its predecessors with each of its successors."""
    extra = [c for c in edges.columns if c not in ("src", "dst")]
    into, out = edges.where(F.col("dst") == a).where(F.col("src") != a), edges.where(F.col("src") == a).where(F.col("dst") != a).select("dst").distinct()
    bridged = into.drop("dst").join(out, F.col("src") != F.col("dst")).select("src", "dst", *extra)
    rest = edges.where((F.col("src") != a) & (F.col("dst") != a))
    return add_edges(rest, bridged)


def insert(edges: DataFrame, node, a, b) -> DataFrame:
    """Put a node between a and b: each edge between them becomes two."""
    extra = [c for c in edges.columns if c not in ("src", "dst")]
    hit = ((F.col("src") == a) & (F.col("dst") == b)) | ((F.col("src") == b) & (F.col("dst") == a))
    on = edges.where(hit)
    return edges.where(~hit).unionAll(on.select("src", F.lit(node).alias("dst"), *extra)).unionAll(on.select(F.lit(node).alias("src"), "dst", *extra))


def spring_layout(nodes: Sequence, edges: Sequence[tuple], iterations: int = 50, force: float = 10.0, limit: float = 0.5, seed: int = 1) -> dict:
    """{id: (x, y)} for a graph small enough to draw."""
    import numpy as np

    at = np.random.default_rng(seed).uniform(-1, 1, (len(nodes), 2))
    index = {n: i for i, n in enumerate(nodes)}
    pairs = np.array([(index[a], index[b]) for a, b in edges]).reshape(-1, 2)
    for _ in range(iterations):
        gap = at[:, None] - at[None]
        far = np.maximum((gap**2).sum(-1), 1e-4)
        move = (gap / far[..., None]).sum(1) * 0.01 * force
        if len(pairs):
            pull = (at[pairs[:, 0]] - at[pairs[:, 1]]) * 0.1
            np.add.at(move, pairs[:, 0], -pull)
            np.add.at(move, pairs[:, 1], pull)
        at += np.clip(move, -limit, limit)
    return {n: (float(x), float(y)) for n, (x, y) in zip(nodes, at, strict=True)}


def graphml(nodes: DataFrame, edges: DataFrame, directed: bool = False) -> DataFrame:
    """(line) rows of a GraphML document, in the order of ``n``; written as text, it can be as large as the graph."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    spark = nodes.sparkSession
    head = spark.createDataFrame([(0, "", '<?xml version="1.0" encoding="utf-8"?>'), (0, "a", '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (0, "b", f'<graph edgedefault="{"" if directed else "un"}directed">'), (3, "", "</graph></graphml>")], "n int, k string, line string")
    n = nodes.select(F.lit(1).alias("n"), F.col("id").cast("string").alias("k"), F.format_string('<node id="%s"/>', esc("id")).alias("line"))
    e = edges.select(F.lit(2).alias("n"), F.concat_ws("-", "src", "dst").alias("k"), F.format_string('<edge source="%s" target="%s"/>', esc("src"), esc("dst")).alias("line"))
    return head.unionAll(n).unionAll(e).orderBy("n", "k").select("line")


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(ancestor, descendant, distance) of a hierarchy (parent, child), shortest distances, a step a round until nothing is new.

    With ``most`` only those at most so many steps away are asked for.
    """
    known = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant"), F.lit(1).alias("distance")).distinct()
    last = known
    step = edges.select("parent", "child").distinct().persist()
    for d in count(2):
        if most is not None and d > most:
            return known
        new = last.join(step, F.col("descendant") == F.col("parent")).select("ancestor", F.col("child").alias("descendant")).distinct().where("ancestor <> descendant").join(known.select("ancestor", "descendant"), ["ancestor", "descendant"], "left_anti").withColumn("distance", F.lit(d))
        last = _cut(new)
        if last.isEmpty():
            return known
        known = known.unionAll(last)
        if d % 8 == 0:
            known = _cut(known)


def ranked(nodes: DataFrame, by: str, threshold: float = 0.0) -> DataFrame:
    """Nodes whose weight or centrality is at least ``threshold``, largest first; of equals the smaller node."""
    return nodes.where(F.col(by) >= threshold).orderBy(F.desc(by), "id")


def depth_first(edges: DataFrame, roots: DataFrame, directed: bool = False, bound: int = 1_000_000) -> DataFrame:
    """(root, node, visited): the order in which each root's nodes are visited depth-first, smaller neighbours first.

    A visit depends on all before it, so each root's component goes to one task; above ``bound`` edges an error is raised.
    """
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    both = both if directed else both.unionAll(edges.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    reached = roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct()
    front = reached
    while not front.isEmpty():
        new = front.join(both, front.node == both.u).select("root", F.col("v").alias("node")).distinct().join(reached, ["root", "node"], "left_anti")
        front = _cut(new)
        reached = _cut(reached.unionAll(front))
    own = reached.join(both, reached.node == both.u, "left").select("root", "node", "v")

    def run(rows):
        if len(rows) > bound:
            raise ValueError("a component is too large to be visited in one order")
        root = rows["root"].iloc[0]
        beside = {n: sorted(x for x in set(g) if x is not None and x == x) for n, g in rows.groupby("node")["v"]}
        seen, stack, out = set(), [root], []
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n), out.append(n)
                stack += [x for x in reversed(beside.get(n, [])) if x not in seen]
        import pandas as pd

        return pd.DataFrame({"root": root, "node": out, "visited": range(len(out))})

    kind = dict(roots.dtypes)["id"]
    return own.groupBy("root").applyInPandas(run, f"root {kind}, node {kind}, visited long")
