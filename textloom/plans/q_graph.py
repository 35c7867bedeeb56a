"""Queries of graphs. The edges: nations that trade, from orders of customers to suppliers (a small graph), or shared parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import graph
from textloom.plans.catalog import query, table

#: n_nationkey links to the nation 3 and, if even, 7 further on; weights follow from the key.
_EDGES = "e AS (SELECT n_nationkey AS src, n_nationkey + 3 AS dst, (n_nationkey % 5) / CAST(5 AS DOUBLE) AS weight FROM nation WHERE n_nationkey + 3 < 25 AND n_nationkey % 4 <> 1 UNION ALL SELECT n_nationkey, n_nationkey + 7, 0.5 FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey + 7 < 25)"
_LINKS = "k AS (SELECT DISTINCT src AS id, dst AS other FROM e UNION SELECT DISTINCT dst, src FROM e)"
_ADJ = "adj AS (SELECT a, b, min(cost) AS cost FROM (SELECT src AS a, dst AS b, 1 - 0.5 * weight AS cost FROM e UNION ALL SELECT dst, src, 1 - 0.5 * weight FROM e) GROUP BY 1, 2)"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    a = n.where("id + 3 < 25 and id % 4 <> 1").select(F.col("id").alias("src"), (F.col("id") + 3).alias("dst"), ((F.col("id") % 5) / 5.0).alias("weight"))
    b = n.where("id % 2 = 0 and id + 7 < 25").select(F.col("id").alias("src"), (F.col("id") + 7).alias("dst"), F.lit(0.5).alias("weight"))
    return n, a.unionAll(b)


@query("graph_adjacency", f"WITH {_EDGES}, {_ADJ} SELECT a, b, cost FROM adj")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_graph(spark, sf_dir)[1])


@query("graph_adjacency_stochastic", f"WITH {_EDGES} SELECT src AS a, dst AS b, (1 - 0.5 * weight) / sum(1 - 0.5 * weight) OVER (PARTITION BY src) AS cost FROM e")
def stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(_graph(spark, sf_dir)[1], directed=True, stochastic=True)


@query("graph_degrees", f"WITH {_EDGES}, {_LINKS} SELECT n_nationkey AS id, count(other) AS links, count(other) / 25 AS degree FROM nation LEFT JOIN k ON id = n_nationkey GROUP BY 1")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(*_graph(spark, sf_dir))


@query("graph_density", f"WITH {_EDGES}, d AS (SELECT 2.0 * count(*) / (25 * 24) AS density FROM e) SELECT density, density = 1 AS complete, density > 0.65 AS dense, density < 0.35 AS sparse FROM d")
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.density(*_graph(spark, sf_dir))


@query("graph_prune", f"WITH {_EDGES}, {_LINKS}, o AS (SELECT n_nationkey AS id FROM nation LEFT JOIN k ON id = n_nationkey GROUP BY 1 HAVING count(other) <= 1) SELECT src, dst FROM e WHERE src NOT IN (SELECT id FROM o) AND dst NOT IN (SELECT id FROM o)")
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.prune(*_graph(spark, sf_dir), depth=1)[1].select("src", "dst")


@query("graph_neighborhood", f"WITH RECURSIVE {_EDGES}, {_LINKS}, r AS (SELECT 0 AS id, 0 AS distance UNION SELECT other, distance + 1 FROM r JOIN k USING (id) WHERE distance < 3) SELECT id, min(distance) AS distance FROM r GROUP BY 1")
def neighborhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    return graph.neighborhood(e, n.where("id = 0"), 3)


@query("graph_fringe", f"WITH {_EDGES}, {_LINKS} SELECT id FROM k GROUP BY 1 HAVING count(*) = 1")
def fringe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.fringe(*_graph(spark, sf_dir))


@query("graph_paths", f"WITH RECURSIVE {_EDGES}, {_LINKS}, r AS (SELECT [0] AS path UNION ALL SELECT list_append(path, other) FROM r JOIN k ON id = path[-1] WHERE len(path) < 5 AND path[-1] <> 13 AND NOT list_contains(path, other)) SELECT array_to_string(path, '-') AS path FROM r WHERE path[-1] = 13")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.paths(_graph(spark, sf_dir)[1], 0, 13, 5).select(F.array_join("path", "-").alias("path"))


@query("graph_shortest_paths", f"WITH RECURSIVE {_EDGES}, {_ADJ}, r AS (SELECT 0 AS id, CAST(0 AS DOUBLE) AS distance, [0] AS path UNION ALL SELECT b, distance + cost, list_append(path, b) FROM r JOIN adj ON a = id WHERE len(path) < 20 AND NOT list_contains(path, b)) SELECT 0 AS source, id, round(min(distance), 9) AS distance FROM r GROUP BY 1, 2")
def shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir)
    return graph.shortest_paths(e, n.where("id = 0")).select("source", "id", F.round("distance", 9).alias("distance"))


@query("graph_all_pairs", f"WITH RECURSIVE {_EDGES}, {_ADJ}, r AS (SELECT n_nationkey AS source, n_nationkey AS id, CAST(0 AS DOUBLE) AS distance, [n_nationkey] AS path FROM nation UNION ALL SELECT source, b, distance + cost, list_append(path, b) FROM r JOIN adj ON a = id WHERE len(path) < 20 AND NOT list_contains(path, b)) SELECT source, id, round(min(distance), 9) AS distance FROM r GROUP BY 1, 2")
def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.all_pairs(*_graph(spark, sf_dir)).select("source", "id", F.round("distance", 9).alias("distance"))


@query("graph_betweenness")
def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.betweenness(*_graph(spark, sf_dir), groups=4)


@query("graph_eigenvector")
def eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.eigenvector(*_graph(spark, sf_dir))


@query("graph_components", f"WITH RECURSIVE {_EDGES}, {_LINKS}, r AS (SELECT n_nationkey AS id, n_nationkey AS c FROM nation UNION SELECT other, c FROM r JOIN k USING (id)) SELECT id, min(c) AS component FROM r GROUP BY 1")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(*_graph(spark, sf_dir))


_TRADE = "e AS (SELECT DISTINCT c_nationkey AS src, s_nationkey AS dst FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50 AND o_totalprice > 150000 AND c_nationkey <> s_nationkey)"


def _trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    items = t("lineitem").where("l_quantity >= 50").join(t("orders").where("o_totalprice > 150000"), F.col("l_orderkey") == F.col("o_orderkey"))
    return items.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey").select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).distinct()


@query("graph_triangles", f"WITH {_TRADE}, k AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM e) SELECT p.x AS a, p.y AS b, q.y AS c FROM k p JOIN k q ON p.y = q.x JOIN k r ON r.x = p.x AND r.y = q.y")
def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triangles(_trade(spark, sf_dir))


@query("graph_cliques", f"""WITH RECURSIVE {_EDGES}, {_LINKS}, a AS (SELECT id, list(DISTINCT other) AS o FROM k GROUP BY 1), c AS (SELECT [id] AS c, id AS last FROM a
UNION ALL SELECT list_append(c, a.id), a.id FROM c JOIN a ON a.id > last AND list_has_all(a.o, c)) SELECT array_to_string(c, '-') AS nodes FROM c WHERE len(c) >= 2 AND NOT EXISTS (SELECT 1 FROM a WHERE list_has_all(a.o, c))""")
def cliques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cliques(_graph(spark, sf_dir)[1], 2).select(F.array_join("nodes", "-").alias("nodes"))


@query("graph_redirect", f"WITH {_EDGES} SELECT DISTINCT CASE WHEN src = 4 THEN 5 ELSE src END AS src, CASE WHEN dst = 4 THEN 5 ELSE dst END AS dst FROM e WHERE CASE WHEN src = 4 THEN 5 ELSE src END <> CASE WHEN dst = 4 THEN 5 ELSE dst END")
def redirect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.redirect(_graph(spark, sf_dir)[1], 4, 5).select("src", "dst")


@query("graph_cut", f"WITH {_EDGES} SELECT src, dst FROM e WHERE src <> 10 AND dst <> 10 UNION SELECT i.src, o.dst FROM e i, e o WHERE i.dst = 10 AND o.src = 10 AND i.src <> o.dst")
def cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cut(_graph(spark, sf_dir)[1], 10).select("src", "dst")


@query("graph_unlink_insert", f"WITH {_EDGES} SELECT src, dst FROM e WHERE NOT (src = 0 AND dst = 3) AND NOT (src = 2 AND dst = 9) UNION ALL VALUES (2, 99), (99, 9)")
def unlink_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.insert(graph.unlink(_graph(spark, sf_dir)[1], 0, 3), 99, 2, 9).select("src", "dst")


@query("graph_closure", "WITH RECURSIVE h AS (SELECT n_nationkey // 3 AS parent, n_nationkey AS child FROM nation WHERE n_nationkey > 0), r AS (SELECT parent AS ancestor, child AS descendant, 1 AS distance FROM h UNION ALL SELECT ancestor, child, distance + 1 FROM r JOIN h ON descendant = parent) SELECT ancestor, descendant, min(distance) AS distance FROM r WHERE ancestor <> descendant GROUP BY 1, 2")
def closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "nation").where("n_nationkey > 0").select(F.floor(F.col("n_nationkey") / 3).cast("int").alias("parent"), F.col("n_nationkey").alias("child"))
    return graph.closure(h)


@query("graph_set_operations", "SELECT s_nationkey AS id, 'both' AS part FROM supplier INTERSECT SELECT c_nationkey, 'both' FROM customer UNION ALL (SELECT n_nationkey, 'neither' FROM nation EXCEPT SELECT c_nationkey, 'neither' FROM customer)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("id"))
    both, rest = t("supplier", "s_nationkey").intersect(t("customer", "c_nationkey")), t("nation", "n_nationkey").subtract(t("customer", "c_nationkey"))
    return both.withColumn("part", F.lit("both")).unionAll(rest.withColumn("part", F.lit("neither")))


@query("graph_graphml", f"""WITH {_EDGES} SELECT unnest(['<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<graph edgedefault="undirected">', '</graph></graphml>']) AS line
UNION ALL SELECT '<node id="' || n_nationkey || '"/>' FROM nation UNION ALL SELECT '<edge source="' || src || '" target="' || dst || '"/>' FROM e""")
def graphml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graphml(*_graph(spark, sf_dir))
