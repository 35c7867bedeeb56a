"""Semantic networks: typed concept graphs with halos, properties, similarity and taxonomies.

Edges are (src, relation, dst, context, weight); ``a is-property-of b`` and ``a is-a b`` have their own meaning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import graph

PROPERTY, IS_A = "is-property-of", "is-a"


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of (concept, relation, concept, context, strength); weights are a tenth of the strength, 1 at most."""
    df = spark.read.schema("src string, relation string, dst string, context string, strength double").csv(path)
    return df.select("src", "relation", "dst", "context", F.least(F.col("strength") * 0.1, F.lit(1.0)).alias("weight"))


def halo(edges: DataFrame, concept: str, depth: int = 2) -> DataFrame:
    """Edges among the concepts within ``depth`` steps."""
    start = edges.sparkSession.createDataFrame([(concept,)], "id string")
    return graph.subgraph(edges, graph.neighborhood(edges, start, depth))


def properties(edges: DataFrame, concept: str, depth: int = 2, top: int = 10) -> DataFrame:
    """(property, betweenness) of a concept: the properties in its halo, most central first."""
    around = halo(edges, concept, depth)
    nodes = graph.links(around).select("id").distinct()
    central = graph.betweenness(nodes, around, groups=8)
    own = around.where(F.col("relation") == PROPERTY).select(F.col("src").alias("id")).distinct()
    return central.join(own, "id", "left_semi").where(F.col("id") != concept).orderBy(F.desc("betweenness"), "id").limit(top).select(F.col("id").alias("property"), "betweenness")


def similarity(edges: DataFrame, a: str, b: str, k: int = 3) -> float:
    """How near the k most central properties of two concepts are: the sum of 1 / (nodes of the shortest path) over k."""
    pa, pb = ([r["property"] for r in properties(edges, c, top=k).collect()] for c in (a, b))  # k names each
    if not pa or not pb:
        return 0.0
    spark = edges.sparkSession
    paths = graph.shortest_paths(edges, spark.createDataFrame([(x,) for x in pa], "id string"))
    near = paths.where(F.col("id").isin(pb)).select(F.size("path").alias("n")).agg(F.sum(1.0 / F.greatest(F.col("n"), F.lit(1)))).first()[0]
    return float(near or 0.0) / k


def taxonomy(edges: DataFrame, concept: str, depth: int = 3) -> DataFrame:
    """(descendant, distance) of what is a ``concept``."""
    h = edges.where(F.col("relation") == IS_A).select(F.col("dst").alias("parent"), F.col("src").alias("child"))
    return graph.closure(h, depth).where(F.col("ancestor") == concept).select("descendant", "distance")


def synset_similarity(frequencies: DataFrame, hypernyms: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) by Lin: twice the information of the most informative common ancestor over that of both.

    ``frequencies`` is (id, n), ``hypernyms`` (parent, child); counts add up along the hierarchy.
    """
    up = graph.closure(hypernyms).select("ancestor", "descendant")
    ids = frequencies.select("id")
    every = up.unionAll(ids.select(F.col("id").alias("ancestor"), F.col("id").alias("descendant")))
    total = frequencies.agg(F.sum("n").alias("total"))
    ic = every.join(frequencies, F.col("descendant") == F.col("id")).groupBy("ancestor").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).select(F.col("ancestor").alias("id"), (-F.log(F.col("n") / F.col("total"))).alias("ic"))  # one row
    over = lambda x: pairs.select("a", "b").distinct().join(every.select(F.col("descendant").alias(x), "ancestor"), x).select("a", "b", "ancestor")
    both = over("a").intersect(over("b")).join(ic, F.col("ancestor") == F.col("id")).groupBy("a", "b").agg(F.max("ic").alias("c"))
    own = lambda x: ic.select(F.col("id").alias(x), F.col("ic").alias(f"i{x}"))
    s = pairs.join(both, ["a", "b"], "left").join(own("a"), "a").join(own("b"), "b")
    return s.select("a", "b", (2 * F.coalesce("c", F.lit(0.0)) / F.when(F.col("ia") + F.col("ib") == 0, 1).otherwise(F.col("ia") + F.col("ib"))).alias("similarity"))
