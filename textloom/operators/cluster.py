"""Clustering, latent semantics and trees over sparse vectors (doc_id, term, w)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import vector
from textloom.operators.graph import _cut


def k_means(v: DataFrame, k: int, iterations: int = 10, seed: int = 0) -> DataFrame:
    """(doc_id, cluster) by cosine. Seeds are the k documents with the smallest hash; every step is two joins on terms.

    A document that shares no term with any centroid stays where it is (cluster 0 at first); ties go to the smaller number.
    """
    ids = v.select("doc_id").distinct()
    n = F.row_number().over(Window.orderBy("_h", "doc_id"))
    seeds = ids.withColumn("_h", F.xxhash64("doc_id", F.lit(seed))).orderBy("_h", "doc_id").limit(k).withColumn("cluster", n - 1).select("doc_id", "cluster")  # k rows
    at = ids.join(seeds, "doc_id", "left").select("doc_id", F.coalesce("cluster", F.lit(0)).alias("cluster"))
    centres = v.join(seeds, "doc_id").select("cluster", "term", "w")
    for _ in range(iterations):
        unit = centres.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("cluster")))).withColumnRenamed("w", "c")
        dots = v.join(unit, "term").groupBy("doc_id", "cluster").agg(F.sum(F.col("w") * F.col("c")).alias("d"))
        near = dots.groupBy("doc_id").agg(F.max(F.struct(F.round("d", 12).alias("d"), (-F.col("cluster")).alias("c"))).alias("x")).select("doc_id", (-F.col("x.c")).alias("new"))
        both = _cut(at.join(near, "doc_id", "left").select("doc_id", F.coalesce("new", "cluster").alias("new"), "cluster"))
        at = both.select("doc_id", F.col("new").alias("cluster"))
        if both.where("new <> cluster").isEmpty():
            break
        centres = vector.centroid(v, at.withColumnRenamed("cluster", "label")).withColumnRenamed("label", "cluster")
    return at


def hierarchical(v: DataFrame, k: int = 1, bound: int = 2000) -> list[tuple[int, list, list, float]]:
    """Merges (step, members, members, distance) of centroid linkage until k clusters are left; for few documents."""
    import numpy as np

    ids = [r[0] for r in v.select("doc_id").distinct().limit(bound + 1).collect()]
    if len(ids) > bound:
        raise ValueError(f"hierarchical clustering takes at most {bound} documents; cluster with k_means first")
    rows = v.collect()
    terms = {t: i for i, t in enumerate(sorted({r["term"] for r in rows}))}
    index = {d: i for i, d in enumerate(sorted(ids))}
    x = np.zeros((len(ids), len(terms)))
    for r in rows:
        x[index[r["doc_id"]], terms[r["term"]]] += r["w"]
    groups, centres, out = [[d] for d in sorted(ids)], list(x), []
    while len(groups) > max(1, k):
        c = np.array(centres)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        far = 1 - c @ c.T
        far[np.tril_indices(len(far))] = np.inf
        i, j = np.unravel_index(np.argmin(far), far.shape)
        out.append((len(out), groups[i], groups[j], float(far[i, j])))
        a, b = len(groups[i]), len(groups[j])
        centres[i] = (centres[i] * a + centres[j] * b) / (a + b)
        groups[i] = groups[i] + groups[j]
        del groups[j], centres[j]
    return out


def latent_semantics(v: DataFrame, dimensions: int = 10, top: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, concept, w) and (term, concept, w) of a truncated SVD, factors as absolute values.

    Rows stay distributed; only the right factor, of the ``top`` terms by document frequency, comes to the driver.
    """
    from pyspark.mllib.linalg import SparseVector
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    spark = v.sparkSession
    kept = v.groupBy("term").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "term").limit(top).select("term")
    slots = kept.withColumn("slot", F.row_number().over(Window.orderBy("term")) - 1).persist()  # ``top`` rows
    size = slots.count()
    rows = v.join(F.broadcast(slots), "term").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("slot", "w"))).alias("x"))
    matrix = IndexedRowMatrix(rows.rdd.map(lambda r: IndexedRow(r["doc_id"], SparseVector(size, [e["slot"] for e in r["x"]], [e["w"] for e in r["x"]]))))
    svd = matrix.computeSVD(min(dimensions, size), computeU=True)
    docs = svd.U.rows.flatMap(lambda r: [(int(r.index), i, abs(float(x))) for i, x in enumerate(r.vector)]).toDF(["doc_id", "concept", "w"])
    right = svd.V.toArray()
    terms = spark.createDataFrame([(s, i, abs(float(right[s, i]))) for s in range(size) for i in range(right.shape[1])], "slot int, concept int, w double")
    return docs, terms.join(slots, "slot").select("term", "concept", "w")


class GainTree:
    """Decision tree over binary features in the order of their gain; its size is bounded by depth, so the driver grows it.

    A document goes down as far as it has the feature; the label is the node's most frequent one.
    """

    def __init__(self, method: str = vector.GR, depth: int = 12, least: int = 2):
        self.method, self.depth, self.least = method, depth, least

    def train(self, v: DataFrame, labels: DataFrame) -> GainTree:
        features = [r["term"] for r in vector.feature_selection(v, labels, top=200, method=self.method).collect()]
        joined = v.where(F.col("term").isin(features)).join(labels, "doc_id", "right").groupBy("doc_id", "label").agg(F.collect_set("term").alias("terms"))
        expressions = joined.groupBy("label", F.array_sort("terms").alias("terms")).count().collect()
        self.tree = self._grow([(r["label"], frozenset(r["terms"]), r["count"]) for r in expressions], features, self.depth)
        return self

    def _grow(self, rows: Sequence, features: Sequence[str], depth: int) -> dict:
        total: dict = {}
        for label, _, n in rows:
            total[label] = total.get(label, 0) + n
        node = {"label": min(total, key=lambda x: (-total[x], x)) if total else None}
        if depth and len(total) > 1:
            for i, f in enumerate(features):
                yes, no = [r for r in rows if f in r[1]], [r for r in rows if f not in r[1]]
                if sum(r[2] for r in yes) >= self.least and no:
                    node |= {"feature": f, "yes": self._grow(yes, features[i + 1 :], depth - 1), "no": self._grow(no, features[i + 1 :], depth - 1)}
                    break
        return node

    def predict(self, v: DataFrame) -> DataFrame:
        def expression(node: dict):
            if "feature" not in node:
                return F.lit(node["label"])
            return F.when(F.array_contains("terms", node["feature"]), expression(node["yes"])).otherwise(expression(node["no"]))

        return v.groupBy("doc_id").agg(F.collect_set("term").alias("terms")).select("doc_id", expression(self.tree).alias("predicted"))


class Genetic:
    """Select the fittest, recombine, mutate; subclass with fitness, combine and mutate."""

    def __init__(self, candidates: Sequence, seed: int = 0):
        import random

        self.random, self.population, self.generation = random.Random(seed), list(candidates), 0

    def fitness(self, candidate) -> float:
        raise NotImplementedError

    def combine(self, a, b):
        raise NotImplementedError

    def mutate(self, candidate):
        return candidate

    def update(self, top: float = 0.5, mutation: float = 0.5) -> None:
        best = sorted(self.population, key=self.fitness, reverse=True)[: max(2, round(top * len(self.population)))]
        new = [self.combine(*self.random.sample(best, 2)) for _ in self.population]
        self.population = [self.mutate(c) if self.random.random() < mutation else c for c in new]
        self.generation += 1

    @property
    def fittest(self):
        return max(self.population, key=self.fitness)


def condensed(v: DataFrame, labels: DataFrame, k: int = 1, rounds: int = 3) -> DataFrame:
    """Labels (doc_id, label) of prototypes: documents that the prototypes so far get wrong join them, round by round."""
    from textloom.operators.classify import NearestNeighbors

    kept = vector.resample(labels, 1)
    for _ in range(rounds):
        model = NearestNeighbors(k).train(v, kept)
        guess = model.predict(v.join(kept.select("doc_id"), "doc_id", "left_anti"))
        wrong = labels.join(kept.select("doc_id"), "doc_id", "left_anti").join(guess, "doc_id", "left").where(F.col("predicted").isNull() | (F.col("predicted") != F.col("label"))).select("doc_id", "label")
        kept = _cut(kept.unionByName(wrong))
    return kept
