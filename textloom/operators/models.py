"""What surrounds classifiers and vector models: statistics of training data, search of parameters, files, seeds of clusters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.operators import classify, vector


def distribution(labels: DataFrame) -> DataFrame:
    """(label, n) of training data."""
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def baselines(labels: DataFrame) -> DataFrame:
    """One row: majority and minority class (of equals the larger and the smaller label), the share of the majority, the
    accuracy of guessing by the distribution, and the skewness of the classes numbered by label."""
    d = distribution(labels).withColumn("k", F.row_number().over(Window.orderBy("label")) - 1)  # a row a class
    total = F.sum("n")
    mean = F.sum(F.col("k") * F.col("n")) / total
    moments = d.agg(F.max_by("label", F.struct("n", "label")).alias("majority"), F.min_by("label", F.struct("n", "label")).alias("minority"), (F.max("n") / total).alias("share"), total.alias("total"), mean.alias("mean"))
    joined = d.crossJoin(F.broadcast(moments))  # one row
    off = F.col("k") - F.col("mean")
    third, second = F.sum(off * off * off * F.col("n")) / F.first("total"), F.sum(off * off * F.col("n")) / F.first("total")
    return joined.agg(
        F.first("majority").alias("majority"), F.first("minority").alias("minority"), F.first("share").alias("baseline"), F.sum((F.col("n") / F.col("total")) ** 2).alias("weighted_random_baseline"),
        (third / F.when(second > 0, second**1.5).otherwise(1.0)).alias("skewness"),
    )


def grid_search(make: Callable[..., Any], v: DataFrame, labels: DataFrame, folds: int = 10, **grid: Sequence) -> list[tuple[dict, dict]]:
    """(mean scores, parameters) of every combination of parameters, best accuracy first."""
    found = []
    for values in product(*grid.values()):
        given = dict(zip(grid, values, strict=True))
        scores = classify.cross_validate(lambda given=given: make(**given), v, labels, folds)
        found.append(({k: sum(s[k] for s in scores) / len(scores) for k in scores[0]}, given))
    return sorted(found, key=lambda x: -x[0]["accuracy"])


def save(model: Any, path: str) -> None:
    """A model's frames as Parquet, and its plain settings, under a path."""
    frames = {k: x for k, x in vars(model).items() if isinstance(x, DataFrame)}
    for k, x in frames.items():
        x.write.mode("overwrite").parquet(f"{path}/{k}")
    spark = next(iter(frames.values())).sparkSession
    plain = [(k, type(x).__name__, str(x)) for k, x in vars(model).items() if isinstance(x, (str, int, float))]
    spark.createDataFrame(plain, "name string, kind string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_settings")
    spark.createDataFrame([(k,) for k in frames], "name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/_frames")


def load(spark: SparkSession, path: str, kind: type) -> Any:
    """A model that ``save`` wrote."""
    model = kind.__new__(kind)
    casts = {"str": str, "int": int, "float": float, "bool": lambda x: x == "True"}
    for name, t, value in spark.read.parquet(f"{path}/_settings").collect():
        setattr(model, name, casts[t](value))
    for (name,) in spark.read.parquet(f"{path}/_frames").collect():
        setattr(model, name, spark.read.parquet(f"{path}/{name}"))
    return model


class Corpus:
    """Postings (doc_id, term, n) that documents are added to and taken from; weights follow."""

    def __init__(self, postings: DataFrame):
        self.postings = postings

    def append(self, more: DataFrame) -> Corpus:
        """Documents of ``more`` take the place of those with the same id."""
        kept = self.postings.join(more.select("doc_id").distinct(), "doc_id", "left_anti")
        return Corpus(kept.unionByName(more.select(*self.postings.columns)))

    def remove(self, ids: DataFrame) -> Corpus:
        return Corpus(self.postings.join(ids.select("doc_id").distinct(), "doc_id", "left_anti"))

    def clear(self) -> Corpus:
        return Corpus(self.postings.limit(0))

    def document(self, doc_id: Any) -> DataFrame:
        return self.postings.where(F.col("doc_id") == doc_id)

    def terms(self) -> DataFrame:
        """(term, at): the vector space, terms in order."""
        from textloom.functions import lists

        return lists.ordinals(self.postings.select("term").distinct(), "term", name="at")

    def vectors(self, scheme: str = vector.TFIDF) -> DataFrame:
        return vector.weights(self.postings, scheme)


def _lines(v: DataFrame, labels: DataFrame, separator: str, last: Column) -> tuple[list[str], DataFrame]:
    """Terms in order, and a line of weights for each document; the header needs all terms, so it is for models of a bounded number of terms."""
    terms = [r[0] for r in v.select("term").distinct().orderBy("term").limit(100_001).collect()]
    if len(terms) > 100_000:
        raise ValueError("too many terms for a table with a column each")
    weights = v.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("m"))
    number = lambda t: F.coalesce(F.when(F.element_at("m", t) != 0, F.format_string("%.4f", F.element_at("m", t))), F.lit("0"))
    cells = F.array_join(F.transform(F.array(*map(F.lit, terms)), number), separator)
    return terms, weights.join(labels, "doc_id", "left").select("doc_id", F.concat_ws(separator, cells, last).alias("line"))


def orange_tab(v: DataFrame, labels: DataFrame) -> tuple[str, DataFrame]:
    """(header, (doc_id, line)) in tab-separated form with name and class of each document."""
    name = F.concat_ws("\t", F.col("doc_id").cast("string"), F.coalesce("label", F.lit("")))
    terms, lines = _lines(v, labels, "\t", name)
    return "\t".join([*terms, "m#name", "c#type"]), lines


def arff(v: DataFrame, labels: DataFrame, relation: str) -> tuple[str, DataFrame]:
    """(header, (doc_id, line)) in attribute-relation form."""
    terms, lines = _lines(v, labels, ",", F.coalesce("label", F.lit("")))
    classes = ",".join(r[0] for r in labels.select("label").distinct().orderBy("label").collect())  # a row a class
    return "\n".join([f"@RELATION {relation}", *(f"@ATTRIBUTE {t} NUMERIC" for t in terms), f"@ATTRIBUTE class {{{classes}}}", "@DATA"]), lines


def plus_plus(v: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(doc_id, cluster) of k seeds, each drawn with a chance in proportion to its cosine distance from those before it.

    A draw is the largest of u ** (1 / d) over all documents, u being a hash as a share: no sum over documents in order is needed.
    """
    norm = v.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = v.join(norm, "doc_id").where("norm > 0").select("doc_id", "term", (F.col("w") / F.col("norm")).alias("w")).persist()
    ids = unit.select("doc_id").distinct()
    chance = lambda r: (F.pmod(F.xxhash64("doc_id", F.lit(seed), F.lit(r)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    first = ids.orderBy(chance(0).desc(), "doc_id").first()
    if first is None:
        return v.sparkSession.createDataFrame([], "doc_id long, cluster int")
    seeds = [first[0]]
    near = None
    for r in range(1, k):
        centre = unit.where(F.col("doc_id") == seeds[-1]).select("term", F.col("w").alias("c"))
        dots = unit.join(centre, "term").groupBy("doc_id").agg(F.sum(F.col("w") * F.col("c")).alias("dot"))
        one = ids.join(dots, "doc_id", "left").select("doc_id", (1 - F.coalesce("dot", F.lit(0.0))).alias("d"))
        near = one if near is None else near.unionAll(one).groupBy("doc_id").agg(F.min("d").alias("d"))
        drawn = near.where(F.col("d") > 1e-9).orderBy((F.log(chance(r)) / F.col("d")).desc(), "doc_id").first()
        if drawn is None:
            break
        seeds.append(drawn[0])
    unit.unpersist()
    return v.sparkSession.createDataFrame(list(zip(seeds, range(len(seeds)), strict=True)), "doc_id long, cluster int")


class Distances:
    """Distances of pairs of documents, computed once each and kept in a cached frame."""

    def __init__(self, v: DataFrame, method: str = vector.COSINE):
        self.v, self.method, self.known = v, method, None

    def of(self, pairs: DataFrame) -> DataFrame:
        """(a, b, distance) of pairs (a, b)."""
        pairs = pairs.select("a", "b").distinct()
        new = pairs if self.known is None else pairs.join(self.known, ["a", "b"], "left_anti")
        found = vector.distances(self.v, new, self.method)
        self.known = (found if self.known is None else self.known.unionByName(found)).persist()
        return pairs.join(self.known, ["a", "b"])
