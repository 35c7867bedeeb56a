"""The online averaged perceptron, by iterative parameter mixing.

Documents are dealt into shards of a bounded size.  In each epoch every shard runs the online rule over its documents in a
fixed order, beginning with the same weights: a document that is classified wrongly adds 1 to the weights of its terms for
its own label and takes 1 from those of the label that was guessed.  A weight has a running sum over errors, brought
up to date only when the weight changes: its new value then counts for all errors since the last change.  Guesses are made
by these sums, divided by the number of errors so far.

After an epoch a weight is the mean over the shards, and the sums of all shards add up.  So one shard gives exactly what
going through all documents in order gives, and more shards the average over all updates that were made anywhere.

Weights begin at 0.  Of labels with equal scores the one seen less often, then the smaller one, is taken; before any
weight is known the label seen most often, then the smaller one.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import lineage

_STATE = "shard int, label string, term string, w double, total double, n long"
MOST_CLASSES = 10_000


class Online:
    """The rule over documents one after another; ``weights`` has (weight, sum, errors when last changed) by label and term."""

    def __init__(self, errors: int = 0):
        self.weights: dict[str, dict[str, list[float]]] = {}
        self.seen: dict[str, int] = {}
        self.errors = errors

    def guess(self, terms: Iterable[str]) -> str:
        if not self.weights:
            return min(self.seen, key=lambda c: (-self.seen[c], c))
        n, scores = self.errors or 1, {}
        for label, weights in self.weights.items():
            s = 0.0
            for t in terms:
                found = weights.get(t)
                if found:
                    s += (n - found[2]) * found[0] + found[1]
            scores[label] = round(s / n, 9)
        top = max(scores.values())
        return min((c for c, s in scores.items() if s == top), key=lambda c: (self.seen.get(c, 0), c))

    def learn(self, terms: Iterable[str], label: str) -> None:
        self.seen[label] = self.seen.get(label, 0) + 1
        guess = self.guess(terms)
        if guess == label:
            return
        self.errors += 1
        for c, step in ((label, 1.0), (guess, -1.0)):
            weights = self.weights.setdefault(c, {})
            for t in terms:
                found = weights.setdefault(t, [0.0, 0.0, 0])
                found[0] += step
                found[1] += (self.errors - found[2]) * found[0]
                found[2] = self.errors

    def totals(self) -> Iterable[tuple[str, str, float, float]]:
        """(label, term, weight, sum up to the last error)."""
        for label, weights in self.weights.items():
            for term, (w, total, at, *_) in weights.items():
                yield label, term, w, total + (self.errors - at) * w


class AveragedPerceptron:
    """``per_shard``: about how many documents one task holds at a time; shards follow from their number, or are given."""

    def __init__(self, epochs: int = 5, per_shard: int = 20_000, shards: int | None = None):
        self.epochs, self.per_shard, self.shards = epochs, per_shard, shards

    def train(self, v: DataFrame, labels: DataFrame) -> AveragedPerceptron:
        """v: (doc_id, term, ...), labels: (doc_id, label). Documents without a label or a term take no part."""
        docs = v.groupBy("doc_id").agg(F.array_sort(F.collect_set("term")).alias("terms")).join(labels.where(F.col("label").isNotNull()), "doc_id")
        n = labels.count()
        shards = self.shards or max(1, -(-n // self.per_shard))
        docs = docs.select("doc_id", F.col("label").cast("string").alias("label"), "terms", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")).persist()
        places = docs.select("shard", F.explode("terms").alias("term")).distinct().persist()
        spark = v.sparkSession
        state = spark.createDataFrame([], "label string, term string, w double, total double, at long")
        seen: dict[str, int] = {}
        errors = 0
        for epoch in range(self.epochs):
            mine = places.join(state, "term").select(F.col("shard").alias("of"), "label", "term", "w", "total", "at")
            ran = lineage.cut(docs.groupBy("shard").cogroup(mine.groupBy("of")).applyInPandas(_epoch(epoch, errors, seen, shards == 1), _STATE))
            # rows without a term tell how often a shard saw a label; without either, its errors
            told = ran.where(F.col("term").isNull()).groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("k")).limit(MOST_CLASSES + 2).collect()
            if len(told) > MOST_CLASSES + 1:
                raise ValueError(f"more than {MOST_CLASSES} labels")
            moved = ran.where(F.col("term").isNotNull()).groupBy("label", "term").agg(F.sum("w").alias("dw"), F.sum("total").alias("dt"), F.max("n").alias("changed"))
            made = sum(r.n for r in told if r.label is None)
            both = state.join(moved, ["label", "term"], "full")
            w, total = F.coalesce("w", F.lit(0.0)), F.coalesce("total", F.lit(0.0))
            if shards == 1:  # sums go on as they are
                sums = [F.coalesce("dt", total).alias("total"), F.coalesce("changed", "at").alias("at")]
            else:  # all are brought up to date
                sums = [(total + F.coalesce("dt", F.lit(0.0)) + w * made).alias("total"), F.lit(errors + made).cast("long").alias("at")]
            state = lineage.cut(both.select("label", "term", (w + F.coalesce("dw", F.lit(0.0)) / shards).alias("w"), *sums))
            errors += made
            for r in told:
                if r.label is not None:
                    seen[r.label] = seen.get(r.label, 0) + r.n
            if not made:
                break
        docs.unpersist(), places.unpersist()
        self.errors, self.seen = errors, seen
        self.weights = state.select("label", "term", ((F.col("total") + (errors - F.col("at")) * F.col("w")) / max(1, errors)).alias("w"))
        self.labels = sorted(r.label for r in state.select("label").distinct().collect())  # at most MOST_CLASSES
        return self

    def classify(self, v: DataFrame) -> DataFrame:
        """(doc_id, label, p) for each label that has weights: shares by e to the score."""
        if not self.labels:
            first = min(self.seen, key=lambda c: (-self.seen[c], c))
            return v.select("doc_id").distinct().select("doc_id", F.lit(first).alias("label"), F.lit(1.0).alias("p"))
        s = v.select("doc_id", "term").distinct().join(self.weights, "term", "left").groupBy("doc_id", "label").agg(F.sum("w").alias("s"))
        by_label = F.map_from_entries(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "s"))))
        every = s.groupBy("doc_id").agg(by_label.alias("s")).select("doc_id", F.explode(F.array(*map(F.lit, self.labels))).alias("label"), "s")
        scored = every.select("doc_id", "label", F.round(F.coalesce(F.try_element_at("s", F.col("label")), F.lit(0.0)), 9).alias("s"))
        w = Window.partitionBy("doc_id")
        return scored.withColumn("e", F.exp(F.col("s") - F.max("s").over(w))).select("doc_id", "label", (F.col("e") / F.sum("e").over(w)).alias("p"))

    def predict(self, v: DataFrame) -> DataFrame:
        seen = F.create_map(*[x for c in sorted(self.seen) for x in (F.lit(c), F.lit(self.seen[c]))])
        best = F.min_by("label", F.struct(-F.col("p"), F.try_element_at(seen, F.col("label")), "label"))
        return self.classify(v).groupBy("doc_id").agg(best.alias("predicted"))


def _epoch(epoch: int, errors: int, seen: dict[str, int], alone: bool):
    def run(docs: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        rule = Online(errors)
        rule.seen = dict(seen)
        for label, term, w, total, at in zip(*(state[x] for x in ("label", "term", "w", "total", "at")), strict=True):
            rule.weights.setdefault(label, {})[term] = [w, total, int(at), w, total]  # the last two stay
        out = []
        if len(docs):
            shard = int(docs["shard"].iloc[0])
            # ids in a fixed order that differs by epoch
            for _, label, terms in sorted(zip(docs["doc_id"], docs["label"], docs["terms"], strict=True), key=lambda x: (_scatter(x[0], epoch), x[0])):
                rule.learn(terms, label)
            made = rule.errors - errors
            for label, weights in rule.weights.items():
                for term, (w, total, at, *before) in weights.items():
                    w0, t0 = before or (0.0, 0.0)
                    if at > errors:  # it changed
                        # what other shards add while this one doesn't change it is added for all: w0 for each error
                        up = total if alone else total + (rule.errors - at) * w - t0 - made * w0
                        out.append((shard, label, term, w - w0, up, at))
            out += [(shard, label, None, None, None, n - seen.get(label, 0)) for label, n in rule.seen.items()]
            out.append((shard, None, None, None, None, made))
        return pd.DataFrame(out, columns=["shard", "label", "term", "w", "total", "n"]).astype({"n": "Int64"})

    return run


def _scatter(doc_id, epoch: int) -> int:
    import zlib

    return zlib.crc32(f"{epoch}:{doc_id}".encode())
