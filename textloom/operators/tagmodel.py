"""An averaged perceptron that tags words by their own form and what stands around them; trained on a bounded sample, applied in batches."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAGGED = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("tag", T.StringType())]))


def features(words: Sequence[str], i: int, before: str, last: str) -> list[str]:
    """What is known of word i: itself, its ends and shape, its neighbours, and the two tags before it."""
    w = words[i]
    low = w.lower()
    shape = "".join("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in w[:4])
    around = [words[k].lower() if 0 <= k < len(words) else "" for k in (i - 1, i + 1)]
    return [f"w {low}", f"e1 {low[-1:]}", f"e2 {low[-2:]}", f"e3 {low[-3:]}", f"b1 {low[:1]}", f"s {shape}", f"p {around[0]}", f"n {around[1]}", f"t {last}", f"tt {before} {last}", f"tw {last} {low}"]


class TagModel:
    def __init__(self):
        self.weights: dict[str, dict[str, float]] = {}
        self.tags: list[str] = []

    def _best(self, found: Iterable[str]) -> str:
        scores: dict[str, float] = defaultdict(float)
        for f in found:
            for tag, w in self.weights.get(f, {}).items():
                scores[tag] += w
        return max(self.tags, key=lambda t: (scores[t], t)) if self.tags else ""

    def tag(self, words: Sequence[str]) -> list[tuple[str, str]]:
        out, before, last = [], "", ""
        for i in range(len(words)):
            t = self._best(features(words, i, before, last))
            out.append((words[i], t))
            before, last = last, t
        return out

    def train(self, tagged: DataFrame, epochs: int = 5, bound: int = 50_000) -> TagModel:
        """From at most ``bound`` sentences (those of the smallest hash) of a column ``words`` of (word, tag) structs."""
        rows = tagged.select("words").orderBy(F.xxhash64("words")).limit(bound).collect()
        sentences = [([x["word"] for x in r["words"]], [x["tag"] for x in r["words"]]) for r in rows if r["words"]]
        self.tags = sorted({t for _, tags in sentences for t in tags})
        total: dict[tuple[str, str], float] = defaultdict(float)
        since: dict[tuple[str, str], int] = defaultdict(int)
        w: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self.weights, now = w, 0

        def move(f: str, tag: str, by: float) -> None:
            total[f, tag] += (now - since[f, tag]) * w[f][tag]
            since[f, tag] = now
            w[f][tag] += by

        for _ in range(epochs):
            for words, tags in sentences:
                before, last = "", ""
                for i, right in enumerate(tags):
                    now += 1
                    found = features(words, i, before, last)
                    guess = self._best(found)
                    if guess != right:
                        for f in found:
                            move(f, right, 1.0)
                            move(f, guess, -1.0)
                    before, last = last, right
        mean = {f: {t: (total[f, t] + (now - since[f, t]) * x) / max(now, 1) for t, x in tags.items()} for f, tags in w.items()}
        self.weights = {f: kept for f, tags in mean.items() if (kept := {t: x for t, x in tags.items() if abs(x) > 1e-9})}
        return self

    def udf(self):
        """A column function from an array of words to (word, tag) structs; the weights go with the function."""
        model = self

        @F.pandas_udf(TAGGED)
        def run(words: pd.Series) -> pd.Series:
            return words.map(lambda x: None if x is None else [{"word": w, "tag": t} for w, t in model.tag(list(x))])

        return run
