"""A tagger that learns from tagged words alone: known words by their commonest tag, others by their longest known ending.

A language is its table of tagged words.  Endings of all lengths, with the tags of the different words that have them, are
counted into a table which is looked up by join; a longer ending goes before a shorter one, and the empty ending, which
every word has, is the last resort.  Words that differ by case are one word unless ``case`` is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def endings(word: Column, longest: int | None = None) -> Column:
    """All endings of a word by length, the empty one first."""
    n = F.char_length(word) if longest is None else F.least(F.char_length(word), F.lit(longest))
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.right(word, k))


class SuffixTagger:
    """``least``: different words that an ending needs; ``share``: of them that need to have its commonest tag."""

    def __init__(self, longest: int | None = None, least: int = 2, share: float = 0.0, case: bool = False):
        self.longest, self.least, self.share, self.case = longest, least, share, case

    def _form(self, word: Column) -> Column:
        return word if self.case else F.lower(word)

    def train(self, tagged: DataFrame) -> SuffixTagger:
        """tagged: (word, tag), a row for each occurrence. Rows without one or the other don't count."""
        rows = tagged.where(F.col("word").isNotNull() & F.col("tag").isNotNull()).select(self._form(F.col("word")).alias("word"), "tag")
        counts = rows.groupBy("word", "tag").agg(F.count("*").alias("n"))
        first = lambda n: F.min_by("tag", F.struct(-F.col(n), F.col("tag")))  # noqa: E731  of equals the smaller tag
        self.lexicon = counts.groupBy("word").agg(first("n").alias("tag"), F.sum("n").alias("n"))
        # a word counts once for each of its tags, so common words don't drown the others
        found = counts.select("tag", F.explode(endings(F.col("word"), self.longest)).alias("ending")).groupBy("ending", "tag").agg(F.count("*").alias("n"))
        self.endings = found.groupBy("ending").agg(first("n").alias("tag"), F.max("n").alias("top"), F.sum("n").alias("n")).where(((F.col("n") >= self.least) & (F.col("top") >= self.share * F.col("n"))) | (F.col("ending") == ""))
        return self

    def tag(self, words: DataFrame, word: str = "word") -> DataFrame:
        """words with ``tag`` and ``by``: ``word``, or the ending that decided. A null word has neither."""
        form = words.select(self._form(F.col(word)).alias("form")).where(F.col("form").isNotNull()).distinct()
        known = self.lexicon.select(F.col("word").alias("form"), "tag", F.lit("word").alias("by"))
        lost = form.join(known.select("form"), "form", "left_anti")
        tried = lost.select("form", F.explode(endings(F.col("form"), self.longest)).alias("ending")).join(self.endings.select("ending", "tag"), "ending")
        guessed = tried.groupBy("form").agg(F.max_by("tag", F.char_length("ending")).alias("tag"), F.max_by("ending", F.char_length("ending")).alias("by"))
        found = form.join(known, "form").unionByName(guessed)
        kept = words.drop("tag", "by")
        return kept.withColumn("_form", self._form(F.col(word))).join(found.withColumnRenamed("form", "_form"), "_form", "left").drop("_form")
