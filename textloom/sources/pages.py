"""Pages as a source: a cache of fetched pages by address and age, probes of what was fetched, articles by sections, word lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FETCHED = "url string, status int, type string, location string, html string, fetched_at timestamp"


class PageCache:
    """Fetched pages as Parquet, dealt by the first digits of a hash of their address; the newest one of an address counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, pages: DataFrame) -> None:
        """Add rows of ``FETCHED``."""
        key = F.md5("url")
        pages.select("url", "status", "type", "location", "html", "fetched_at", key.alias("key"), F.left(key, F.lit(2)).alias("part")).write.mode("append").partitionBy("part").parquet(self.path)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{FETCHED}, key string, part string").parquet(self.path)

    def newest(self, since: Column | None = None) -> DataFrame:
        rows = self._all() if since is None else self._all().where(F.col("fetched_at") >= since)
        fields = [c.split()[0] for c in FETCHED.split(", ")]
        return rows.groupBy("part", "key").agg(F.max_by(F.struct(*fields), "fetched_at").alias("x")).select("x.*")

    def get(self, urls: DataFrame, since: Column | None = None) -> DataFrame:
        """Each address with what the cache has of it that isn't older than ``since``; null where nothing is."""
        return urls.select("url").distinct().join(self.newest(since), "url", "left")

    def clear(self, before: Column, path: str) -> PageCache:
        """A cache at another path without pages fetched before a time; readers of this one aren't disturbed."""
        kept = PageCache(self.spark, path)
        kept.put(self._all().where(F.col("fetched_at") >= before))
        return kept


def exists(status: Column) -> Column:
    return F.coalesce((status >= 200) & (status < 400), F.lit(False))


def mime_type(header: Column) -> Column:
    """The type of a content-type header, without its parameters."""
    return F.nullif(F.trim(F.lower(F.substring_index(header, ";", 1))), F.lit(""))


def redirect(url: Column, location: Column) -> Column:
    """Where a page's address leads, if elsewhere."""
    return F.when(location.isNotNull() & (location != url), location)


SECTIONS = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())]))
_HEADING = re.compile(r"<h([1-6])\b[^>]*>(.*?)</h\1\s*>", re.S | re.I)


@F.pandas_udf(SECTIONS)
def sections(html: pd.Series) -> pd.Series:
    """An article's parts by its headings, in order; what stands before the first heading has level 0."""
    from textloom.operators.web import to_plaintext

    def one(page: str | None) -> list:
        parts = _HEADING.split(page or "")
        heads = [(0, "", parts[0])] + [(int(parts[i]), to_plaintext(parts[i + 1]), parts[i + 2]) for i in range(1, len(parts), 3)]
        return [{"level": n, "title": t, "text": to_plaintext(x)} for n, t, x in heads if n or to_plaintext(x)]

    return html.map(one)


def wordlist(spark: SparkSession, path: str, comment: str = "#") -> DataFrame:
    """(word): the different words of a text file, one a line or apart by commas; lines that begin with ``comment`` don't count."""
    lines = spark.read.text(path).where(~F.ltrim("value").startswith(comment))
    return lines.select(F.explode(F.split("value", ",")).alias("word")).select(F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()


def members(words: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of ``words`` (word, ...) whose word is in a list."""
    return words.join(lists.select("word").distinct(), "word", "left_semi")
