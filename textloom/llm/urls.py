"""URL filters: a temporal join of captures with dated list entries.

An entry (list_id, kind, rule, action, dated) adds or removes a rule: kind ``domain`` covers a domain and all below
it, ``host`` one host, ``prefix`` a host and the beginning of its path up to a slash.  The entries of a rule, sorted by
date, become validity intervals [valid_from, valid_to); an as-of join evaluates every capture against the entries active
when it was fetched.  On one date a removal counts after an addition.

A capture is covered by a rule if one of its keys (its domains, its host, its path's prefixes) equals it, so the join
is an equi-join on the key with a range condition.  No side is broadcast by hand and the optimiser may split a hot key.

Defined results: a null or unparsable URL has no keys and is allowed; a fetch time that is null or none meets no interval; equal captures
(page_id, url, fetched_at) give one row; an entry with a null field or a date that is none is ignored; empty tables give empty or allowed rows.
An active ``allow`` entry overrides ``block`` entries with a shorter or equally long rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (list_id, kind, rule, policy, valid_from, valid_to); valid_to is null while still active."""
    by = Window.partitionBy("list_id", "policy", "kind", "rule").orderBy("dated", "removal")
    e = entries.select("list_id", "policy", "kind", F.lower("rule").alias("rule"), F.col("dated").try_cast("timestamp").alias("dated"), (F.col("action") == "remove").alias("removal")).dropna().distinct()
    return e.withColumn("valid_to", F.lead("dated").over(by)).where(~F.col("removal")).select("list_id", "policy", "kind", "rule", F.col("dated").alias("valid_from"), "valid_to")


def keys(url: Column) -> Column:
    """All (kind, rule) keys which cover a URL."""
    name = host(url)
    labels = F.split(name, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("rule")))
    parts = F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(name, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.when(i < F.size(parts), "/").otherwise("")).alias("rule")))
    own = F.array(F.struct(F.lit("host").alias("kind"), name.alias("rule")))
    none = F.array().cast("array<struct<kind:string,rule:string>>")
    return F.when(F.coalesce(name, F.lit("")) == "", none).otherwise(F.array_distinct(F.concat(domains, own, prefixes)))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at, n_active, blocked, matched) of every distinct capture."""
    c = captures.select("page_id", "url", F.col("fetched_at").try_cast("timestamp").alias("fetched_at")).distinct()
    keyed = c.select("*", F.explode_outer(keys(F.col("url"))).alias("key")).select("page_id", "url", "fetched_at", "key.kind", "key.rule")
    # dates are part of the join, so a capture meets only what was active
    k, i = keyed.alias("k"), intervals(entries).alias("i")
    then = (F.col("k.fetched_at") >= F.col("i.valid_from")) & (F.col("i.valid_to").isNull() | (F.col("k.fetched_at") < F.col("i.valid_to")))
    active = k.join(i, (F.col("k.kind") == F.col("i.kind")) & (F.col("k.rule") == F.col("i.rule")) & then, "left").select("page_id", "url", "fetched_at", "k.kind", "k.rule", "policy", "list_id")
    on = F.col("policy").isNotNull()
    longest = lambda policy: F.coalesce(F.max(F.when(on & (F.col("policy") == policy), F.char_length("rule"))), F.lit(0))
    names = F.collect_set(F.when(on, F.concat_ws(":", "policy", "list_id", "kind", "rule")))
    return active.groupBy("page_id", "url", "fetched_at").agg(
        F.count_if(on).alias("n_active"), (longest("block") > longest("allow")).alias("blocked"), F.array_join(F.array_sort(names), ",").alias("matched")
    )
