"""Ordinals, chunks, groups and combinations: what lists offer, for DataFrames and array columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.lineage import cut


def ordinals(df: DataFrame, *order: str | Column, name: str = "ordinal") -> DataFrame:
    """df with the 0-based rank of each row by ``order``, which has to tell rows apart.

    Rows are dealt by ranges and numbered where they are; only a count a partition is sent out, so no task sees all rows.
    The dealt rows are checkpointed: ranges come from a sample, which another run would draw anew.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted(dealt.groupBy(part.alias("p")).count().collect())
    base, starts = 0, []
    for p, n in counts:
        starts.append((p, base))
        base += n
    first = reduce(lambda c, x: c.when(part == x[0], F.lit(x[1])), starts, F.when(F.lit(False), F.lit(0))).otherwise(F.lit(0))
    return dealt.withColumn(name, (first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")


def chunks(df: DataFrame, n: int, *order: str | Column, name: str = "chunk") -> DataFrame:
    """df with the number of the one of n successive parts that a row is in; the first ones are longer by one where needed."""
    ranked = ordinals(df, *order, name="_n")
    total = df.count()
    size, longer = divmod(total, n)
    cut = longer * (size + 1)
    at = F.when(F.col("_n") < cut, F.floor(F.col("_n") / (size + 1))).otherwise(longer + F.floor((F.col("_n") - cut) / max(size, 1)))
    return ranked.withColumn(name, at.cast("int")).drop("_n")


def mixed(frames: Sequence[DataFrame], n: int, order: str, name: str = "ordinal") -> DataFrame:
    """Rows of several frames of one schema, alternating in n chunks."""
    parts = [chunks(f, n, order, name="_c").withColumn("_f", F.lit(i)) for i, f in enumerate(frames)]
    return ordinals(reduce(DataFrame.unionAll, parts), "_c", "_f", order, name=name).drop("_c", "_f")


def binned(df: DataFrame, key: str | Column, value: str, order: str) -> DataFrame:
    """(key, values): the values of each key in order."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias("key")).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]).alias("values"))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """df with an ordinal of a random order that a seed and a row's key give."""
    return ordinals(df, F.xxhash64(key, F.lit(seed)), key)


def first_match(df: DataFrame, condition: Column, *order: str | Column) -> DataFrame:
    """The first row, by order, that meets a condition; none if no row does. Only one row a task is kept."""
    return df.where(condition).orderBy(*order).limit(1)


def order(items: Column, reverse: bool = False) -> Column:
    """Indices of an array's items in the order in which they are sorted."""
    return F.transform(F.sort_array(F.transform(items, lambda x, i: F.struct(x.alias("x"), (-i if reverse else i).alias("i"))), asc=not reverse), lambda s: F.abs(s["i"]))


def unique(items: Column) -> Column:
    """An array with each item once, in order."""
    return F.array_distinct(items)


def intersects(a: Column, b: Column) -> Column:
    return F.arrays_overlap(a, b)


def product(items: Column, repeat: int = 2) -> Column:
    """All sequences of ``repeat`` items of an array, with replacement, in order."""
    out = F.transform(items, lambda x: F.array(x))
    for _ in range(repeat - 1):
        out = F.flatten(F.transform(out, lambda p: F.transform(items, lambda x: F.concat(p, F.array(x)))))
    return out


def combinations(items: Column, n: int) -> Column:
    """All sequences of n items of an array, any of them again and again, in order; one empty sequence if n is 0."""
    return product(items, n) if n else F.array(F.slice(items, 1, 0))


def variations(items: Column, optional: Callable[[Column], Column]) -> Column:
    """All sequences that are left if any of the optional items are taken out; longest first, then in order."""
    start = F.array(F.slice(items, 1, 0))
    step = lambda acc, x: F.concat(F.transform(acc, lambda p: F.concat(p, F.array(x))), F.filter(acc, lambda _: optional(x)))
    every = F.array_distinct(F.aggregate(items, start, step))
    ranked = F.array_sort(F.transform(every, lambda p, i: F.struct((-F.size(p)).alias("n"), i.alias("i"), p.alias("p"))))
    return F.transform(ranked, lambda s: s["p"])


def softmax(values: Column) -> Column:
    """An array's exponentials as shares of their sum; the largest is taken off first, so that none overflows."""
    e = F.transform(values, lambda x: F.exp(x - F.array_max(values)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sigmoid_slope(y: Column) -> Column:
    """The slope of the sigmoid where it gives y."""
    return y * (1 - y)


def moved(x: Column, y: Column, distance: Column, angle: Column) -> Column:
    """The point at a distance and an angle in degrees."""
    return F.struct((x + distance * F.cos(F.radians(angle))).alias("x"), (y + distance * F.sin(F.radians(angle))).alias("y"))


def suffixes(pairs: DataFrame, base: str, inflected: str, n: int = 3, top: int = 10) -> DataFrame:
    """(suffix, count, base_suffix, share): what the last n letters of inflected forms come from, for the ``top`` most frequent suffixes."""
    x, y = F.col(inflected), F.col(base)
    head = F.expr(f"left(`{inflected}`, greatest(length(`{inflected}`) - {n}, 0))")
    cut = pairs.where(F.startswith(y, head)).select(F.right(x, F.lit(n)).alias("suffix"), F.expr(f"substr(`{base}`, greatest(length(`{inflected}`) - {n}, 0) + 1)").alias("base_suffix"))
    counted = cut.groupBy("suffix", "base_suffix").agg(F.count("*").alias("m"))
    total = counted.groupBy("suffix").agg(F.sum("m").alias("count")).orderBy(F.desc("count"), F.desc("suffix")).limit(top)
    return counted.join(F.broadcast(total), "suffix").select("suffix", "count", "base_suffix", (F.col("m") / F.col("count")).alias("share"))
