"""Query builder over named tables: filters, relations, grouping, sorting and slices as one DataFrame plan.

A ``Database`` holds tables and the relations between them.  ``Table.search`` gives a ``Query``; nothing runs before
``Query.df`` is consumed, and Catalyst sees the whole plan.  A relation is joined only if a selected field names its table,
since a left join on a repeated key would otherwise change the rows.  Groups come before sorting.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST, LAST, COUNT, MAX, MIN, SUM, AVG, STDEV, CONCATENATE = "first", "last", "count", "max", "min", "sum", "avg", "stdev", "group_concat"
LEFT, RIGHT, INNER, FULL = "left", "right", "inner", "full"
ORDINAL = "_row"


@dataclass(frozen=True)
class Filter:
    """One comparison: =, i=, !=, <, >, <=, >=, between (:), like or in. Wildcards (*) make = a wildcard match, lists a membership."""

    field: str
    value: Any
    comparison: str = "="


@dataclass(frozen=True)
class Chain:
    """Filters joined by and / or; chains nest."""

    parts: tuple
    operator: str = "and"


def eq(f: str, v: Any) -> Filter:
    return Filter(f, v)


def eqi(f: str, v: Any) -> Filter:
    return Filter(f, v, "i=")


def ne(f: str, v: Any) -> Filter:
    return Filter(f, v, "!=")


def gt(f: str, v: Any) -> Filter:
    return Filter(f, v, ">")


def lt(f: str, v: Any) -> Filter:
    return Filter(f, v, "<")


def gte(f: str, v: Any) -> Filter:
    return Filter(f, v, ">=")


def lte(f: str, v: Any) -> Filter:
    return Filter(f, v, "<=")


def rng(f: str, v: tuple) -> Filter:
    return Filter(f, v, "between")


def _chained(parts: Sequence, named: dict, operator: str) -> Chain:
    return Chain((*parts, *(Filter(k, v) for k, v in named.items())), operator)


def all_of(*parts: Any, **named: Any) -> Chain:
    return _chained(parts, named, "and")


def any_of(*parts: Any, **named: Any) -> Chain:
    return _chained(parts, named, "or")


@dataclass(frozen=True)
class Relation:
    field1: str
    field2: str
    table: str
    join: str = LEFT


def _wild(v: Any) -> bool:
    return isinstance(v, str) and (v.startswith("*") or v.endswith("*"))


def _like(v: str) -> str:
    inner = v.removeprefix("*").removesuffix("*")
    return ("%" if v.startswith("*") else "") + inner + ("%" if v.endswith("*") else "")


def comparison(column: Column, value: Any, how: str = "=") -> Column:
    """The predicate of one comparison. Matches ignore ASCII case, as LIKE does in the usual embedded database."""
    negative = how in ("!=", "<>")
    flip = (lambda c: ~c) if negative else (lambda c: c)
    if how in ("=", "==", "!=", "<>", "i=", "like", "in", "between", ":"):
        if value is None:
            return column.isNotNull() if negative else column.isNull()
        if how in ("between", ":"):
            return column.between(value[0], value[1])
        if isinstance(value, (list, tuple, set, frozenset)):
            values = list(value)
            if any(map(_wild, values)):
                return flip(reduce(lambda a, b: a | b, (comparison(column, v) for v in values)))
            return flip(column.isin(values))
        if how == "like" or (_wild(value) and how != "i="):
            return flip(column.ilike(_like(value) if _wild(value) else value))
        if how == "i=":
            return column.ilike(_like(value)) if _wild(value) else F.lower(column) == str(value).lower()
        return flip(column == value)
    return {"<": column < value, ">": column > value, "<=": column <= value, ">=": column >= value}[how]


@dataclass(frozen=True)
class Query:
    database: Database
    table: str
    fields: tuple = ()
    filters: tuple = ()
    relations: tuple = ()
    sort: Any = None
    order: Any = "asc"
    group: Any = None
    function: Any = FIRST
    range: tuple | None = None
    aliases: dict = field(default_factory=dict)

    def _qualified(self, name: str) -> str:
        return name if "." in name else f"{self.table}.{name}"

    def _column(self, name: str) -> Column:
        table, _, column = self._qualified(name).rpartition(".")
        return F.col(f"`{table}`.`{column}`")

    def _predicate(self, part: Filter | Chain) -> Column:
        if isinstance(part, Chain):
            parts = [self._predicate(p) for p in part.parts]
            if not parts:
                return F.lit(True)
            return reduce((lambda a, b: a & b) if part.operator == "and" else (lambda a, b: a | b), parts)
        return comparison(self._column(part.field), part.value, part.comparison)

    def _joined(self) -> DataFrame:
        db = self.database
        df = db[self.table].alias(self.table)
        selected = {n.split(".")[0] for n in self._names() if "." in n}
        relations = {r.table: r for r in db.relations_of(self.table)} | {r.table: r for r in self.relations}
        for r in relations.values():
            if r.table in selected and r.table != self.table:
                left = F.col(f"`{self.table}`.`{r.field1.rpartition('.')[2]}`")
                df = df.join(db[r.table].alias(r.table), left == F.col(f"`{r.table}`.`{r.field2.rpartition('.')[2]}`"), r.join)
        return df

    def _names(self) -> list[str]:
        return list(self.fields) or [c for c in self.database[self.table].columns if c != ORDINAL]

    def _subqueries(self, df: DataFrame, parts: Sequence) -> tuple[DataFrame, list]:
        """``in`` / ``not in`` another query: semi joins and null-aware anti joins."""
        rest = []
        for p in parts:
            if isinstance(p, Filter) and isinstance(p.value, Query):
                other = p.value.df()
                inner = other.select(F.col(f"`{other.columns[0]}`").alias("_in"))
                column = self._column(p.field)
                if p.comparison in ("!=", "<>"):
                    df = df.join(inner, (column == F.col("_in")) | (column == F.col("_in")).isNull(), "left_anti")
                else:
                    df = df.join(inner, column == F.col("_in"), "left_semi")
            else:
                rest.append(p)
        return df, rest

    def df(self) -> DataFrame:
        names = self._names()
        short = [self.aliases.get(n, n.rpartition(".")[2]) for n in names]
        short = [s if short.count(s) == 1 else self._qualified(n).replace(".", "_") for s, n in zip(short, names, strict=True)]
        df, filters = self._subqueries(self._joined(), self.filters)
        if filters:
            df = df.where(self._predicate(Chain(tuple(filters))))
        if self.group is not None:
            df = self._grouped(df, names, short)
        else:
            df = df.select("*", *(self._column(n).alias(f"_out_{i}") for i, n in enumerate(names)))
            df = self._sorted(df, names, short, grouped=False)
            df = df.select(*(F.col(f"_out_{i}").alias(s) for i, s in enumerate(short)))
        return df

    def _grouped(self, df: DataFrame, names: list[str], short: list[str]) -> DataFrame:
        keys = [self.group] if isinstance(self.group, str) else list(self.group)
        qualified = [self._qualified(k) for k in keys]
        others = [n for n in names if self._qualified(n) not in qualified]
        functions = [self.function] * len(others) if isinstance(self.function, str) else [*self.function, *[FIRST] * len(others)][: len(others)]
        row = self._column(ORDINAL) if ORDINAL in self.database[self.table].columns else F.monotonically_increasing_id()
        out = [aggregate(f, self._column(n), row).alias(f"_out_{names.index(n)}") for n, f in zip(others, functions, strict=True)]
        df = df.groupBy(*(self._column(k).alias(f"_key_{i}") for i, k in enumerate(keys))).agg(F.min(row).alias("_first"), *out)
        df = df.withColumns({f"_out_{i}": F.col(f"_key_{qualified.index(self._qualified(n))}") for i, n in enumerate(names) if self._qualified(n) in qualified})
        df = self._sorted(df, names, short, grouped=True)
        return df.select(*(F.col(f"_out_{i}").alias(s) for i, s in enumerate(short)))

    def _sorted(self, df: DataFrame, names: list[str], short: list[str], grouped: bool) -> DataFrame:
        if self.sort is not None:
            sorts = list(self.sort) if isinstance(self.sort, (list, tuple)) else [self.sort]
            orders = list(self.order) if isinstance(self.order, (list, tuple)) else [self.order] * len(sorts)
            columns = []
            for s, o in zip(sorts, orders, strict=True):
                if isinstance(s, int):
                    c = F.col(f"_out_{s - 1}")
                elif s in names or s in short:
                    c = F.col(f"_out_{names.index(s) if s in names else short.index(s)}")
                else:
                    c = self._column(s)
                columns.append(c.desc() if o == "desc" else c.asc())
            df = df.orderBy(*columns)
        if self.range is not None:
            start, count = self.range
            if self.sort is None:
                df = df.orderBy("_first" if grouped else self._column(ORDINAL)) if grouped or ORDINAL in self.database[self.table].columns else df
            df = df.offset(start).limit(count)
        return df

    def __len__(self) -> int:
        return self.df().count()

    def rows(self) -> list[tuple]:
        return [tuple(r) for r in self.df().collect()]

    def records(self):
        """Rows as dicts, one at a time."""
        return (r.asDict() for r in self.df().toLocalIterator())

    def __getitem__(self, i: int) -> tuple:
        return tuple(self.df().offset(i).limit(1).collect()[0])


def aggregate(function: str | Callable[[Column], Column], c: Column, row: Column) -> Column:
    """One group function; first, last and concatenation follow the row ordinal, and a lone deviation is 0."""
    if callable(function):
        return function(c)
    concat = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(row.alias("r"), c.cast("string").alias("v"))))), lambda x: x["v"]), ",")
    return {
        FIRST: F.min_by(c, row), LAST: F.max_by(c, row), COUNT: F.count("*"), MAX: F.max(c), MIN: F.min(c), SUM: F.sum(c), AVG: F.avg(c),
        STDEV: F.coalesce(F.stddev_samp(c), F.lit(0.0)), CONCATENATE: concat,
    }[function]


class Table:
    """A table of a database; edits give a new snapshot, as DataFrames don't change."""

    def __init__(self, database: Database, name: str):
        self.database, self.name = database, name

    @property
    def df(self) -> DataFrame:
        return self.database[self.name]

    @property
    def fields(self) -> list[str]:
        return [c for c in self.df.columns if c != ORDINAL]

    def count(self) -> int:
        return self.df.count()

    def rows(self) -> list[tuple]:
        df = self.df.orderBy(ORDINAL) if ORDINAL in self.df.columns else self.df
        return [tuple(r) for r in df.select(*self.fields).collect()]

    def search(self, *fields: str, **options: Any) -> Query:
        filters = options.pop("filters", ())
        filters = (filters,) if isinstance(filters, (Filter, Chain)) else tuple(filters)
        relations = tuple(options.pop("relations", ()))
        return Query(self.database, self.name, fields=tuple(fields), filters=filters, relations=relations, **options)

    def filter(self, *fields: str, **named: Any) -> list[tuple]:
        return self.search(*fields, filters=all_of(**named)).rows()

    find = filter

    def insert(self, **values: Any) -> int:
        """Append a row; gives its id."""
        df = self.df
        key = self.database.keys.get(self.name)
        values = self.database.defaults.get(self.name, {}) | values
        top = df.agg(*(F.coalesce(F.max(c), F.lit(0)) for c in (ORDINAL, key) if c)).first()
        if key:
            values.setdefault(key, int(top[1]) + 1)
        row = [(int(top[0]) + 1) if f.name == ORDINAL else values.get(f.name) for f in df.schema]
        self.database.tables[self.name] = df.unionAll(df.sparkSession.createDataFrame([row], df.schema))
        return values.get(key) if key else int(top[0]) + 1

    def _where(self, where: Any) -> Column:
        if isinstance(where, (Filter, Chain)):
            return Query(self.database, self.name)._predicate(where)
        return comparison(F.col(self.database.keys[self.name]), where)

    def update(self, where: Any, **values: Any) -> None:
        df = self.df.alias(self.name)
        hit = F.coalesce(self._where(where), F.lit(False))
        kinds = dict(zip(df.columns, df.schema.fields, strict=True))
        self.database.tables[self.name] = df.withColumns({k: F.when(hit, F.lit(v).cast(kinds[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})

    def delete(self, where: Any = None) -> None:
        df = self.df.alias(self.name)
        self.database.tables[self.name] = df.where(~F.coalesce(self._where(where), F.lit(False))) if where is not None else df.limit(0)

    def append_field(self, name: str, kind: str, default: Any = None) -> None:
        self.database.tables[self.name] = self.df.withColumn(name, F.lit(default).cast(kind))

    def rename(self, name: str) -> None:
        db = self.database
        db.tables[name] = db.tables.pop(self.name)
        for d in (db.keys, db.defaults):
            if self.name in d:
                d[name] = d.pop(self.name)
        swap = lambda t: name if t == self.name else t
        db.links = [(swap(a), f, swap(b), g, j) for a, f, b, g, j in db.links]
        self.name = name


class Database:
    """Named DataFrames with links between them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}
        self.keys: dict[str, str] = {}
        self.defaults: dict[str, dict] = {}
        self.links: list[tuple[str, str, str, str, str]] = []

    def create(self, name: str, df: DataFrame | str, key: str | None = None, defaults: dict | None = None, ordinal: str | None = None) -> Table:
        """Register a DataFrame (or, from a DDL string, an empty table). ``ordinal`` names the column that gives row order."""
        df = self.spark.createDataFrame([], df) if isinstance(df, str) else df
        order = ordinal or key
        if ORDINAL not in df.columns:
            df = df.withColumn(ORDINAL, F.col(order).cast("long") if order else F.monotonically_increasing_id())
        self.tables[name] = df
        if key:
            self.keys[name] = key
        self.defaults[name] = defaults or {}
        return Table(self, name)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def table(self, name: str) -> Table:
        return Table(self, name)

    def drop(self, name: str) -> None:
        self.tables.pop(name)

    def link(self, table1: str, field1: str, table2: str, field2: str, join: str = LEFT) -> None:
        self.links.append((table1, field1, table2, field2, join))

    def relations_of(self, name: str) -> list[Relation]:
        """Links from or to a table; the other direction swaps left and right."""
        turned = {LEFT: RIGHT, RIGHT: LEFT}
        out = []
        for a, f, b, g, j in self.links:
            if a == name:
                out.append(Relation(f, g, b, j))
            elif b == name:
                out.append(Relation(g, f, a, turned.get(j, j)))
        return out

    @contextmanager
    def transaction(self) -> Iterator[Database]:
        """All edits inside, or, if an error ends it, none: tables are snapshots, so the ones before are kept."""
        before = dict(self.tables), dict(self.keys), dict(self.defaults), list(self.links)
        try:
            yield self
        except BaseException:
            self.tables, self.keys, self.defaults, self.links = before
            raise

    def commit(self, path: str) -> None:
        """Write every table under a new version of ``path``; readers go by the version that was complete last."""
        version = f"{path}/{uuid.uuid4().hex}"
        for name, df in self.tables.items():
            df.write.parquet(f"{version}/{name}")
        spark = self.spark
        spark.createDataFrame([(version, time.time_ns())], "version string, at long").coalesce(1).write.mode("append").parquet(f"{path}/_versions")

    def rollback(self, path: str) -> None:
        """Back to the tables of the last commit."""
        last = self.spark.read.parquet(f"{path}/_versions").orderBy(F.desc("at")).first()["version"]
        self.tables = {name: self.spark.read.schema(df.schema).parquet(f"{last}/{name}") for name, df in self.tables.items()}

    def execute(self, sql: str, **args: Any) -> DataFrame:
        """SQL over the tables, with named parameters."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)
        return self.spark.sql(sql, args=args or None)

