"""Files: CSV with typed headers, XML, JSON, HTML and text tables, ragged sheets, binary documents."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import strings

#: Fixed names of field types and their Spark types.
TYPES = {"STRING": "string", "INTEGER": "bigint", "FLOAT": "double", "TEXT": "string", "BLOB": "binary", "BOOLEAN": "boolean", "DATE": "timestamp"}
_NAMES = {"string": "STRING", "bigint": "INTEGER", "int": "INTEGER", "double": "FLOAT", "float": "FLOAT", "binary": "BLOB", "boolean": "BOOLEAN", "timestamp": "DATE", "date": "DATE"}


def encode_header(name: str, kind: str = "STRING") -> str:
    return f"{name} ({kind.upper()})"


def decode_header(header: str) -> tuple[str, str]:
    """("age", "INTEGER") of "age (INTEGER)"; without a type it is STRING."""
    m = re.fullmatch(r"(.*?)\s*\(([A-Z]+)(?:\(\d+\))?\)", header.strip())
    return (m[1], m[2]) if m and m[2] in TYPES else (header.strip(), "STRING")


def _typed(c: str, kind: str) -> Column:
    from textloom.functions import dates

    q = F.col(f"`{c}`")
    return {"BOOLEAN": lambda: strings.boolean(q), "INTEGER": lambda: strings.integer(q), "FLOAT": lambda: q.try_cast("double"), "DATE": lambda: dates.parse(q), "BLOB": lambda: F.unbase64(q)}.get(kind, lambda: q)()


def read_csv(spark: SparkSession, path: str, separator: str = ",", headers: bool = False, names: Sequence[str] | None = None, start: int = 0, count: int | None = None, preprocess: Callable[[Column], Column] | None = None) -> DataFrame:
    """CSV with a typed header or all strings; "None" is null. ``start`` and ``count`` cut a slice of rows in file order."""
    df = spark.read.option("sep", separator).option("header", headers).option("nullValue", "None").option("multiLine", True).option("escape", '"').csv(path)
    if preprocess:
        df = df.select(*(preprocess(F.col(f"`{c}`")).alias(c) for c in df.columns))
    if headers:
        fields = [decode_header(c.removeprefix("﻿")) for c in df.columns]
        df = df.select(*(_typed(c, k).alias(n) for c, (n, k) in zip(df.columns, fields, strict=True)))
    elif names:
        df = df.toDF(*names)
    if start or count is not None:
        df = df.offset(start)
        df = df if count is None else df.limit(count)
    return df


def write_csv(df: DataFrame, path: str, separator: str = ",", headers: bool = True) -> None:
    """All values quoted, nulls as None, types in the header."""
    kinds = dict(df.dtypes)
    text = {c: F.when(F.col(c).isNull(), "None").otherwise(F.base64(c) if kinds[c] == "binary" else F.col(c).cast("string")) for c in df.columns}
    named = df.select(*(text[c].alias(encode_header(c, _NAMES.get(kinds[c], "STRING")) if headers else c) for c in df.columns))
    named.write.mode("overwrite").option("quoteAll", True).option("sep", separator).option("escape", '"').option("header", headers).csv(path)


def to_xml_rows(df: DataFrame, table: str = "rows") -> DataFrame:
    """(xml) one <row> element a row: booleans as yes / no, floats to 5 places."""
    kinds = dict(df.dtypes)

    def value(c: str) -> Column:
        if kinds[c] == "boolean":
            return F.when(F.col(c), "yes").otherwise("no")
        v = F.round(c, 5).cast("string") if kinds[c] in ("double", "float") else F.col(c).cast("string")
        return strings.encode_entities(F.coalesce(v, F.lit("")))

    parts = [F.concat(F.lit(f' {c}="'), value(c), F.lit('"')) for c in df.columns]
    return df.select(F.concat(F.lit("<row"), *parts, F.lit("/>")).alias("xml"))


def xml_document(df: DataFrame, table: str = "rows") -> str:
    """A whole XML document of a small result, with its schema."""
    head = "".join(f'<field name="{c}" type="{_NAMES.get(k, "STRING").lower()}"/>' for c, k in df.dtypes)
    rows = "\n".join(r["xml"] for r in to_xml_rows(df, table).toLocalIterator())
    return f'<?xml version="1.0" encoding="utf-8"?>\n<table name="{table}">\n<schema>{head}</schema>\n<rows>\n{rows}\n</rows>\n</table>'


def read_xml(spark: SparkSession, path: str, schema: str, row: str = "row") -> DataFrame:
    """Rows of attributes, named and typed by ``schema``."""
    fields = T._parse_datatype_string(schema).fields
    raw = T.StructType([T.StructField(f"_{f.name}", T.StringType()) for f in fields])
    df = spark.read.format("xml").option("rowTag", row).schema(raw).load(path)
    cast = lambda f: strings.boolean(F.when(F.col(f"_{f.name}") == "yes", "1").otherwise("0")) if isinstance(f.dataType, T.BooleanType) else F.nullif(F.col(f"_{f.name}"), F.lit("")).try_cast(f.dataType)
    return df.select(*(cast(f).alias(f.name) for f in fields))


def to_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def to_html(df: DataFrame) -> DataFrame:
    """(html) a <tr> a row."""
    cells = [F.concat(F.lit("<td>"), strings.encode_entities(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def read_lines(spark: SparkSession, path: str, comment: str = ";;;") -> DataFrame:
    """(value) of a text file, without blank lines and comments."""
    return spark.read.text(path).where(~F.col("value").startswith(comment) & (F.trim("value") != ""))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of text and HTML files; others have a null text."""
    from textloom.operators import web

    files = spark.read.format("binaryFile").load(path)
    content = F.decode("content", "UTF-8")
    name = F.lower("path")
    return files.select("path", F.when(name.rlike(r"\.html?$"), web.plaintext(content)).when(name.rlike(r"\.(txt|md|csv)$"), content).alias("text"))


class Sheet:
    """Rows with an explicit ordinal: positional edits, slices, transposition, ragged unions, grouping in order of appearance."""

    def __init__(self, df: DataFrame, row: str = "_row"):
        if row not in df.columns:
            raise ValueError("a sheet needs a row ordinal; use Sheet.of for local rows")
        self.df, self.row = df, row

    @classmethod
    def of(cls, spark: SparkSession, rows: Sequence[Sequence], names: Sequence[str] | None = None) -> Sheet:
        width = max(map(len, rows), default=0)
        names = list(names or (f"c{i}" for i in range(width)))
        padded = [(i, *r, *[None] * (width - len(r))) for i, r in enumerate(rows)]
        return cls(spark.createDataFrame(padded, ["_row", *names]) if rows else spark.createDataFrame([], ", ".join(["_row long", *(f"{n} string" for n in names)])))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.row]

    def slice(self, i: int, j: int, n: int, m: int) -> Sheet:
        """n rows from i and m columns from j."""
        return Sheet(self.df.where(F.col(self.row).between(i, i + n - 1)).select(self.row, *self.columns[j : j + m]).withColumn(self.row, F.col(self.row) - i))

    def extend(self, other: Sheet) -> Sheet:
        """Rows below, by position; missing cells are null."""
        top = self.df.agg(F.coalesce(F.max(self.row) + 1, F.lit(0)).alias("_top"))
        names = self.columns if len(self.columns) >= len(other.columns) else [*self.columns, *other.columns[len(self.columns) :]]
        renamed = other.df.toDF(*[self.row if c == other.row else names[other.columns.index(c)] for c in other.df.columns]).crossJoin(F.broadcast(top))  # one row
        renamed = renamed.withColumn(self.row, F.col(self.row) + F.col("_top")).drop("_top")
        return Sheet(self.df.unionByName(renamed, allowMissingColumns=True))

    def insert_row(self, i: int, values: Sequence) -> Sheet:
        moved = self.df.withColumn(self.row, F.when(F.col(self.row) >= i, F.col(self.row) + 1).otherwise(F.col(self.row)))
        kinds = dict(self.df.dtypes)
        new = self.df.sparkSession.range(1).select(F.lit(i).cast("long").alias(self.row), *(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(self.columns, [*values, *[None] * len(self.columns)], strict=False)))
        return Sheet(moved.unionByName(new))

    def remove_row(self, i: int) -> Sheet:
        return Sheet(self.df.where(F.col(self.row) != i).withColumn(self.row, F.when(F.col(self.row) > i, F.col(self.row) - 1).otherwise(F.col(self.row))))

    def swap_rows(self, a: int, b: int) -> Sheet:
        return Sheet(self.df.withColumn(self.row, F.when(F.col(self.row) == a, b).when(F.col(self.row) == b, a).otherwise(F.col(self.row)).cast("long")))

    def with_columns(self, order: Sequence[str]) -> Sheet:
        return Sheet(self.df.select(self.row, *order))

    def sort(self, column: str, reverse: bool = False) -> Sheet:
        from pyspark.sql.window import Window

        c = F.col(column)
        w = Window.orderBy(c.desc() if reverse else c.asc(), self.row)
        return Sheet(self.df.withColumn(self.row, (F.row_number().over(w) - 1).cast("long")))

    def map(self, f: Callable[[Column], Column]) -> Sheet:
        return Sheet(self.df.select(self.row, *(f(F.col(c)).alias(c) for c in self.columns)))

    def transpose(self) -> DataFrame:
        """(column, 0, 1, ...): a column a row. For sheets of few rows, as columns can't be many."""
        long = self.df.select(self.row, F.explode(F.create_map(*(x for c in self.columns for x in (F.lit(c), F.col(c).cast("string"))))).alias("column", "value"))
        return long.groupBy("column").pivot(self.row).agg(F.first("value"))

    def group(self, column: str, functions: Sequence[str] | str = "first", key: Callable[[Column], Column] | None = None) -> DataFrame:
        """A row for each key in order of first appearance; one function for all other columns or one each."""
        from textloom.operators.query import aggregate

        others = [c for c in self.columns if c != column]
        functions = [functions] * len(others) if isinstance(functions, str) else list(functions)
        k = (key or (lambda c: c))(F.col(column)).alias(column)
        out = self.df.groupBy(k).agg(F.min(self.row).alias("_first"), *(aggregate(f, F.col(c), F.col(self.row)).alias(c) for c, f in zip(others, functions, strict=True)))
        return out.orderBy("_first").select(*self.columns)
