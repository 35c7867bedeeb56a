"""Queries of the relational builder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import query as q
from textloom.plans.catalog import query, table

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def database(spark: SparkSession, sf_dir: str) -> q.Database:
    db = q.Database(spark)
    for name, key in KEYS.items():
        db.create(name, table(spark, sf_dir, name), key=key)
    items = table(spark, sf_dir, "lineitem")
    db.create("lineitem", items.withColumn(q.ORDINAL, F.col("l_orderkey") * 100 + F.col("l_linenumber")))
    db.link("customer", "c_nationkey", "nation", "n_nationkey")
    db.link("orders", "o_custkey", "customer", "c_custkey")
    return db


@query("builder_select_filter", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0 AND (c_mktsegment ILIKE 'BUILD%' OR c_nationkey IN (1, 2, 3))")
def select_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = q.all_of(q.lt("c_acctbal", 0), q.any_of(q.eq("c_mktsegment", "BUILD*"), q.eq("c_nationkey", (1, 2, 3))))
    return database(spark, sf_dir).table("customer").search("c_custkey", "c_name", filters=where).df()


@query("builder_not_in_and_ranges", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand NOT IN ('Brand#11', 'Brand#12') AND p_name IS NOT NULL")
def not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = q.all_of(q.rng("p_size", (5, 20)), q.ne("p_brand", ["Brand#11", "Brand#12"]), q.ne("p_name", None))
    return database(spark, sf_dir).table("part").search("p_partkey", "p_size", filters=where).df()


@query("builder_relation_left", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
def relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).table("customer").search("c_custkey", "nation.n_name", filters=q.gt("c_acctbal", 5000)).df()


@query("builder_relation_eliminated", "SELECT c_custkey, c_name FROM customer WHERE c_custkey <= 100")
def eliminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).table("customer").search("c_custkey", "c_name", filters=q.lte("c_custkey", 100)).df()


@query("builder_relation_inner_query", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000")
def inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    relations = [q.Relation("o_custkey", "c_custkey", "customer", q.INNER)]
    return database(spark, sf_dir).table("orders").search("o_orderkey", "customer.c_name", relations=relations, filters=q.gt("o_totalprice", 100000)).df()


@query("builder_relation_full_right", "SELECT r_name, n_name FROM region FULL JOIN nation ON r_regionkey = n_regionkey")
def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).table("region").search("r_name", "nation.n_name", relations=[q.Relation("r_regionkey", "n_regionkey", "nation", q.FULL)]).df()


@query("builder_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    return db.table("customer").search("c_custkey", filters=q.eq("c_custkey", db.table("orders").search("o_custkey", filters=q.gt("o_totalprice", 200000)))).df()


@query("builder_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    return db.table("customer").search("c_custkey", filters=q.ne("c_custkey", db.table("orders").search("o_custkey"))).df()


@query("builder_sort_range", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def sort_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).table("orders").search("o_orderkey", "o_totalprice", sort=["o_totalprice", "o_orderkey"], order=["desc", "asc"], range=(10, 20)).df()


_GROUPED = """
SELECT {key}, count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, coalesce(stddev_samp(o_totalprice), 0) AS spread,
  min(o_totalprice) AS least, max(o_totalprice) AS most, arg_min(o_orderstatus, o_orderkey) AS head, arg_max(o_orderstatus, o_orderkey) AS tail FROM orders GROUP BY {key}
"""


@query("builder_group_functions", _GROUPED.format(key="o_orderpriority"))
def group_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = q.Database(spark)
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    state = F.col("o_orderstatus")
    db.create("orders", o.select("o_orderkey", "o_orderpriority", F.lit(1).alias("n"), *(price.alias(x) for x in ("total", "mean", "spread", "least", "most")), state.alias("head"), state.alias("tail")), key="o_orderkey")
    functions = [q.COUNT, q.SUM, q.AVG, q.STDEV, q.MIN, q.MAX, q.FIRST, q.LAST]
    return db.table("orders").search("o_orderpriority", "n", "total", "mean", "spread", "least", "most", "head", "tail", group="o_orderpriority", function=functions).df()


@query("builder_group_concatenate", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey) AS n_name FROM nation GROUP BY n_regionkey")
def concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).table("nation").search("n_regionkey", "n_name", group="n_regionkey", function=q.CONCATENATE).df()


@query("builder_group_sort", "SELECT c_mktsegment, count(*) AS c_custkey FROM customer GROUP BY c_mktsegment ORDER BY 2 DESC, 1 LIMIT 3")
def group_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).table("customer").search("c_mktsegment", "c_custkey", group="c_mktsegment", function=q.COUNT, sort=[2, 1], order=["desc", "asc"], range=(0, 3)).df()


@query("builder_raw_sql", "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 1000 GROUP BY n_name")
def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return database(spark, sf_dir).execute("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > :least GROUP BY n_name", least=1000)


@query("table_update_delete_insert", """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'built' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey > 10
UNION ALL SELECT max(c_custkey) + 1, 'new' FROM customer""")
def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir)
    t = db.table("customer")
    t.update(q.eq("c_mktsegment", "BUILDING"), c_mktsegment="built")
    t.insert(c_mktsegment="new")
    t.delete(q.lte("c_custkey", 10))
    return t.search("c_custkey", "c_mktsegment").df()
