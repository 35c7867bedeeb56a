"""Queries of lists, codes, models, trees and sheets."""

from __future__ import annotations

import html
import html.entities

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import dates, lists, secrets, strings
from textloom.operators import graph, models, query as db, semantics, vector
from textloom.plans.catalog import query, table
from textloom.plans.q_vector import _L, _T, _labelled, _tokens
from textloom.sources import files
from textloom.sources import pages as sources
from textloom.streaming import stateful


@query("list_chunks", "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS chunk FROM orders")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.chunks(table(spark, sf_dir, "orders").select("o_orderkey"), 7, "o_orderkey")


@query("list_ordinals", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS ordinal FROM lineitem")
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.ordinals(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), "l_shipdate", "l_orderkey", "l_linenumber").drop("l_shipdate")


@query("list_mixed", """WITH c AS (SELECT 'c' || c_custkey AS name, c_custkey AS k, ntile(5) OVER (ORDER BY c_custkey) AS n, 0 AS f FROM customer UNION ALL SELECT 's' || s_suppkey, s_suppkey, ntile(5) OVER (ORDER BY s_suppkey), 1 FROM supplier)
SELECT name, row_number() OVER (ORDER BY n, f, k) - 1 AS ordinal FROM c""")
def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("c_custkey").cast("long").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.col("s_suppkey").cast("long").alias("k"))
    return lists.mixed([c, s], 5, "k").select("name", "ordinal")


@query("list_binned", "SELECT o_orderpriority AS key, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lists.binned(table(spark, sf_dir, "orders").withColumn("k", F.col("o_orderkey").cast("string")), "o_orderpriority", "k", "o_orderkey")
    return b.select("key", F.array_join("values", ",").alias("keys"))


@query("list_order", "SELECT l_orderkey, array_to_string(list_transform(list_grade_up(list(l_extendedprice ORDER BY l_linenumber, l_extendedprice)), lambda x: x - 1), ',') AS indices FROM lineitem GROUP BY 1")
def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_extendedprice"))).alias("x"))
    return items.select("l_orderkey", F.array_join(F.transform(lists.order(F.col("x.l_extendedprice")), lambda i: i.cast("string")), ",").alias("indices"))


@query("list_shuffled", "SELECT count(*) AS n, count(*) AS different, 0 AS low, count(*) - 1 AS high FROM orders")
def shuffled(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lists.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7)
    return s.agg(F.count("*").alias("n"), F.countDistinct("ordinal").alias("different"), F.min("ordinal").cast("int").alias("low"), F.max("ordinal").alias("high"))


@query("list_first_match", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 ORDER BY o_orderdate, o_orderkey LIMIT 1")
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lists.first_match(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 300000, "o_orderdate", "o_orderkey").select("o_orderkey", "o_totalprice")


@query("list_unique", "WITH w AS (SELECT l_orderkey AS k, l_returnflag AS m, min(l_linenumber) AS i FROM lineitem GROUP BY 1, 2) SELECT k AS l_orderkey, string_agg(m, ',' ORDER BY i, m) AS flags FROM w GROUP BY 1")
def unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    modes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    return modes.select("l_orderkey", F.array_join(lists.unique(F.col("x.l_returnflag")), ",").alias("flags"))


@query("list_product", "SELECT a.l_orderkey, a.l_linenumber AS x, b.l_linenumber AS y FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey")
def product(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("x"))  # few lines an order
    return items.select("l_orderkey", F.explode(lists.product(F.col("x"))).alias("p")).select("l_orderkey", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("list_variations", "SELECT n_name, unnest(['A? ' || n_name || ' ' || n_regionkey || '?', 'A? ' || n_name, n_name || ' ' || n_regionkey || '?', n_name]) AS variation FROM nation")
def variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.array(F.lit("A?"), F.col("n_name"), F.concat(F.col("n_regionkey").cast("string"), F.lit("?")))
    return table(spark, sf_dir, "nation").select("n_name", F.explode(lists.variations(items, lambda x: x.endswith("?"))).alias("v")).select("n_name", F.array_join("v", " ").alias("variation"))


@query("list_softmax", "WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT *, exp(CAST(x AS DOUBLE) - max(CAST(x AS DOUBLE)) OVER (PARTITION BY vec_id)) AS e FROM e) SELECT vec_id, round(max(e) / sum(e), 9) AS largest, round(min(e) / sum(e), 9) AS least FROM m GROUP BY 1")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "embeddings").select("vec_id", lists.softmax(F.col("embedding").cast("array<double>")).alias("s"))
    return s.select("vec_id", F.round(F.array_max("s"), 9).alias("largest"), F.round(F.array_min("s"), 9).alias("least"))


@query("list_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 9) AS y, round(1 / (1 + exp(-value / 100)) * (1 - 1 / (1 + exp(-value / 100))), 9) AS slope FROM events")
def sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = lists.sigmoid(F.col("value") / 100)
    return table(spark, sf_dir, "events").select("event_id", F.round(y, 9).alias("y"), F.round(lists.sigmoid_slope(y), 9).alias("slope"))


@query("list_coordinates", "SELECT p_partkey, round(1 + p_size * cos(radians(p_retailprice)), 6) AS x, round(2 + p_size * sin(radians(p_retailprice)), 6) AS y FROM part")
def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lists.moved(F.lit(1.0), F.lit(2.0), F.col("p_size"), F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", at.alias("p")).select("p_partkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query("metrics_suffixes", """WITH p AS (SELECT DISTINCT p_type AS y, p_type || CASE WHEN p_size % 2 = 0 THEN 'S' ELSE 'ED' END AS x FROM part), c AS (SELECT right(x, 3) AS suffix, substr(y, length(x) - 2) AS base_suffix, count(*) AS m FROM p WHERE starts_with(y, left(x, length(x) - 3)) GROUP BY 1, 2),
t AS (SELECT suffix, CAST(sum(m) AS BIGINT) AS count FROM c GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 10) SELECT suffix, count, base_suffix, m / count AS share FROM c JOIN t USING (suffix)""")
def suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("base"), F.concat("p_type", F.when(F.col("p_size") % 2 == 0, "S").otherwise("ED")).alias("inflected")).distinct()
    return lists.suffixes(p, "base", "inflected")


@query("string_template", "SELECT c_custkey, 'Dear ' || c_name || ', $' || CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) || ' is due to ' || upper(c_mktsegment) || '.' AS letter FROM customer")
def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", secrets.template("Dear $c_name, $$${floor(c_acctbal)} is due to ${upper(c_mktsegment)}.").alias("letter"))


@query("locale_codes", """WITH x(code, name, regions) AS (VALUES ('en', 'English', 'en,en-CA,en-GB,en-IN,en-US'), ('de', 'German', 'de,de-DE'), ('fr', 'French', 'fr,fr-CA,fr-FR'), ('es', 'Spanish', 'es,es-ES'))
SELECT doc_id, name AS language, code, regions FROM documents JOIN x ON lang = code""")
def locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where(F.col("lang").isin("en", "de", "fr", "es")).withColumn("language", secrets.language_name(F.col("lang")))
    return d.select("doc_id", "language", secrets.language_code(F.col("language")).alias("code"), F.array_join(secrets.regionalized(F.col("lang")), ",").alias("regions"))


@query("locale_regions", "WITH x(nation, code, languages) AS (VALUES ('FRANCE', 'FR', 'fr'), ('GERMANY', 'DE', 'de'), ('CANADA', 'CA', 'en,fr'), ('CHINA', 'CN', 'zh'), ('UNITED STATES', 'US', 'en'), ('JAPAN', 'JP', 'ja'), ('EGYPT', 'EG', 'ar'), ('BRAZIL', 'BR', 'pt'), ('INDIA', 'IN', 'en'), ('RUSSIA', 'RU', 'ru'), ('UNITED KINGDOM', 'GB', 'en'), ('SAUDI ARABIA', 'SA', 'ar')) SELECT n_name, code, languages FROM nation LEFT JOIN x ON n_name = nation")
def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("code", secrets.region_code(F.col("n_name")))
    return n.select("n_name", "code", F.array_join(secrets.languages_of(F.col("code")), ",").alias("languages"))


@query("classify_distribution", "SELECT 'q' || quality AS label, count(*) AS n FROM labels GROUP BY 1")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.distribution(_labelled(spark, sf_dir)[1])


@query("classify_baselines", """WITH d AS (SELECT 'q' || quality AS label, count(*) AS n, row_number() OVER (ORDER BY 'q' || quality) - 1 AS k FROM labels GROUP BY 1), t AS (SELECT sum(n) AS t, sum(n * k) / sum(n) AS m FROM d)
SELECT max_by(label, n) AS majority, min_by(label, n) AS minority, max(n) / any_value(t) AS baseline, sum((n / t) * (n / t)) AS weighted_random_baseline, round((sum((k - m) ** 3 * n) / any_value(t)) / (sum((k - m) ** 2 * n) / any_value(t)) ** 1.5, 9) AS skewness FROM d, t""")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.baselines(_labelled(spark, sf_dir)[1]).withColumn("skewness", F.round("skewness", 9))


@query("vector_corpus_edits", f"""WITH {_L}, n AS (SELECT item_id AS doc_id, term, count(*) AS n FROM (SELECT item_id, unnest({_T}) AS term FROM benchmark) GROUP BY 1, 2)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT * FROM p WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT * FROM n) WHERE doc_id NOT IN (SELECT n_nationkey FROM nation) GROUP BY 1""")
def corpus_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = vector.postings(table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), tokens=_tokens())
    c = models.Corpus(_labelled(spark, sf_dir)[0]).append(more).remove(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id")))
    return c.postings.groupBy("doc_id").agg(F.sum("n").alias("n"))


@query("vector_terms", f"WITH {_L} SELECT term, row_number() OVER (ORDER BY term) - 1 AS at FROM (SELECT DISTINCT term FROM p)")
def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.Corpus(_labelled(spark, sf_dir)[0]).terms()


_W = f"p AS (SELECT doc_id, term, count(*) AS n FROM (SELECT item_id AS doc_id, unnest({_T}) AS term FROM benchmark) GROUP BY 1, 2), w AS (SELECT doc_id, term, n * 0.25 AS w FROM p), t AS (SELECT DISTINCT term FROM p)"


def _weights(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    return vector.postings(b, tokens=_tokens()).select("doc_id", "term", (F.col("n") * 0.25).alias("w")), b.select("doc_id", F.concat(F.lit("c"), F.col("doc_id") % 3).alias("label"))


@query("vector_export_tab", f"WITH {_W} SELECT d.doc_id, string_agg(CASE WHEN w IS NULL THEN '0' ELSE format('{{:.4f}}', w) END, chr(9) ORDER BY term) || chr(9) || d.doc_id || chr(9) || 'c' || (d.doc_id % 3) AS line FROM (SELECT DISTINCT doc_id FROM p) d CROSS JOIN t LEFT JOIN w USING (doc_id, term) GROUP BY 1")
def export_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.orange_tab(*_weights(spark, sf_dir))[1]


@query("vector_export_arff", f"WITH {_W} SELECT d.doc_id, string_agg(CASE WHEN w IS NULL THEN '0' ELSE format('{{:.4f}}', w) END, ',' ORDER BY term) || ',c' || (d.doc_id % 3) AS line FROM (SELECT DISTINCT doc_id FROM p) d CROSS JOIN t LEFT JOIN w USING (doc_id, term) GROUP BY 1")
def export_arff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.arff(*_weights(spark, sf_dir), "benchmark")[1]


@query("graph_depth_first", "WITH n AS (SELECT 'w' AS node, '' AS path UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey FROM region UNION ALL SELECT 'n' || printf('%03d', n_nationkey), 'r' || n_regionkey || '/' || printf('%03d', n_nationkey) FROM nation) SELECT 'w' AS root, node, row_number() OVER (ORDER BY path) - 1 AS visited FROM n")
def depth_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.lit("w").alias("src"), F.concat(F.lit("r"), "r_regionkey").alias("dst"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("src"), F.format_string("n%03d", "n_nationkey").alias("dst"))
    return graph.depth_first(r.unionAll(n), spark.createDataFrame([("w",)], "id string"))


@query("graph_ranked", "SELECT c_nationkey AS id, count(*) AS weight FROM customer GROUP BY 1 HAVING count(*) >= 55")
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.ranked(table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count("*").alias("weight")), "weight", 55)


@query("semantics_taxonomy", "SELECT 'n' || n_nationkey AS descendant, CAST(2 AS INTEGER) AS distance FROM nation UNION ALL SELECT 'r' || r_regionkey, 1 FROM region")
def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = lambda df, a, b: df.select(a.alias("src"), F.lit(semantics.IS_A).alias("relation"), b.alias("dst"), F.lit("").alias("context"), F.lit(1.0).alias("weight"))
    r = edge(table(spark, sf_dir, "region"), F.concat(F.lit("r"), "r_regionkey"), F.lit("world"))
    n = edge(table(spark, sf_dir, "nation"), F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"))
    return semantics.taxonomy(r.unionAll(n), "world").select("descendant", F.col("distance").cast("int").alias("distance"))


@query("semantics_synset_similarity", """WITH c AS (SELECT n_nationkey AS n, n_regionkey AS r, count(c_custkey) AS k FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2), t AS (SELECT sum(k) AS t FROM c), g AS (SELECT r, sum(k) AS k FROM c GROUP BY 1)
SELECT 'n' || a.n AS a, 'n' || b.n AS b, round(CASE WHEN a.n = b.n THEN 1 WHEN a.r = b.r THEN 2 * -ln(g.k / t) / (-ln(a.k / t) - ln(b.k / t)) ELSE 0 END, 9) AS similarity FROM c a, c b, g, t WHERE g.r = a.r""")
def synset_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = F.concat(F.lit("n"), "n_nationkey")
    counts = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(name.alias("id")).agg(F.count("c_custkey").alias("n"))
    region = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(0).cast("long").alias("n"))
    above = n.select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), name.alias("child")).unionAll(region.select(F.lit("world").alias("parent"), F.col("id").alias("child")))
    every = counts.unionAll(region).unionAll(spark.createDataFrame([("world", 0)], "id string, n long"))
    pairs = counts.select(F.col("id").alias("a")).crossJoin(counts.select(F.col("id").alias("b")))  # 25 nations
    return semantics.synset_similarity(every, above, pairs).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query("string_tags", "SELECT doc_id, '#' || source AS tags, '@' || lang AS mentions, 'RT' AS kind FROM documents")
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("t", F.concat(F.lit("say #"), "source", F.lit(" to @"), "lang", F.lit(" a#b c@d")))
    return d.select("doc_id", F.array_join(strings.hashtags("t"), ",").alias("tags"), F.array_join(strings.mentions("t"), ",").alias("mentions"), F.when(F.size(strings.retweets(F.concat(F.lit("RT "), F.col("lang"), F.lit(" RT @"), F.col("lang")))) == 1, "RT").alias("kind"))


@query("string_base62", "WITH d AS (SELECT o_orderkey AS k, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz' AS s FROM orders) SELECT k AS o_orderkey, ltrim(s[k // 14776336 % 62 + 1] || s[k // 238328 % 62 + 1] || s[k // 3844 % 62 + 1] || s[k // 62 % 62 + 1] || s[k % 62 + 1], '0') AS short FROM d WHERE k > 0 UNION ALL SELECT k, '0' FROM d WHERE k = 0")
def base62(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", strings.base62("o_orderkey").alias("short"))


@query("string_cast", "SELECT event_id, event_type = 'view' AS seen, CAST(round(value) AS BIGINT) AS whole FROM events")
def cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", strings.boolean(F.when(F.col("event_type") == "view", "True").otherwise("0")).alias("seen"), strings.integer(F.col("value")).cast("long").alias("whole"))


@query("date_formatted", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS written FROM orders")
def formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.formatted(F.col("o_orderdate"), "yyyy/MM/dd").alias("written"))


@query("sheet_edits", """WITH s AS (SELECT CAST(r_regionkey AS BIGINT) AS r, r_name AS a FROM region UNION ALL SELECT 5 + n_nationkey, n_name FROM nation), i AS (SELECT CASE WHEN r >= 2 THEN r + 1 ELSE r END AS r, a FROM s UNION ALL SELECT 2, 'NEW'),
d AS (SELECT CASE WHEN r > 4 THEN r - 1 ELSE r END AS r, a FROM i WHERE r <> 4), w AS (SELECT CASE r WHEN 0 THEN 3 WHEN 3 THEN 0 ELSE r END AS r, a FROM d) SELECT r AS _row, lower(a) AS a FROM w""")
def sheet_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = files.Sheet(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("_row"), F.col("r_name").alias("a")))
    n = files.Sheet(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("_row"), F.col("n_name").alias("a")))
    return r.extend(n).insert_row(2, ["NEW"]).remove_row(4).swap_rows(0, 3).map(F.lower).df


@query("sheet_slice_sort", "SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS _row, s_name, s_acctbal FROM supplier WHERE s_suppkey BETWEEN 5 AND 54")
def sheet_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = files.Sheet(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("_row"), "s_name", "s_acctbal", "s_nationkey"))
    return s.slice(5, 0, 50, 2).sort("s_acctbal", reverse=True).df


@query("stream_packets", "WITH l AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS t FROM conversations GROUP BY 1), s AS (SELECT conv_id, regexp_split_to_array(t, '\\. ') AS p FROM l) SELECT conv_id, CAST(i - 1 AS INTEGER) AS n, p[i] AS packet FROM (SELECT conv_id, p, unnest(generate_series(1, len(p) - 1)) AS i FROM s)")
def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("t", F.coalesce("text", F.lit("")))
    return stateful.packets(c, "conv_id", "t", "turn", ". ")


@query("stream_messages", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'x' || event_type WHEN event_id % 3 = 1 THEN 'f' || event_type ELSE 't' || event_type END AS message FROM events")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    say = lambda p: F.concat(F.lit(p), "event_type")
    k = F.col("event_id") % 3
    json = F.when(k == 0, F.to_json(F.struct(F.struct(say("x").alias("full_text")).alias("extended_tweet"), say("t").alias("text")))).when(k == 1, F.to_json(F.struct(say("f").alias("full_text"), say("t").alias("text")))).otherwise(F.to_json(F.struct(say("t").alias("text"))))
    return table(spark, sf_dir, "events").select("event_id", json.alias("j")).select("event_id", stateful.messages("j").alias("message"))


@query("db_transaction", "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 3 THEN 'kept' ELSE n_name END AS name FROM nation")
def transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = db.Database(spark)
    t = d.create("nations", table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name")), key="id")
    with d.transaction():
        t.update(db.lt("id", 3), name="kept")
    try:
        with d.transaction():
            t.delete(db.lt("id", 20))
            raise ValueError("broken off")
    except ValueError:
        pass
    return t.df.select("id", "name")


def _shared(spark: SparkSession, name: str) -> str:
    """A new path in the session's shared folder."""
    import uuid

    from textloom.functions.lineage import shared_dir

    return f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"


@query("web_page_cache", "SELECT url, CASE WHEN max(page_id) % 4 = 3 THEN NULL ELSE length(max_by(html, page_id)) END AS n FROM pages GROUP BY 1")
def page_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    last = p.groupBy("url").agg(F.max("page_id").alias("page_id"))
    at = F.when(F.col("page_id") % 4 == 3, F.lit("2020-01-01")).otherwise("2024-01-01").cast("timestamp")
    rows = p.join(last, ["url", "page_id"]).select("url", F.lit(200).alias("status"), F.lit("text/html; charset=utf-8").alias("type"), F.lit(None).cast("string").alias("location"), "html", at.alias("fetched_at"))
    cache = sources.PageCache(spark, _shared(spark, "cache"))
    cache.put(rows)
    return cache.get(p, F.lit("2023-01-01").cast("timestamp")).select("url", F.char_length("html").alias("n"))


@query("web_probes", "SELECT event_id, event_id % 5 < 2 AS found, CASE WHEN event_id % 2 = 0 THEN 'text/html' END AS type, CASE WHEN event_id % 3 = 0 THEN 'b' END AS leads FROM events")
def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.when(k % 5 < 2, 301).when(k % 5 == 2, 404).alias("status"), F.when(k % 2 == 0, "Text/HTML; charset=x").otherwise("").alias("header"), F.lit("a").alias("url"), F.when(k % 3 == 0, "b").when(k % 3 == 1, "a").alias("location"))
    return e.select("event_id", sources.exists(F.col("status")).alias("found"), sources.mime_type(F.col("header")).alias("type"), sources.redirect(F.col("url"), F.col("location")).alias("leads"))


def _map(entries: dict[str, str]) -> str:
    return "MAP {" + ", ".join("'{}': '{}'".format(k, v.replace("'", "''")) for k, v in entries.items()) + "}"


#: What stands after an & as text: the longest reference that it begins with, a known name or a number, is decoded once.
_REFERENCE = r"""CASE WHEN regexp_matches(x, '^#([0-9]|[xX][0-9a-fA-F])') THEN
  (SELECT CASE WHEN a[m] IS NOT NULL THEN a[m] WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 OR n IS NULL THEN chr(65533) WHEN n BETWEEN 1 AND 8 OR n BETWEEN 14 AND 31 OR n BETWEEN 127 AND 159 OR n = 11 OR n BETWEEN 64976 AND 65007 OR n & 65534 = 65534 THEN '' ELSE chr(CAST(n AS INTEGER)) END
   FROM (SELECT TRY_CAST(CASE WHEN lower(x[2]) = 'x' THEN '0x' || regexp_extract(x, '^#[xX]([0-9a-fA-F]+)', 1) ELSE regexp_extract(x, '^#([0-9]+)', 1) END AS BIGINT) AS n, CAST(n AS VARCHAR) AS m)) || regexp_replace(x, '^#([xX][0-9a-fA-F]+|[0-9]+);?', '')
  ELSE coalesce((SELECT e[left(x, k)] || substr(x, k + 1) FROM (SELECT unnest(range(length(regexp_extract(x, '^[^\t\n\f <&#;]{1,32};?')), 1, -1)) AS k) WHERE e[left(x, k)] IS NOT NULL ORDER BY k DESC LIMIT 1), '&' || x) END"""
_HEADINGS = "|".join(rf"<h{n}\b[^>]*>.*?</h{n}\s*>" for n in range(1, 7))


@query("web_sections", rf"""WITH r AS MATERIALIZED (SELECT {_map(html.entities.html5)} AS e, {_map({str(k): v for k, v in html._invalid_charrefs.items() if k})} AS a),
h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is){_HEADINGS}')) AS heading FROM pages),
t AS (SELECT row_number() OVER () AS i, page_id, CAST(heading[3] AS INTEGER) AS level, string_split(regexp_replace(regexp_extract(heading, '(?is)^<h[1-6]\b[^>]*>(.*)</h[1-6]\s*>$', 1), '</?[A-Za-z][^>]*>', '', 'g'), '&') AS parts FROM h),
p AS (SELECT i, unnest(parts[2:]) AS x, unnest(range(2, len(parts) + 1)) AS place FROM t WHERE len(parts) > 1), d AS (SELECT i, string_agg({_REFERENCE}, '' ORDER BY place) AS rest FROM p, r GROUP BY 1)
SELECT page_id, level, regexp_replace(regexp_replace(array_to_string(list_transform(regexp_split_to_array(parts[1] || coalesce(rest, ''), '\r\n?|\n'), lambda x: trim(regexp_replace(regexp_replace(x, '\t+', chr(9), 'g'), '[ \x{{a0}}]+', ' ', 'g'), ' ' || chr(9))), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS title FROM t LEFT JOIN d USING (i)""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(sources.sections("html")).alias("s")).select("page_id", "s.level", "s.title")
    return p.where("level > 0")


@query("nlp_wordlist", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({_T}) AS w FROM documents) WHERE w IN ('the', 'und', 'trash', 'idiot') GROUP BY 1")
def wordlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _shared(spark, "words")
    spark.createDataFrame([("# some words",), ("the, UND",), ("trash",), ("idiot",)], "value string").coalesce(1).write.text(path)
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(_tokens()).alias("word"))
    return sources.members(words, sources.wordlist(spark, path)).groupBy("doc_id").agg(F.count("*").alias("n"))
