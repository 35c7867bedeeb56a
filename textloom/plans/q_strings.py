"""Queries of string and date functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import dates, strings
from textloom.plans.catalog import query, table


@query("string_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS distance, 1 - levenshtein(a.n_name, b.n_name) / greatest(length(a.n_name), length(b.n_name)) AS similarity FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_name").alias(x), F.col("n_nationkey").alias(f"k{x}"), "n_regionkey") for x in "ab")
    return a.join(b, "n_regionkey").where("ka < kb").select("a", "b", F.levenshtein("a", "b").alias("distance"), strings.similarity("a", "b").alias("similarity"))


@query("string_dice", """WITH g AS (SELECT n_nationkey AS k, n_name, list_distinct([n_name[i:i+1] FOR i IN range(1, length(n_name))]) AS g, n_regionkey AS r FROM nation)
SELECT a.n_name AS a, b.n_name AS b, 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS dice FROM g a JOIN g b ON a.r = b.r AND a.k < b.k""")
def dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = (n.select(F.col("n_name").alias(x), F.col("n_nationkey").alias(f"k{x}"), "n_regionkey") for x in "ab")
    return a.join(b, "n_regionkey").where("ka < kb").select("a", "b", strings.dice("a", "b").alias("dice"))


@query("string_word_ngrams", """WITH w AS (SELECT item_id, list_filter(regexp_split_to_array(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM benchmark), g AS (SELECT unnest([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]) AS gram FROM w)
SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 1""")
def word_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda w: w != "")
    grams = table(spark, sf_dir, "benchmark").select(F.explode(strings.ngrams(words, 3)).alias("g"))
    return grams.groupBy(F.array_join("g", " ").alias("gram")).agg(F.count("*").alias("n")).where("n > 1")


@query("string_character_ngrams", "WITH g AS (SELECT unnest([n_name[i:i+2] FOR i IN range(1, length(n_name) - 1)]) AS gram FROM nation) SELECT gram, count(*) AS n FROM g GROUP BY 1")
def character_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.explode(strings.character_ngrams("n_name", 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


_WORDS = r"list_filter(list_transform(regexp_split_to_array(trim(regexp_replace({c}, '[\t\n\x0b\f\r ]+', ' ', 'g')), ' '), lambda x: regexp_replace(x, '^[.,;:!?()\[\]{{}}`''\"@#$^&*+\-|=~_]+|[.,;:!?()\[\]{{}}`''\"@#$^&*+\-|=~_]+$', '', 'g')), lambda x: x <> '')"


@query("string_type_token_ratio", f"""WITH w AS (SELECT item_id, {_WORDS.format(c='lower(text)')} AS w FROM benchmark), s AS (SELECT item_id, unnest([len(list_distinct(w[i:i+19])) / greatest(least(len(w), 20), 1) FOR i IN range(1, greatest(len(w) - 20 + 1, 1) + 1)]) AS share FROM w)
SELECT item_id, avg(share) AS ratio FROM s GROUP BY 1""")
def ttr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", strings.type_token_ratio("text", 20).alias("ratio"))


@query("string_readability", r"""WITH w AS (SELECT item_id, text, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, length(text) AS c, len(w) AS n, len(list_filter(w, lambda x: len(regexp_extract_all(regexp_replace(lower(regexp_replace(x, '^[.,;:!?()\[\]{}`''"@#$^&*+\-|=~_]+|[.,;:!?()\[\]{}`''"@#$^&*+\-|=~_]+$', '', 'g')), 'e$', ''), '[aeiouy]+')) <= 1)) AS mono,
greatest(len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda x: length(trim(x)) > 2)), 1) AS sentences FROM w)
SELECT item_id, CASE WHEN c < 3 OR n <= 1 THEN 1.0 ELSE greatest(0.0, least(1.0, 0.01::DOUBLE * (159.9::DOUBLE * mono / n - 1.015::DOUBLE * n / sentences - 31.517::DOUBLE))) END AS readability FROM s""")
def readability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", strings.readability("text").alias("readability"))


@query("string_deflood", r"SELECT p_partkey, substr(p_name, 1, 1) || 'ZZ!!' || p_size AS calm FROM part")
def deflood(spark: SparkSession, sf_dir: str) -> DataFrame:
    loud = F.concat(F.substring("p_name", 1, 1), F.lit("ZZZZZ!!!!"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", strings.deflood(loud, 2).alias("calm"))


@query("string_collapse", r"SELECT doc_id, md5(list_aggregate(list_transform(string_split(text, chr(10)), lambda s: trim(regexp_replace(s, '[ \x{00a0}]+', ' ', 'g'))), 'string_agg', chr(10))) AS hash FROM documents")
def collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(strings.collapse_spaces("text")).alias("hash"))


@query("string_find_urls_emails", r"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?:https?://|www\.)[^\s<>"''\])]+'), lambda u: regexp_replace(u, '[.,;:!?]+$', '')))), ' ') AS urls, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))), ' ') AS emails FROM documents""")
def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(strings.urls("text")), " ").alias("urls"), F.array_join(F.array_sort(strings.emails("text")), " ").alias("emails"))


@query("string_between", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def find_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.get(strings.between("<title>", "</title>", "html"), F.lit(0)), F.lit("")).alias("title"))


@query("string_entities", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS hash FROM pages")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(strings.encode_entities("html")).alias("hash"))


@query("string_split_document", r"WITH w AS (SELECT unnest(regexp_split_to_array(replace(lower(replace(text, '-' || chr(10), '')), chr(10), ' '), '[.,!?;: ]')) AS word FROM benchmark) SELECT trim(word) AS word, count(*) AS n FROM w WHERE length(trim(word)) >= 4 AND trim(word) NOT IN ('that', 'with') GROUP BY 1")
def split_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(strings.split_document("text", least=4, stopwords=["that", "with"])).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


@query("string_encrypt_round_trip", "SELECT n_nationkey, n_name FROM nation")
def encrypt(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").withColumn("secret", strings.encrypt("n_name", "key"))
    return n.select("n_nationkey", strings.decrypt("secret", "key").alias("n_name"))


@query("date_parts", "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, CAST(day(o_orderdate) AS INTEGER) AS day, CAST(week(o_orderdate) AS INTEGER) AS week, CAST(isodow(o_orderdate) AS INTEGER) AS weekday, CAST(epoch(o_orderdate) AS BIGINT) AS timestamp FROM orders")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = dates.parts("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", *(p[k].alias(k) for k in ("year", "month", "day", "week", "weekday", "timestamp")))


@query("date_parse_formats", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d1, CAST(o_orderdate AS DATE) AS d2, CAST(o_orderdate AS DATE) AS d3, CAST(o_orderdate AS DATE) AS d4 FROM orders")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate")
    made = (F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "dd MMM yyyy"), F.date_format(day, "MMMM dd, yyyy"), F.concat(F.expr("extract(YEAROFWEEK FROM o_orderdate)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"), F.lit("-"), (F.weekday(day) + 1).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", *(dates.parse(m).cast("date").alias(f"d{i}") for i, m in enumerate(made, 1)))


@query("date_arithmetic", "SELECT l_orderkey, l_linenumber, CAST(l_shipdate + INTERVAL 14 MONTH + INTERVAL 3 DAY AS TIMESTAMP) AS later, date_diff('day', o_orderdate, l_shipdate) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def date_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return df.select("l_orderkey", "l_linenumber", dates.add("l_shipdate", years=1, months=2, days=3).alias("later"), dates.difference("l_shipdate", "o_orderdate")["days"].alias("days"))
