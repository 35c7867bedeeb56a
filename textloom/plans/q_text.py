"""Queries of natural language, web, sheets and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import inflect, matcher, nlp, stemmer, web
from textloom.plans.catalog import query, table
from textloom.sources import files
from textloom.streaming import stateful

#: A small seed lexicon; real ones are parameters.
LEXICON = {"the": "DT", "a": "DT", "of": "IN", "in": "IN", "and": "CC", "is": "VBZ", "was": "VBD", "are": "VBP", "to": "TO", "with": "IN", "that": "IN", "it": "PRP", "he": "PRP", "she": "PRP", "big": "JJ", "cat": "NN", "cats": "NNS", "sat": "VBD", "mat": "NN", "on": "IN"}


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = nlp.parser(nlp.Tagger(LEXICON), inflect.find_lemma)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), run("text").alias("parsed"))


@query("nlp_parse_tagged_string")
def parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("doc_id", nlp.tagged_string(F.col("parsed")).alias("tagged"))


@query("nlp_universal_tags")
def universal(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _parsed(spark, sf_dir).select(F.explode(F.flatten("parsed")).alias("t"))
    return t.groupBy(nlp.universal(F.col("t.tag")).alias("tag")).agg(F.count("*").alias("n"))


@query("nlp_keywords")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nlp.find_keywords(_parsed(spark, sf_dir), 5)


@query("nlp_expression_search")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = matcher.matches(matcher.Expression("{NP} IN {NP}"))
    return _parsed(spark, sf_dir).select("doc_id", F.explode(run("parsed")).alias("m")).select("doc_id", "m.*")


@query("nlp_sentiment")
def sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = nlp.Sentiment({"idiot": (-0.8, 0.8, 1.0), "stupid": (-0.8, 1.0, 1.0), "pathetic": (-1.0, 1.0, 1.0), "very": (0.2, 0.3, 1.3)}, modifiers=frozenset(["very"]))
    return table(spark, sf_dir, "documents").select("doc_id", s.udf()("text").alias("s")).select("doc_id", "s.*")


@query("nlp_language", """WITH x(language, word) AS (VALUES ('en', 'the'), ('en', 'and'), ('en', 'of'), ('de', 'der'), ('de', 'und'), ('de', 'die'), ('fr', 'les'), ('fr', 'et'), ('fr', 'des'), ('es', 'el'), ('es', 'y'), ('es', 'los')),
w AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda x: x <> ''))) AS word FROM documents), n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1),
h AS (SELECT doc_id, language, count(*) / any_value(n) AS share FROM w JOIN x USING (word) JOIN n USING (doc_id) GROUP BY 1, 2), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, language = 'en' DESC, language DESC) = 1)
SELECT DISTINCT d.doc_id, coalesce(language, 'en') AS language, coalesce(share, 0) AS share FROM documents d LEFT JOIN b USING (doc_id)""")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = [("en", "the"), ("en", "and"), ("en", "of"), ("de", "der"), ("de", "und"), ("de", "die"), ("fr", "les"), ("fr", "et"), ("fr", "des"), ("es", "el"), ("es", "y"), ("es", "los")]
    tokens = F.filter(F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " "), lambda w: w != "")
    return nlp.language(table(spark, sf_dir, "documents"), spark.createDataFrame(words, "language string, word string"), tokens)


@query("nlp_spelling", """WITH d AS (SELECT n_name AS known, 1 + n_regionkey AS n FROM nation), w AS (SELECT DISTINCT substr(n_name, 1, length(n_name) - 1) || CASE WHEN n_nationkey % 2 = 0 THEN 'x' ELSE '' END AS word FROM nation), e AS (SELECT word, known, n, levenshtein(word, known) AS k FROM w, d),
f AS (SELECT * FROM e WHERE k <= 2 QUALIFY k = min(k) OVER (PARTITION BY word)) SELECT word, known AS suggestion, n / sum(n) OVER (PARTITION BY word) AS p FROM f UNION ALL SELECT word, word, 1 FROM w WHERE word NOT IN (SELECT word FROM f)""")
def spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    wrong = n.select(F.concat(F.expr("substr(n_name, 1, length(n_name) - 1)"), F.when(F.col("n_nationkey") % 2 == 0, "x").otherwise("")).alias("word"))
    return nlp.spelling(wrong, n.select(F.col("n_name").alias("word"), (F.col("n_regionkey") + 1).cast("long").alias("n")))


@query("nlp_phrases")
def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "benchmark").select("item_id", F.split(F.lower("text"), r"\s+").alias("tokens"))
    return nlp.merge_phrases(docs, nlp.phrases(docs, 1, 3), 0.5).select("item_id", F.array_join("tokens", " ").alias("text"))


@query("nlp_inflection", """SELECT * FROM (VALUES ('child', 'children', 'a', 'child', NULL), ('city', 'cities', 'a', 'citi', NULL), ('wolf', 'wolves', 'a', 'wolf', 'wolfed'), ('matrix', 'matrices', 'a', 'matrix', NULL), ('analysis', 'analyses', 'an', 'analysi', NULL),
('sheep', 'sheep', 'a', 'sheep', NULL), ('run', 'runs', 'a', 'run', 'ran'), ('stop', 'stops', 'a', 'stop', 'stopped'), ('take', 'takes', 'a', 'take', 'took'), ('echo', 'echoes', 'an', 'echo', 'echoed')) AS t(word, plural, article, stem, past)""")
def inflection(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.createDataFrame([(x,) for x in "echo city child wolf matrix analysis sheep run stop take".split()], "word string")
    return w.select("word", inflect.udf(inflect.pluralize)("word").alias("plural"), inflect.udf(inflect.article)("word").alias("article"), inflect.udf(stemmer.stem)("word").alias("stem"), F.when(F.col("word").isin("wolf", "run", "stop", "take", "echo"), inflect.udf(lambda v: inflect.conjugate(v, "past"))("word")).alias("past"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')"


def _distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))
    return table(spark, sf_dir, "documents").select(F.explode(words).alias("word")).distinct()


@query("nlp_articles", f"""WITH w AS (SELECT DISTINCT unnest({_WORDS}) AS word FROM documents)
SELECT word, CASE WHEN length(word) = 1 OR word = upper(word) THEN CASE WHEN regexp_matches(word, '^[AEFHILMNORSXaefhilmnorsx]') THEN 'an' ELSE 'a' END
  WHEN regexp_matches(lower(word), '^(ones?$|{"|".join(inflect._GLIDES)})') THEN 'a' WHEN regexp_matches(lower(word), '^([aeiou]|{"|".join(inflect._SILENT)})') THEN 'an' ELSE 'a' END AS article FROM w""")
def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every different word of the documents."""
    return _distinct_words(spark, sf_dir).select("word", inflect.udf(inflect.article)("word").alias("article"))


@query("nlp_word_forms")
def word_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plural, stem and past of every different lower-cased word of the documents."""
    w = _distinct_words(spark, sf_dir).select(F.lower("word").alias("word")).distinct()
    return w.select("word", inflect.udf(inflect.pluralize)("word").alias("plural"), inflect.udf(stemmer.stem)("word").alias("stem"), inflect.udf(lambda v: inflect.conjugate(v, "past"))("word").alias("past"))


@query("web_url_parts", r"""SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS protocol, lower(regexp_extract(url, '://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS domain, regexp_extract(url, '#(.*)$', 1) AS anchor, regexp_extract(url, '([^/?#]*)(?:[?#].*)?$', 1) AS page FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.url_parts("url").alias("u")).select("page_id", "u.protocol", "u.domain", "u.anchor", "u.page")


@query("web_strip", r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g')) AS hash FROM pages")
def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(web.strip_comments(web.strip_css(web.strip_javascript(F.col("html"))))).alias("hash"))


@query("web_plaintext")
def plaintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.plaintext("html").alias("text"))


@query("web_links", r"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), lambda u: regexp_extract(url, '^[a-z]+://[^/?#]*') || u), ' ') AS links FROM pages""")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.transform(web.links("html", "url"), lambda x: x["url"]), " ").alias("links"))


@query("web_selector", r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1), '\s+', ' ', 'g')) AS advert FROM pages")
def selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.get(web.select("body > div.ad")("html"), F.lit(0))["text"].alias("advert"))


@query("web_crawl")
def crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return web.crawl(pages, pages.select("url"), steps=2, per_domain=5)


@query("sheet_group", "SELECT o_orderpriority, count(*) AS n, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS states FROM orders GROUP BY 1")
def sheet_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_row"), "o_orderpriority", F.lit(1).alias("n"), F.col("o_orderstatus").alias("states"))
    return files.Sheet(o).group("o_orderpriority", ["count", "group_concat"])


@query("sheet_json", "SELECT '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}' AS json FROM nation")
def sheet_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.to_json(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))


@query("sheet_xml_html", "SELECT '<row n_nationkey=\"' || n_nationkey || '\" n_name=\"' || n_name || '\"/>' AS xml FROM nation UNION ALL SELECT '<tr><td>' || r_regionkey || '</td><td>' || r_name || '</td></tr>' FROM region")
def sheet_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.to_xml_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name")).unionAll(files.to_html(table(spark, sf_dir, "region").select("r_regionkey", "r_name")))


@query("sheet_transpose", "SELECT 'r_name' AS \"column\", max(r_name) FILTER (r_regionkey = 0) AS \"0\", max(r_name) FILTER (r_regionkey = 1) AS \"1\", max(r_name) FILTER (r_regionkey = 2) AS \"2\", max(r_name) FILTER (r_regionkey = 3) AS \"3\", max(r_name) FILTER (r_regionkey = 4) AS \"4\" FROM region")
def sheet_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.Sheet(table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("_row"), "r_name")).transpose()


@query("stream_rate_limit", """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS u, event_id, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS sec, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
s AS (SELECT u, event_id, sec, n, 1 AS k, sec AS began, true AS ok FROM e WHERE n = 1 UNION ALL
SELECT e.u, e.event_id, e.sec, e.n, CASE WHEN s.k < 3 THEN s.k + 1 WHEN e.sec - s.began <= 86400 THEN s.k ELSE 1 END, CASE WHEN s.k >= 3 AND e.sec - s.began > 86400 THEN e.sec ELSE s.began END, s.k < 3 OR e.sec - s.began > 86400 FROM s JOIN e ON e.u = s.u AND e.n = s.n + 1)
SELECT u AS "user", event_id, sec AS "at", CAST(k AS BIGINT) AS "count", ok AS accepted FROM s""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return stateful.rate_limit_batch(e, 3, 86400.0)


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS stop, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2, 3")
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.windowed(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL 1 DAY AS stop, user_id, count(*) AS n FROM s GROUP BY user_id, s")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stateful.sessions(table(spark, sf_dir, "events"), "ts", "1 day", ["user_id"])


@query("stream_as_of", "SELECT a.event_id, b.value AS as_of FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return stateful.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "value").select("event_id", "as_of")
