"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import chat, counts, decontaminate, mixing, neardup, pages, phrases, pieces, pii, quality, runs, topk, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.scores(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link_components(_table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
OP2_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT DISTINCT a AS id, a AS c FROM e UNION SELECT b, c FROM r JOIN e ON a = id)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(m, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(c) AS m FROM r GROUP BY 1) ON id = w.doc_id
"""


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents it selects; ``quality.score`` gives the grades of all."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels"))).where("keep")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP6_SQL = f"""
WITH k AS (SELECT unnest(range(1, 6)) AS k), d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
s AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[j:j+k-1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS s FROM d, k WHERE len(w) >= k),
t AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[j:j+k-1], ' ') FOR j IN range(1, len(w) - k + 2)]) AS s FROM i, k WHERE len(w) = k OR (k = 5 AND len(w) > 5)),
n AS (SELECT item_id, count(*) AS n FROM t GROUP BY 1), m AS (SELECT doc_id, item_id, count(*) AS c FROM s JOIN t USING (k, s) GROUP BY 1, 2)
SELECT doc_id, CAST(item_id AS BIGINT) AS item_id, c AS shared, n AS item_shingles, c / n AS containment FROM m JOIN n USING (item_id) WHERE 100 * c >= 75 * n
"""


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.render(chat.fold(chat.events_of(rows.unionByName(extra)))))


OP5_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(24 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;')) + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Dated entries of the lists that op9 evaluates: (list_id, policy, kind, rule, action, dated).
URL_ENTRIES = [
    ("spam", "block", "host", "www.spam-farm.example.org", "add", "2023-06-01"),
    ("spam", "block", "domain", "spam-farm.example.org", "add", "2024-02-10"),
    ("spam", "block", "domain", "spam-farm.example.org", "remove", "2024-09-01"),
    ("spam", "block", "domain", "spam-farm.example.org", "add", "2024-11-15"),
    ("malware", "block", "domain", "example.net", "add", "2024-03-01"),
    ("malware", "block", "domain", "example.net", "remove", "2024-04-15"),
    ("malware", "block", "prefix", "tionsh.example.net/fr/", "add", "2024-05-01"),
    ("malware", "block", "prefix", "tionsh.example.net/fr/", "remove", "2024-12-01"),
    ("adult", "block", "domain", "tiontion.example.com", "add", "2024-01-20"),
    ("adult", "block", "host", "m.ththther.example.org", "add", "2024-07-04"),
    ("adult", "block", "domain", "example.org", "add", "2024-10-01"),
    ("adult", "block", "domain", "example.org", "remove", "2024-10-01"),
    ("trusted", "allow", "host", "tionsh.example.net", "add", "2024-04-01"),
    ("trusted", "allow", "host", "tionsh.example.net", "remove", "2024-08-01"),
    ("trusted", "allow", "prefix", "blog.tionble.example.com/en/", "add", "2024-01-01"),
]
_ENTRY_FIELDS = ["list_id", "policy", "kind", "rule", "action", "dated"]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time, so one follows from page_id: a day of 2024."""
    day = F.pmod(F.col("page_id"), F.lit(366)).cast("int")
    captures = _table(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), day).cast("timestamp").alias("fetched_at"))
    entries = spark.createDataFrame(URL_ENTRIES, ", ".join(f"{x} string" for x in _ENTRY_FIELDS)).withColumn("dated", F.to_timestamp("dated"))
    return urls.evaluate(captures, entries)


OP9_SQL = f"""
WITH c AS (SELECT DISTINCT page_id, url, CAST(DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS TIMESTAMP) AS fetched_at FROM pages),
h AS (SELECT *, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
             lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1)) AS path FROM c),
e(list_id, policy, kind, rule, action, dated) AS (VALUES {", ".join(str(x) for x in URL_ENTRIES)}),
i AS (SELECT *, lead(dated) OVER (PARTITION BY list_id, policy, kind, rule ORDER BY dated, action = 'remove') AS valid_to FROM e),
m AS (SELECT h.page_id, h.url, h.fetched_at, i.* FROM h LEFT JOIN i ON action = 'add' AND h.fetched_at >= CAST(dated AS TIMESTAMP) AND (valid_to IS NULL OR h.fetched_at < CAST(valid_to AS TIMESTAMP)) AND
  CASE kind WHEN 'host' THEN host = rule WHEN 'domain' THEN host = rule OR ends_with(host, '.' || rule)
            ELSE host || path = rule OR (ends_with(rule, '/') AND starts_with(host || path, rule)) END)
SELECT page_id, url, fetched_at, count(kind) AS n_active,
  coalesce(max(length(rule)) FILTER (policy = 'block'), 0) > coalesce(max(length(rule)) FILTER (policy = 'allow'), 0) AS blocked,
  coalesce(string_agg(concat_ws(':', policy, list_id, kind, rule), ',' ORDER BY concat_ws(':', policy, list_id, kind, rule)) FILTER (kind IS NOT NULL), '') AS matched
FROM m GROUP BY page_id, url, fetched_at
"""


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return topk.top_k(topk.integers(table, 256), topk.integers(table.where(F.col("vec_id") % 50 == 0), 256))


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a tenth of the ids get a periodic tail first, as the contract has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def tail(w):
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # a lambda's variable keeps the words, which would else be cut out anew for each of them
    text = F.when(h % 10 == 0, F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, tail(w))), F.lit(0))).otherwise(F.col("text"))
    found = runs.find_runs(_table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    best = runs.strongest(F.col("runs"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), runs.digest(F.col("runs")).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long")
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p), t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, unnest([w[i:i+k-1] FOR i IN range(1, len(w) - k + 2)]) AS g FROM w, (SELECT unnest(range(1, 6)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100), c AS (SELECT * FROM f WHERE k > 1),
inside AS (SELECT DISTINCT lang, g[i:i+m-1] AS g, f FROM c, (SELECT unnest(range(2, 5)) AS m), (SELECT unnest(range(1, 5)) AS i) WHERE m < k AND i + m - 1 <= k),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.g = c.g AND x.f >= c.f)),
cuts AS (SELECT kept.lang, kept.g, kept.f AS a, j, kept.g[1:j] AS one, kept.g[j+1:k] AS two FROM kept, (SELECT unnest(range(1, 5)) AS j) WHERE j < k),
s AS (SELECT cuts.lang, cuts.g, a, j, x.f AS l, y.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
      FROM cuts JOIN f x ON x.lang = cuts.lang AND x.g = one JOIN f y ON y.lang = cuts.lang AND y.g = two JOIN t ON t.lang = cuts.lang),
b AS (SELECT *, array_to_string(g, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= 2000
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = counts.prefix_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), prefixes=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard_join": OP2_SQL, "op6_benchmark_decontamination": OP6_SQL, "op5_chat_formatting": OP5_SQL, "op9_url_filters": OP9_SQL, "op10_exact_top_k": OP10_SQL, "op12_phrase_collocations": OP12_SQL}
