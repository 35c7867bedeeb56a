"""Queries of descriptive statistics, metrics and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import stats
from textloom.plans.catalog import query, table


@query("stats_moments", """SELECT l_returnflag, avg(l_quantity) AS mean, var_pop(l_quantity) AS variance, coalesce(var_samp(l_quantity), 0) AS sample_variance, sqrt(var_pop(l_quantity)) AS deviation,
count(*) / sum(1 / l_quantity) AS hmean, skewness_pop AS skewness, kurt AS kurtosis FROM lineitem JOIN (SELECT l_returnflag AS f, avg(power(l_quantity - m, 3)) / power(var_pop(l_quantity), 1.5) AS skewness_pop,
avg(power(l_quantity - m, 4)) / power(var_pop(l_quantity), 2) - 3 AS kurt FROM lineitem JOIN (SELECT l_returnflag AS g, avg(l_quantity) AS m FROM lineitem GROUP BY 1) ON g = l_returnflag GROUP BY 1) ON f = l_returnflag GROUP BY l_returnflag, skewness_pop, kurt""")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "l_quantity"
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        stats.mean(c).alias("mean"), stats.variance(c).alias("variance"), stats.variance(c, True).alias("sample_variance"), stats.deviation(c).alias("deviation"), stats.harmonic_mean(c).alias("hmean"),
        stats.skewness(c).alias("skewness"), stats.kurtosis(c).alias("kurtosis"),
    )


@query("stats_central_moment", "SELECT p_brand, avg(power(p_size - m, 3)) AS moment FROM part JOIN (SELECT p_brand AS b, avg(p_size) AS m FROM part GROUP BY 1) ON b = p_brand GROUP BY 1")
def central(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.moment(table(spark, sf_dir, "part"), "p_size", 3, ["p_brand"])


@query("stats_median_boxplot", """SELECT c_mktsegment, min(c_acctbal) AS least, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS middle, quantile_cont(c_acctbal, 0.75) AS q3, max(c_acctbal) AS most
FROM customer GROUP BY 1""")
def boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(*stats.boxplot("c_acctbal"))


@query("stats_quantile_parametrised", "SELECT n_regionkey, CAST(list_sort(list(n_nationkey))[1 + CAST(floor(len(list(n_nationkey)) * 0.5) AS INTEGER)] AS DOUBLE) AS q FROM nation GROUP BY 1")
def quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(stats.quantile(F.sort_array(F.collect_list("n_nationkey")), 0.5, 1, 0, 0, 0).cast("double").alias("q"))


@query("stats_histogram", """WITH b AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) + 1e-6 - min(o_totalprice)) / 10 AS w FROM orders)
SELECT CAST(floor((o_totalprice - lo) / w) AS BIGINT) AS bin, CAST(floor((o_totalprice - lo) / w) AS BIGINT) * w + lo AS start, (CAST(floor((o_totalprice - lo) / w) AS BIGINT) + 1) * w + lo AS stop, count(*) AS n FROM orders, b GROUP BY 1, 2, 3""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 10)


@query("stats_moving_average", "SELECT user_id, event_id, avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS sma, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS total FROM events")
def sma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", stats.moving_average("value", "event_id", 2, ["user_id"]).alias("sma"), stats.cumulative("value", "event_id", ["user_id"]).alias("total"))


@query("stats_frequencies", "SELECT event_type AS value, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY 1")
def freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.frequencies(table(spark, sf_dir, "events"), "event_type", relative=True)


@query("metrics_confusion_rates", """WITH c AS (SELECT count(*) FILTER (q AND t) AS tp, count(*) FILTER (NOT q AND NOT t) AS tn, count(*) FILTER (NOT q AND t) AS fp, count(*) FILTER (q AND NOT t) AS fn FROM (SELECT quality = 1 AS q, doc_id % 3 > 0 AS t FROM labels))
SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 5 * (tp / (tp + fp)) * (tp / (tp + fn)) / (4 * (tp / (tp + fp)) + tp / (tp + fn)) AS f, tn / (tn + fp) AS specificity FROM c""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "labels").agg(*stats.confusion(F.col("quality") == 1, F.col("doc_id") % 3 > 0))
    return stats.rates(cells, beta=2.0)


@query("metrics_macro", """WITH x AS (SELECT o_orderpriority AS t, CASE WHEN o_orderkey % 4 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS p FROM orders),
c AS (SELECT k, sum(CASE WHEN t = k AND p = k THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN t <> k AND p = k THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN t = k AND p <> k THEN 1 ELSE 0 END) AS fn, count(*) AS n FROM x, (SELECT DISTINCT t AS k FROM x) GROUP BY k),
m AS (SELECT avg((n - fp - fn) / n) AS accuracy, avg(tp / (tp + fp)) AS precision, avg(tp / (tp + fn)) AS recall FROM c) SELECT *, 2 * precision * recall / (precision + recall) AS f FROM m""")
def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("o_orderkey") % 4 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))
    return stats.macro(table(spark, sf_dir, "orders").withColumn("p", p), "o_orderpriority", "p")


@query("metrics_roc_auc", """WITH r AS (SELECT p_brand, count(*) FILTER (p_size > 25 AND p_retailprice > 1200) AS tp, count(*) FILTER (p_size <= 25 AND p_retailprice <= 1200) AS tn, count(*) FILTER (p_size <= 25 AND p_retailprice > 1200) AS fp, count(*) FILTER (p_size > 25 AND p_retailprice <= 1200) AS fn FROM part GROUP BY 1),
p AS (SELECT fp / greatest(fp + tn, 1) AS x, tp / greatest(tp + fn, 1) AS y FROM r UNION ALL VALUES (0.0, 0.0), (1.0, 1.0)), s AS (SELECT x, y, lag(x) OVER w AS x0, lag(y) OVER w AS y0 FROM p WINDOW w AS (ORDER BY x, y))
SELECT sum((x - x0) * (y + y0) / 2) AS auc FROM s""")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").groupBy("p_brand").agg(*stats.confusion(F.col("p_size") > 25, F.col("p_retailprice") > 1200))
    return stats.auc(stats.roc(cells))


@query("metrics_scored_auc", "SELECT sum(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0 END) / count(*) AS auc FROM (SELECT n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 1) a, (SELECT n_chars FROM documents JOIN labels USING (doc_id) WHERE quality = 0) b")
def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return stats.scored_auc(df, "n_chars", F.col("quality") == 1)


@query("metrics_fleiss_kappa", """WITH v AS (SELECT o_custkey AS t, o_orderstatus AS c FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 5 QUALIFY count(*) OVER (PARTITION BY o_custkey) = 5),
x AS (SELECT t, c, count(*) AS n FROM v GROUP BY 1, 2), a AS (SELECT avg((s - 5) / 20) AS agreed FROM (SELECT t, sum(n * n) AS s FROM x GROUP BY 1)), e AS (SELECT sum(power(n / (SELECT count(*) FROM v), 2)) AS chance FROM (SELECT c, sum(n) AS n FROM x GROUP BY 1))
SELECT (agreed - chance) / (1 - chance) AS kappa FROM a, e""")
def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    w = Window.partitionBy("o_custkey")
    votes = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w.orderBy("o_orderkey"))).where("k <= 5").withColumn("n", F.count("*").over(w)).where("n = 5")
    return stats.fleiss_kappa_of(votes, "o_custkey", "o_orderstatus")


@query("tests_kolmogorov_smirnov", """WITH c AS (SELECT l_quantity AS v, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag <> 'R') AS b FROM lineitem GROUP BY 1), r AS (SELECT sum(a) OVER (ORDER BY v) AS a, sum(b) OVER (ORDER BY v) AS b, sum(a) OVER () AS n1, sum(b) OVER () AS n2 FROM c)
SELECT max(abs(a / n1 - b / n2)) AS d, CAST(max(n1) AS BIGINT) AS n1, CAST(max(n2) AS BIGINT) AS n2 FROM r""")
def ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kolmogorov_smirnov(table(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_returnflag") == "R").drop("p")


@query("tests_chi_squared", """WITH o AS (SELECT c_mktsegment AS g, c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY g) * sum(n) OVER (PARTITION BY k) / sum(n) OVER () AS e FROM o)
SELECT sum(power(n - e, 2) / e) AS x2, 2 * sum(n * ln(n / e)) AS g2 FROM m""")
def chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    cells = table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    e = F.sum("n").over(Window.partitionBy("c_mktsegment")) * F.sum("n").over(Window.partitionBy("c_nationkey")) / total
    return cells.withColumn("e", e).agg(F.sum(F.pow(F.col("n") - F.col("e"), 2) / F.col("e")).alias("x2"), (2 * F.sum(F.col("n") * F.log(F.col("n") / F.col("e")))).alias("g2"))


@query("tests_fisher_exact", """WITH t AS (SELECT p_brand, count_if(p_size > 25 AND p_retailprice > 1400)::BIGINT AS a, count_if(p_size > 25 AND p_retailprice <= 1400)::BIGINT AS b, count_if(p_size <= 25 AND p_retailprice > 1400)::BIGINT AS c, count_if(p_size <= 25 AND p_retailprice <= 1400)::BIGINT AS d FROM part GROUP BY 1),
f AS (SELECT *, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) AS top FROM t), x AS (SELECT *, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM f),
l AS (SELECT *, top - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1) AS lp, top - lgamma(a + 1) - lgamma(b + 1) - lgamma(c + 1) - lgamma(d + 1) AS own FROM x)
SELECT p_brand, a, b, c, d, round(least(1.0, sum(CASE WHEN lp <= own + 1e-9 THEN exp(lp) ELSE 0 END)), 9) AS p FROM l GROUP BY 1, 2, 3, 4, 5""")
def fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cells = p.groupBy("p_brand").agg(F.count_if((F.col("p_size") > 25) & (F.col("p_retailprice") > 1400)).alias("a"), F.count_if((F.col("p_size") > 25) & (F.col("p_retailprice") <= 1400)).alias("b"), F.count_if((F.col("p_size") <= 25) & (F.col("p_retailprice") > 1400)).alias("c"), F.count_if((F.col("p_size") <= 25) & (F.col("p_retailprice") <= 1400)).alias("d"))
    return cells.withColumn("p", F.round(stats.fisher_exact_udf("a", "b", "c", "d"), 9))


@query("stats_interpolation", "SELECT p_partkey, 1.0 + (3.0 - 1.0) * least(greatest((p_size - 10) / 30, 0), 1) AS lerped, power(least(greatest((p_size - 10) / 30, 0), 1), 2) * (3 - 2 * least(greatest((p_size - 10) / 30, 0), 1)) AS smoothed FROM part")
def interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", stats.lerp(F.lit(1.0), F.lit(3.0), (size - 10) / 30).alias("lerped"), stats.smoothstep(F.lit(10.0), F.lit(40.0), size).alias("smoothed"))
