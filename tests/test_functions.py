"""Statistics, strings and dates with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import dates, stats, strings


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def numbers(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_variances(spark):
    r = numbers(spark, [2, 4, 4, 10]).agg(stats.variance("x"), stats.variance("x", True)).first()
    assert tuple(r) == (9.0, 12.0)
    r = numbers(spark, [3, 3, 9, 13]).agg(stats.deviation("x", True), stats.deviation("x")).first()
    assert tuple(r) == pytest.approx((24**0.5, 18**0.5), abs=1e-3)
    assert numbers(spark, [3]).agg(stats.variance("x", True)).first()[0] == 0.0
    assert [stats.moment(numbers(spark, [2, 4, 4, 10]), "x", n).first()[0] for n in (1, 2)] == pytest.approx([0.0, 9.0])


def test_quantiles_and_histogram(spark):
    a = F.array(*map(F.lit, (2.0, 4.0, 8.0, 16.0)))
    assert one(spark, stats.quantile(a)) == 6.0
    assert one(spark, stats.quantile(a, 0.5, 0.5, 0, 1, 0)) == 8.0
    assert [(r["bin"], r["n"]) for r in stats.histogram(numbers(spark, [0, 1, 2, 9]), "x", 2).orderBy("bin").collect()] == [(0, 3), (1, 1)]
    assert tuple(numbers(spark, [50, 20, 40, 10, 30]).agg(*stats.boxplot("x")).first()) == pytest.approx((10, 20, 30, 40, 50))


def test_hypothesis_tests(spark):
    for a, b, c, d in ((4, 0, 1, 3), (12, 5, 6, 20), (0, 7, 3, 2)):
        rows, left, n = a + b, a + c, a + b + c + d
        p = {k: math.comb(left, k) * math.comb(n - left, rows - k) / math.comb(n, rows) for k in range(max(0, rows + left - n), min(rows, left) + 1)}
        assert stats.fisher_exact(a, b, c, d) == pytest.approx(sum(x for x in p.values() if x <= p[a] * (1 + 1e-9)))
    assert stats.chi_squared([[40, 20]], [[30, 30]]) == pytest.approx((20 / 3, math.erfc((10 / 3) ** 0.5)))
    assert stats.chi_squared([[18, 22, 20]]) == pytest.approx((0.4, math.exp(-0.2)))
    assert stats.chi_squared([[10, 20], [30, 40]])[0] == pytest.approx(100 * (10 * 40 - 20 * 30) ** 2 / (30 * 70 * 40 * 60))
    df = spark.createDataFrame([(v, True) for v in (1, 3, 5, 7)] + [(v, False) for v in (2, 4, 6, 8)], "v int, a boolean")
    r = stats.kolmogorov_smirnov(df, "v", F.col("a")).first()
    assert r["d"] == 0.25 and r["p"] > 0.9
    assert stats.gammai(2.0, 3.0) == pytest.approx(math.exp(-3) * 4)


def test_agreement():
    # three judges, three tasks: observed agreement 7/9, by chance 41/81
    assert stats.fleiss_kappa([[3, 0], [0, 3], [2, 1]]) == pytest.approx((7 / 9 - 41 / 81) / (1 - 41 / 81))
    assert stats.entropy([1, 1]) == 1.0
    assert stats.entropy([3, 1]) == pytest.approx(2 - 0.75 * math.log2(3))
    assert stats.entropy([0.25]) == pytest.approx(0.5)


def test_strings(spark):
    assert one(spark, F.levenshtein(F.lit("harbour"), F.lit("arbours"))) == 2
    assert one(spark, strings.similarity(F.lit("stone"), F.lit("store"))) == 0.8
    assert one(spark, strings.dice(F.lit("bread"), F.lit("break"))) == 0.75
    assert one(spark, strings.deflood(F.lit("YESSSS????"), 1)) == "YES?"
    assert one(spark, strings.deflood(F.lit("YESSSS????"), 2)) == "YESS??"
    assert one(spark, strings.type_token_ratio(F.lit("one two\n one two three"))) == pytest.approx(0.6)
    assert one(spark, strings.readability(F.lit("Extraordinarily complicated administrative considerations notwithstanding, authorities unanimously capitulated."))) < 0.30
    assert one(spark, strings.decamel(F.lit("FieldOfView"))) == "field_of_view"
    assert one(spark, strings.urls(F.lit("see http://a.b/c, or www.d.e. and http://a.b/c"))) == ["http://a.b/c", "www.d.e"]
    assert one(spark, strings.encode_entities(F.lit('<a> & "b" &#38;'))) == "&lt;a&gt; &amp; &quot;b&quot; &#38;"
    assert one(spark, strings.base62(F.lit(3844))) == "100"
    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for n in (0, 61, 2**53 + 1, 2**60 + 12345, 2**63 - 1):
        text = one(spark, strings.base62(F.lit(n)))
        assert sum(digits.index(c) * 62**i for i, c in enumerate(reversed(text))) == n and (n == 0 or text[0] != "0")
    assert one(spark, strings.readability(F.lit("One cat. Two cats! Three cats? Yes it is so."))) >= one(spark, strings.readability(F.lit("One cat, two cats, three cats, yes it is so.")))
    assert one(spark, strings.decrypt(strings.encrypt(F.lit("héllo"), "k"), "k")) == "héllo"
    assert one(spark, strings.repair(F.lit("Ã©tÃ©"))) == "été"


def test_dates(spark):
    for s in ("2019-03-05 07:08:09", "5 March 2019", "March 5, 2019", "2019-W10-2", "Tue, 05 Mar 2019 07:08:09 +0000", "1551769689"):
        assert one(spark, dates.parse(F.lit(s)).cast("date")).isoformat() == "2019-03-05", s
    assert one(spark, dates.parse(F.lit("nonsense"))) is None
    assert one(spark, dates.add(F.lit("2023-01-30").cast("timestamp"), months=1)).isoformat() == "2023-02-28T00:00:00"
