"""Queries on ranks, p-values, comparisons, encodings, composition and series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortal.functions import numeric as N
from cohortal.operators import comparison as C
from cohortal.operators import composition as M
from cohortal.operators import encoding as E
from cohortal.operators import pairs as P
from cohortal.operators import series as S
from cohortal.operators import significance as G
from cohortal.operators import text as T
from cohortal.plans.oracle import ANALYTE, DAILY, JOURNAL, LABELLED, average_rank, beta, upper_tail
from cohortal.sources import tables as D

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *doubles: str, places: int = 6) -> DataFrame:
    """Doubles rounded, and whole numbers as longs, so that results of two engines can be compared."""
    df = df.withColumns({c: F.round(c, places) for c in doubles})
    return df.select([F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


_P = f"""WITH part_p AS (SELECT p_partkey AS pos, (p_partkey * 7919 % 10007 + 0.5) / 10007.0 * (CASE WHEN p_size < 5 THEN 0.01 ELSE 1 END) AS p FROM part)"""


def part_p(spark: SparkSession, d: str) -> DataFrame:
    """A p-value for each part: spread evenly, with small sizes enriched near 0."""
    p = D.read(spark, d, "part")
    return p.select(F.col("p_partkey").alias("pos"), ((F.col("p_partkey") * 7919 % 10007 + 0.5) / 10007.0 * F.when(F.col("p_size") < 5, 0.01).otherwise(1.0)).alias("p"))


@query(f"SELECT c_custkey AS pos, round((row_number() OVER (ORDER BY c_acctbal, c_custkey) - 0.5) / count(*) OVER (), 6) AS fraction, round({average_rank('c_acctbal')} / count(*) OVER (), 6) AS equalised FROM customer")
def frac_rank_acctbal(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal and average fractional ranks."""
    x = D.read(spark, d, "customer").select(F.col("c_custkey").alias("pos"), "c_acctbal")
    return rounded(G.equalised(G.fractional_rank(x, "c_acctbal", "pos"), "c_acctbal").drop("c_acctbal"), "fraction", "equalised")


@query(f"SELECT c_custkey AS pos, round(({average_rank('c_acctbal')} - 0.5) / (SELECT count(DISTINCT c_acctbal) FROM customer), 6) AS share FROM customer")
def rank_distinct_acctbal(spark: SparkSession, d: str) -> DataFrame:
    """Average rank over the number of distinct values."""
    x = D.read(spark, d, "customer").select(F.col("c_custkey").alias("pos"), "c_acctbal")
    return rounded(G.rank_distinct_share(x, "c_acctbal").drop("c_acctbal"), "share")


@query("""WITH f AS (SELECT c_acctbal AS v, (row_number() OVER (ORDER BY c_acctbal, c_custkey) - 0.5) / count(*) OVER () AS f FROM customer),
 t AS (SELECT v, f, round(abs(f - least(greatest(0.25, (SELECT min(f) FROM f)), (SELECT max(f) FROM f))), 12) AS a FROM f), n AS (SELECT * FROM t ORDER BY a, f LIMIT 2)
SELECT round(coalesce(max(CASE WHEN a = 0 THEN v END), avg(v)), 6) AS value FROM n""")
def percentile_acctbal(spark: SparkSession, d: str) -> DataFrame:
    """The value at the 25th percentile, or the mean of the two nearest."""
    x = D.read(spark, d, "customer").select("c_custkey", "c_acctbal")
    return rounded(G.value_at_percentile(x, "c_acctbal", "c_custkey", 25), "value")


@query(f"{_P} SELECT pos, round(p / greatest(p, row_number() OVER (ORDER BY p, pos) / count(*) OVER ()), 6) AS q FROM part_p")
def qvalues_parts(spark: SparkSession, d: str) -> DataFrame:
    """q-values by ordinal rank."""
    return rounded(G.q_values(part_p(spark, d)).drop("p"), "q")


@query(f"{_P} SELECT pos, round(p / greatest(p, (row_number() OVER (ORDER BY p, pos) - 0.5) / count(*) OVER ()), 6) AS q FROM part_p")
def qvalues_midrank(spark: SparkSession, d: str) -> DataFrame:
    """q-values with half a rank taken off."""
    return rounded(G.q_values_midrank(part_p(spark, d)).drop("p"), "q")


@query(f"{_P} SELECT pos, round(p / greatest(p, ({average_rank('p')} - 0.5) / (SELECT count(DISTINCT p) FROM part_p)), 6) AS q FROM part_p")
def qvalues_distinct(spark: SparkSession, d: str) -> DataFrame:
    """q-values over distinct levels."""
    return rounded(G.q_values_distinct(part_p(spark, d)).drop("p"), "q")


_R = "row_number() OVER (ORDER BY p, pos)"
_ADJUST = {
    "bonferroni": "p * m", "sidak": "1 - pow(1 - p, m)",
    "holm": "max(p * (m - r + 1)) OVER (ORDER BY r)", "holm-sidak": "max(1 - pow(1 - p, m - r + 1)) OVER (ORDER BY r)",
    "hochberg": "min(p * (m - r + 1)) OVER (ORDER BY r DESC)", "fdr_bh": "min(p * m / r) OVER (ORDER BY r DESC)",
    "fdr_by": "min(p * m / r * h) OVER (ORDER BY r DESC)",
}


def _adjust(method: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(G.adjusted(part_p(spark, d), method).drop("p"), "adjusted")

    run.__name__ = "adjust_" + method.replace("-", "_")
    query(f"""{_P}, r AS (SELECT pos, p, {_R} AS r, count(*) OVER () AS m FROM part_p), h AS (SELECT *, (SELECT sum(1.0 / r) FROM r) AS h FROM r)
SELECT pos, round(least(1.0, {_ADJUST[method]}), 6) AS adjusted FROM h""")(run)


for _m in _ADJUST:
    _adjust(_m)


def _two_stage(method: str, factor: float) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return rounded(G.adjusted(part_p(spark, d), method).drop("p"), "adjusted")

    run.__name__ = "adjust_" + method
    query(f"""{_P}, r AS (SELECT pos, p, {_R} AS r, count(*) OVER () AS m FROM part_p), b AS (SELECT pos, m, least(1.0, {_ADJUST['fdr_bh']}) AS b FROM r), f AS (SELECT count(*) AS found FROM b WHERE b <= 0.05 / {factor})
SELECT pos, round(least(1.0, b * {factor} * CASE WHEN found = m THEN 1.0 ELSE 1 - found / m END), 6) AS adjusted FROM b, f""")(run)


_two_stage("fdr_tsbh", 1.0)
_two_stage("fdr_tsbky", 1.05)


@query(f"""WITH {ANALYTE}, z AS (SELECT feature, sample, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z, {average_rank('value')} / count(*) OVER () AS r FROM analyte)
SELECT feature, sample, round({upper_tail('z')}, 6) AS p, round(r, 6) AS r FROM z""")
def normal_p_revenue(spark: SparkSession, d: str) -> DataFrame:
    """Upper normal tails of revenue."""
    return rounded(G.normal_p_values(D.analytes(spark, d)).drop("value"), "p", "r").withColumn("sample", F.col("sample").cast("int"))


@query(f"""WITH {LABELLED}, w AS (SELECT feature, round(value / 1000, 6) AS v, region FROM labelled), g AS (SELECT feature, count(CASE WHEN region = 'ASIA' THEN v END) AS n_a, count(CASE WHEN region = 'EUROPE' THEN v END) AS n_b,
 avg(CASE WHEN region = 'ASIA' THEN v END) - avg(CASE WHEN region = 'EUROPE' THEN v END) AS difference, var_samp(CASE WHEN region = 'ASIA' THEN v END) AS va, var_samp(CASE WHEN region = 'EUROPE' THEN v END) AS vb FROM w GROUP BY 1),
 t AS (SELECT *, difference / sqrt(va / n_a + vb / n_b) AS t, pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)) AS df FROM g)
SELECT feature, n_a, n_b, round(difference, 4) AS difference, round(t, 4) AS t, round(df, 4) AS df, round({beta('(df / (df + t * t))', 'df / 2', '0.5')}, 6) AS p FROM t""")
def welch_by_brand(spark: SparkSession, d: str) -> DataFrame:
    """Welch's test of each brand's revenue between two regions."""
    x = D.labelled(spark, d).withColumn("value", F.round(F.col("value") / 1000, 6))
    return rounded(rounded(C.welch(x, "feature", "region", "ASIA", "EUROPE"), "p"), "difference", "t", "df", places=4)


@query(f"""WITH g AS (SELECT l_linestatus, count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS n_a, count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS n_b, avg(CASE WHEN l_returnflag = 'A' THEN l_quantity END) - avg(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS difference,
 var_samp(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS va, var_samp(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS vb FROM lineitem GROUP BY 1),
 t AS (SELECT *, difference / sqrt(va / n_a + vb / n_b) AS t, pow(va / n_a + vb / n_b, 2) / (pow(va / n_a, 2) / (n_a - 1) + pow(vb / n_b, 2) / (n_b - 1)) AS df FROM g),
 h AS (SELECT *, {beta('(df / (df + t * t))', 'df / 2', '0.5')} AS p FROM t) SELECT l_linestatus, round(t, 4) AS t, round(df, 2) AS df, round(p, 6) AS p, round(CASE WHEN t > 0 THEN p / 2 ELSE 1 - p / 2 END, 6) AS p_greater FROM h""")
def welch_of_lines(spark: SparkSession, d: str) -> DataFrame:
    """Welch's test of quantity between two return flags, with the degrees of freedom of all lines, and its one-sided form."""
    line = D.read(spark, d, "lineitem")
    both = C.welch(line, "l_linestatus", "l_returnflag", "A", "R", "l_quantity")
    greater = C.welch(line, "l_linestatus", "l_returnflag", "A", "R", "l_quantity", alternative="greater").select("l_linestatus", F.col("p").alias("p_greater"))
    x = rounded(both.join(greater, "l_linestatus"), "p", "p_greater")
    return rounded(rounded(x, "t", places=4), "df", places=2).select("l_linestatus", "t", "df", "p", "p_greater")


@query(f"""WITH {LABELLED}, b AS (SELECT * FROM labelled WHERE region IN ('ASIA', 'EUROPE')), r AS (SELECT *, {average_rank('value', 'feature')} AS r, count(*) OVER (PARTITION BY feature, value) AS c FROM b),
 g AS (SELECT feature, count(CASE WHEN region = 'ASIA' THEN 1 END) AS n_a, count(CASE WHEN region = 'EUROPE' THEN 1 END) AS n_b, sum(CASE WHEN region = 'ASIA' THEN r END) AS s, sum(c * c - 1.0) AS ties FROM r GROUP BY 1),
 u AS (SELECT *, s - n_a * (n_a + 1) / 2.0 AS u, n_a + n_b AS n FROM g), z AS (SELECT *, greatest(0.0, abs(u - n_a * n_b / 2.0) - 0.5) / sqrt(n_a * n_b / 12.0 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u)
SELECT feature, n_a, n_b, u, round(least(1.0, 2 * {upper_tail('z')}), 6) AS p FROM z""")
def mannwhitney_by_brand(spark: SparkSession, d: str) -> DataFrame:
    """Mann-Whitney test of each brand between two regions."""
    return rounded(C.mann_whitney(D.labelled(spark, d), "feature", "region", "ASIA", "EUROPE"), "p")


@query(f"""WITH {LABELLED}, g AS (SELECT feature, avg(CASE WHEN region = 'ASIA' THEN value END) AS ma, avg(CASE WHEN region = 'EUROPE' THEN value END) AS mb, median(CASE WHEN region = 'ASIA' THEN value END) - median(CASE WHEN region = 'EUROPE' THEN value END) AS md,
 count(CASE WHEN region = 'ASIA' THEN value END) AS n, count(CASE WHEN region = 'EUROPE' THEN value END) AS m, var_samp(CASE WHEN region = 'ASIA' THEN value END) AS v, var_samp(CASE WHEN region = 'EUROPE' THEN value END) AS w FROM labelled GROUP BY 1)
SELECT feature, round(ma - mb, 2) AS mean_difference, round(md, 2) AS median_difference, round(log2(ma / mb), 6) AS log2_ratio, round((ma - mb) / sqrt(((n - 1) * v + (m - 1) * w) / (n + m - 2) * (1.0 / n + 1.0 / m)), 6) AS t FROM g""")
def fc_compare(spark: SparkSession, d: str) -> DataFrame:
    """Differences of means and medians, log ratio and pooled t of each brand between two regions."""
    x = rounded(C.fold_change(D.labelled(spark, d), "feature", "region", "ASIA", "EUROPE"), "log2_ratio", "t")
    return rounded(x, "mean_difference", "median_difference", places=2)


@query(f"""WITH {LABELLED}, g AS (SELECT feature, region, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM labelled GROUP BY 1, 2),
 a AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS m, sum(n * v) AS w, sum(n * m * m) AS s FROM g GROUP BY 1), f AS (SELECT feature, k - 1.0::DOUBLE AS d1, (n - k)::DOUBLE AS d2, (s - n * m * m) / (k - 1) / (w / (n - k)) AS f FROM a)
SELECT feature, round(f, 6) AS f, d1::DOUBLE AS d1, d2, round({beta('(d2 / (d2 + d1 * f))', 'd2 / 2', 'd1 / 2')}, 6) AS p FROM f""")
def anova_by_brand(spark: SparkSession, d: str) -> DataFrame:
    """One-way analysis of variance of each brand over regions."""
    return rounded(C.one_way_anova(D.labelled(spark, d), "feature", "region"), "f", "p")


@query(f"""WITH g AS (SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, regr_syy(l_extendedprice, l_quantity) AS tss, regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem GROUP BY 1),
f AS (SELECT *, r2 / ((1 - r2) / (n - 2)) AS f, (n - 2)::DOUBLE AS d2 FROM g)
SELECT l_returnflag, round(slope, 4) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, round(f, 2) AS f, round({beta('(d2 / (d2 + f))', 'd2 / 2', '0.5')}, 6) AS p FROM f""")
def regression_assess(spark: SparkSession, d: str) -> DataFrame:
    """Price on quantity for each return flag."""
    x = C.regression_assessment(D.read(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag").withColumn("r2", F.col("ess") / F.col("tss"))
    return rounded(rounded(rounded(x.select("l_returnflag", "slope", "intercept", "r2", "f", "p"), "r2", "p"), "slope", "intercept", places=4), "f", places=2)


@query(f"WITH {LABELLED} SELECT region, feature, round(avg(value), 2) AS mean FROM labelled GROUP BY 1, 2")
def group_means(spark: SparkSession, d: str) -> DataFrame:
    """Means of regions."""
    return rounded(C.group_means(D.labelled(spark, d), "region", "feature", "value"), "mean", places=2)


@query(f"WITH {JOURNAL} SELECT sample, region AS label, CAST(1 AS BIGINT) AS one FROM journal")
def one_hot_region(spark: SparkSession, d: str) -> DataFrame:
    """One-hot encoding in long form."""
    return E.one_hot(D.journal(spark, d), "sample", "region").withColumn("one", F.col("one").cast("long"))


@query("""SELECT c_custkey AS id, 'x' || c_mktsegment || '-' || r_name AS label, CAST(1 AS DOUBLE) AS weight FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT c_custkey, 'x' || c_mktsegment, 1 FROM customer UNION ALL SELECT c_custkey, 'xc_acctbal', c_acctbal FROM customer""")
def interaction_encode(spark: SparkSession, d: str) -> DataFrame:
    """A formula with an interaction, a category and a linear term."""
    c = D.read(spark, d, "customer").join(D.journal(spark, d), F.col("c_nationkey") == F.col("sample")).withColumnRenamed("c_custkey", "id")
    x = E.design(c, "id", E.Formula.parse("y ~ C(c_mktsegment):C(region) + C(c_mktsegment) + c_acctbal"))
    return x.withColumn("label", F.concat(F.lit("x"), "label"))


@query(f"""WITH {LABELLED} SELECT feature, region AS term, round(avg(value), 2) AS beta FROM labelled GROUP BY 1, 2""")
def multifactor_beta(spark: SparkSession, d: str) -> DataFrame:
    """Least squares of every brand on region indicators (whose solution is the means)."""
    j = E.one_hot_wide(D.journal(spark, d), "sample", "region")
    x = C.gram_solution(D.analytes(spark, d), j, "feature", "sample", "value", j.columns[1:])
    return rounded(x, "beta", places=2)


@query(f"""WITH {ANALYTE}, {JOURNAL}, b AS (SELECT feature, sample, value, c FROM analyte JOIN (SELECT c_nationkey AS sample, count(*)::DOUBLE AS c FROM customer GROUP BY 1) USING (sample)),
 s AS (SELECT x.feature, sum(sign(x.value - y.value) * sign(x.c - y.c)) AS s, sum(abs(sign(x.value - y.value))) AS nx, sum(abs(sign(x.c - y.c))) AS ny FROM b x JOIN b y ON x.feature = y.feature AND x.sample < y.sample GROUP BY 1)
SELECT feature, round(s / sqrt(nx * ny), 6) AS tau FROM s""")
def kendall_by_brand(spark: SparkSession, d: str) -> DataFrame:
    """Kendall's tau of revenue and number of customers over nations."""
    c = D.read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("sample")).agg(F.count("*").cast("double").alias("c"))
    return rounded(C.kendall(D.analytes(spark, d).join(c, "sample"), "feature", "sample", "value", "c"), "tau")


@query(f"WITH {ANALYTE} SELECT feature, sample, round((value - avg(value) OVER (PARTITION BY feature)) / stddev_pop(value) OVER (PARTITION BY feature), 6) AS z FROM analyte")
def z_scores(spark: SparkSession, d: str) -> DataFrame:
    """z-scores within brands."""
    return rounded(G.z_scores(D.analytes(spark, d), "value", "feature").drop("value"), "z").withColumn("sample", F.col("sample").cast("int"))


@query("""WITH z AS (SELECT event_type, value, (value - avg(value) OVER (PARTITION BY event_type)) / stddev_pop(value) OVER (PARTITION BY event_type) AS z FROM events)
SELECT event_type, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(avg(pow(z, 3)), 6) AS moment_3, round(avg(pow(z, 4)), 6) AS moment_4 FROM z GROUP BY 1""")
def moments(spark: SparkSession, d: str) -> DataFrame:
    """Moments of values by event type."""
    return rounded(G.moments(D.read(spark, d, "events"), "value", 4, "event_type"), "mean", "deviation", "moment_3", "moment_4")


@query(f"""WITH {ANALYTE}, m AS (SELECT feature, sample, avg(value) OVER (PARTITION BY feature) AS r, avg(value) OVER (PARTITION BY sample) AS c, stddev_pop(value) OVER (PARTITION BY feature) AS sr, stddev_pop(value) OVER (PARTITION BY sample) AS sc FROM analyte)
SELECT feature, sample, round(2 * r * c / (r + c), 2) AS mean_field, round(2 * sr * sc / (sr + sc), 2) AS std_field FROM m""")
def fields(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation fields of the brand by nation matrix."""
    x = P.mean_field(D.analytes(spark, d), "feature", "sample", "value").withColumnRenamed("field", "mean_field")
    x = P.std_field(x, "feature", "sample", "value").withColumnRenamed("field", "std_field")
    return x.select("feature", "sample", F.round("mean_field", 2).alias("mean_field"), F.round("std_field", 2).alias("std_field"))


@query(f"WITH {ANALYTE} SELECT feature, sample, round(value - avg(value) OVER (PARTITION BY feature) - avg(value) OVER (PARTITION BY sample) + avg(value) OVER (), 2) AS centered FROM analyte")
def double_center(spark: SparkSession, d: str) -> DataFrame:
    """Double centring."""
    return P.double_centered(D.analytes(spark, d), "feature", "sample", "value").select("feature", "sample", F.round("centered", 2).alias("centered"))


@query(f"""WITH {LABELLED} SELECT feature, sample, round(value - avg(value) OVER (PARTITION BY feature, region) + avg(value) OVER (PARTITION BY feature), 2) AS cleaned,
 round((sum(value) OVER (PARTITION BY feature, region) - value) / nullif(count(*) OVER (PARTITION BY feature, region) - 1, 0), 2) AS others FROM labelled""")
def block_remove(spark: SparkSession, d: str) -> DataFrame:
    """Region effects taken out, and the mean of a region's other nations."""
    x = P.group_mean_of_others(P.block_removed(D.labelled(spark, d), "feature", "region", "value"), "feature", "region", "value")
    return x.select("feature", "sample", F.round("cleaned", 2).alias("cleaned"), F.round("others", 2).alias("others"))


@query(f"""WITH {LABELLED}, h AS (SELECT feature, sample, region, CASE WHEN sample % 7 = 3 THEN NULL ELSE value END AS value FROM labelled)
SELECT feature, sample, round(coalesce(value, avg(value) OVER (PARTITION BY feature, region), avg(value) OVER (PARTITION BY feature)), 2) AS value FROM h""")
def impute_group_mean(spark: SparkSession, d: str) -> DataFrame:
    """Missing revenue filled with the region's mean."""
    x = D.labelled(spark, d).withColumn("value", F.when(F.col("sample") % 7 != 3, F.col("value")))
    return P.imputed(x, "feature", "region", "value").select("feature", "sample", F.round("value", 2).alias("value"))


@query(f"""WITH {ANALYTE}, c AS (SELECT a.feature AS i, b.feature AS j, corr(a.value, b.value) AS r FROM analyte a JOIN analyte b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2)
SELECT i, j, round(r, 6) AS r, round(sqrt(greatest(0.0, 1 - r)), 4) AS d FROM c""")
def pearson_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pearson correlation of brands over nations and the distance made of it."""
    r = P.correlations(D.analytes(spark, d), "feature", "sample", "value")
    return rounded(r, "r").join(P.correlation_distance(r), ["i", "j"])


@query(f"""WITH {ANALYTE}, k AS (SELECT feature, sample, {average_rank('value', 'feature')} AS v FROM analyte)
SELECT a.feature AS i, b.feature AS j, round(corr(a.v, b.v), 6) AS r FROM k a JOIN k b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2""")
def spearman_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Spearman correlation of brands over nations."""
    return rounded(P.correlations(D.analytes(spark, d), "feature", "sample", "value", ranked=True), "r")


@query(f"""WITH {ANALYTE} SELECT a.feature AS i, b.feature AS j, round(sum(a.value * b.value) / sqrt(sum(a.value * a.value) * sum(b.value * b.value)), 6) AS cosine FROM analyte a JOIN analyte b ON a.sample = b.sample AND a.feature < b.feature GROUP BY 1, 2""")
def associations(spark: SparkSession, d: str) -> DataFrame:
    """Cosines of brands over nations."""
    return rounded(P.cosines(D.analytes(spark, d), "feature", "sample", "value"), "cosine")


@query(f"""WITH {LABELLED}, a AS (SELECT feature, region, sum(value) AS amount FROM labelled GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY amount) AS k FROM a),
 g AS (SELECT feature, count(*) AS n, sum(amount) AS s, max(amount) AS m, sum(k * amount) AS w FROM k GROUP BY 1), x AS (SELECT *, 2 * w / (n * s) - (n + 1.0) / n AS gini FROM g)
SELECT feature, n, round(1 - s / n / m, 6) AS beta, round((n - s / m) / (n - 1), 6) AS tau, round(gini, 6) AS gini, round(gini * n / (n - 1), 6) AS gini_unbiased, round(m / s, 6) AS tsi FROM x""")
def gini_tau_tsi(spark: SparkSession, d: str) -> DataFrame:
    """Specificity of brands over regions."""
    return rounded(M.specificity(M.absolute(D.labelled(spark, d), "feature", "region", "value"), "feature"), "beta", "tau", "gini", "gini_unbiased", "tsi")


@query(f"""WITH {LABELLED}, a AS (SELECT feature, region, sum(value) AS amount FROM labelled GROUP BY 1, 2) SELECT feature, region, round(amount / sum(amount) OVER (PARTITION BY feature), 6) AS fraction FROM a""")
def composition_frac(spark: SparkSession, d: str) -> DataFrame:
    """Fractions of brands over regions."""
    return rounded(M.fractions(M.absolute(D.labelled(spark, d), "feature", "region", "value"), "feature").drop("amount"), "fraction")


@query(f"""WITH {LABELLED}, a AS (SELECT feature, region, sum(value) AS amount FROM labelled GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w AS k, sum(amount) OVER (PARTITION BY feature ORDER BY amount DESC, region ROWS UNBOUNDED PRECEDING) / sum(amount) OVER (PARTITION BY feature) AS c FROM a WINDOW w AS (PARTITION BY feature ORDER BY amount DESC, region)),
 f AS (SELECT feature, level, min(k) AS k FROM k, (SELECT unnest([0.25, 0.5, 0.75]) AS level) WHERE c >= level - 1e-10 GROUP BY 1, 2)
SELECT f.feature, CAST(f.level AS DOUBLE) AS level, string_agg(a.region, '.' ORDER BY a.region) AS labels FROM f JOIN k a ON a.feature = f.feature AND a.k <= f.k GROUP BY 1, 2""")
def composition_levels(spark: SparkSession, d: str) -> DataFrame:
    """The regions that hold a quarter, half and three quarters of a brand."""
    a = M.absolute(D.labelled(spark, d), "feature", "region", "value")
    return M.level_sets(M.cumulative_sets(a, "feature", "region"), "feature", [0.25, 0.5, 0.75])


@query("""WITH a AS (SELECT p_brand AS feature, p_size AS label, count(*)::DOUBLE AS amount FROM part GROUP BY 1, 2), k AS (SELECT *, row_number() OVER w AS k, lead(amount) OVER w AS nx FROM a WINDOW w AS (PARTITION BY feature ORDER BY amount DESC)),
 g AS (SELECT feature, max(amount) AS top, min(amount) AS low, min(CASE WHEN nx IS NOT NULL AND log2((amount + 1) / (nx + 1)) >= 0.35 THEN k END) AS f FROM k GROUP BY 1)
SELECT feature, CAST(CASE WHEN top < 3 THEN 0 WHEN f = 1 THEN 1 WHEN f > 1 THEN 2 WHEN low < 3 THEN 3 ELSE 4 END AS BIGINT) AS class FROM g""")
def group_class(spark: SparkSession, d: str) -> DataFrame:
    """Classes of brands by their counts over sizes."""
    a = D.read(spark, d, "part").groupBy(F.col("p_brand").alias("feature"), F.col("p_size").alias("label")).agg(F.count("*").cast("double").alias("amount"))
    return rounded(M.feature_classes(a, "feature", 3.0, 0.35))


@query(f"""WITH {DAILY}, v AS (SELECT *, CASE WHEN pos < count(*) OVER (PARTITION BY series_id) - 1 THEN value END AS v FROM daily)
SELECT series_id, pos, round(avg(v) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 6) AS rolling FROM v""")
def rolling_avg(spark: SparkSession, d: str) -> DataFrame:
    """Rolling averages of daily means."""
    return rounded(S.rolling_average(D.daily(spark, d), 4).drop("value"), "rolling")


@query(f"""WITH {DAILY}, x AS (SELECT series_id, pos AS p, value - avg(value) OVER (PARTITION BY series_id) AS v, count(*) OVER (PARTITION BY series_id) AS n FROM daily),
 s AS (SELECT a.series_id, l AS lag, sum(a.v * b.v) AS s FROM x a, (SELECT unnest(range(0, 400)) AS l), x b WHERE a.series_id = b.series_id AND l <= (a.n - 1) // 2 AND b.p = (a.p + l) % a.n GROUP BY 1, 2)
SELECT series_id, lag, round(s / max(CASE WHEN lag = 0 THEN s END) OVER (PARTITION BY series_id), 6) AS r FROM s""")
def autocorr(spark: SparkSession, d: str) -> DataFrame:
    """Circular autocorrelation of daily means."""
    return rounded(S.autocorrelation(D.daily(spark, d)), "r")


@query(f"""WITH {DAILY}, x AS (SELECT series_id, pos, value, lead(value) OVER (PARTITION BY series_id ORDER BY pos) AS a FROM daily)
SELECT series_id, pos, round(a + value, 6) AS total, round(a - value, 6) AS change, round((a - value) / (a + value), 6) AS contrast FROM x""")
def seq_contrast(spark: SparkSession, d: str) -> DataFrame:
    """Sums, differences and contrasts of neighbouring days."""
    return rounded(S.lagged(D.daily(spark, d)).drop("value"), "total", "change", "contrast")


@query("SELECT l_orderkey, l_linenumber, l_quantity, round(l_quantity * 0.5 * (1 + tanh((l_quantity - 10.0) / 4.0)) * sqrt(l_quantity * 10.0) / (0.5 * (10.0 + l_quantity)), 6) AS v FROM lineitem")
def soft_threshold(spark: SparkSession, d: str) -> DataFrame:
    """Low quantities suppressed."""
    x = D.read(spark, d, "lineitem")
    return x.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), "l_quantity", F.round(N.soft_threshold(F.col("l_quantity"), F.lit(10.0), F.lit(4.0)), 6).alias("v"))


@query("SELECT round(avg((l_extendedprice / 1000 - l_quantity) * (l_extendedprice / 1000 - l_quantity)), 4) AS mse, round(sum(l_extendedprice / 1000 * l_quantity) / sqrt(sum(l_extendedprice / 1000 * l_extendedprice / 1000) * sum(l_quantity * l_quantity)), 6) AS cosine FROM lineitem")
def model_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of price as a model of quantity."""
    x = D.read(spark, d, "lineitem").withColumn("m", F.col("l_extendedprice") / 1000)
    return rounded(rounded(S.errors(x, "m", "l_quantity").select("mse", "cosine"), "cosine"), "mse", places=4)


@query("""WITH w AS (SELECT DISTINCT p_name AS a, unnest(string_split(lower(p_name), ' ')) AS w FROM part), v AS (SELECT DISTINCT p_name AS b, unnest(string_split(lower(p_name), ' ')) AS w FROM part),
 s AS (SELECT a, b, count(*) AS score FROM w JOIN v USING (w) GROUP BY 1, 2) SELECT a, first(b ORDER BY score DESC, b) AS b, max(score) AS score FROM s GROUP BY 1""")
def bagscore_parts(spark: SparkSession, d: str) -> DataFrame:
    """Each part name's best match by shared words."""
    p = D.read(spark, d, "part")
    return T.best_match(p.select(F.col("p_name").alias("a")).distinct(), p.select(F.col("p_name").alias("b")).distinct(), "a", "b")


@query()
def align_score(spark: SparkSession, d: str) -> DataFrame:
    """Global alignment of part names with their type."""
    return D.read(spark, d, "part").select("p_partkey", T.global_alignment("p_name", "p_type").alias("score"))


@query("""SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_extendedprice) AS n FROM lineitem) WHERE n = 1""")
def first_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The first line of each order."""
    return E.first_per_key(D.read(spark, d, "lineitem"), "l_orderkey", "l_quantity", "l_partkey", "l_extendedprice").select("l_orderkey", "l_partkey", "l_quantity")


@query("""SELECT c_custkey, 'x' || c_nationkey || '.' || (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1) AS paired FROM customer""")
def paired_keys(spark: SparkSession, d: str) -> DataFrame:
    """Customers numbered in their nation by balance."""
    return E.numbered_keys(D.read(spark, d, "customer"), "c_nationkey", "c_acctbal", "c_custkey").select("c_custkey", F.concat(F.lit("x"), "paired").alias("paired"))


@query("SELECT n_nationkey AS n, n_nationkey IN (2, 3, 5, 7, 11, 13, 17, 19, 23) AS prime FROM nation")
def primes(spark: SparkSession, d: str) -> DataFrame:
    """Prime nation keys."""
    return D.read(spark, d, "nation").select(F.col("n_nationkey").alias("n"), N.is_prime(F.col("n_nationkey").cast("long")).alias("prime"))


_SLOPES = """WITH s AS (SELECT p_partkey AS pos, p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS r, count(*) OVER () AS n FROM part),
 k AS (SELECT pos, r, n, unnest(CASE WHEN r = 0 THEN [0, 2] WHEN r = n - 1 THEN [n - 2, n - 1] ELSE [r - 1, r, r + 1] END) AS o FROM s),
 d AS (SELECT k.pos, abs(arg_max(s.v, s.pos) - arg_min(s.v, s.pos)) / (count(*) - 1) AS slope FROM k JOIN s ON s.r = k.o GROUP BY 1)"""


@query(f"{_SLOPES}, z AS (SELECT pos, slope, (slope - avg(slope) OVER ()) / stddev_pop(slope) OVER () AS z FROM d) SELECT pos, round(slope, 4) AS slope, round({upper_tail('z')}, 6) AS p FROM z")
def rank_deriv_normal(spark: SparkSession, d: str) -> DataFrame:
    """p-values of rank derivatives of prices, by a normal distribution."""
    x = D.read(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("v"))
    return rounded(rounded(G.rank_derivative_p(x, "v", "pos", normal=True).drop("v"), "p"), "slope", places=4)


@query(f"{_SLOPES} SELECT pos, round(slope, 4) AS slope, round(exp(-slope / avg(slope) OVER ()), 6) AS p FROM d")
def rank_deriv_p(spark: SparkSession, d: str) -> DataFrame:
    """p-values of rank derivatives of prices."""
    x = D.read(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("v"))
    return rounded(rounded(G.rank_derivative_p(x, "v", "pos").drop("v"), "p"), "slope", places=4)


@query(f"""WITH a AS (SELECT p_brand AS feature, sum(p_retailprice) AS lev FROM part GROUP BY 1), z AS (SELECT *, (ln(lev) - avg(ln(lev)) OVER ()) / stddev_pop(ln(lev)) OVER () AS z FROM a)
SELECT feature, round({upper_tail('z')}, 6) AS p, round(sum(lev) OVER (ORDER BY lev DESC, feature) / sum(lev) OVER (), 6) AS rank_p FROM z""")
def leverage_p(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative leverage of brands."""
    x = D.read(spark, d, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("lev"))
    return rounded(G.leverage_p(x, "feature", "lev").select("feature", "p", "rank_p"), "p", "rank_p")


@query()
def diagonal_score(spark: SparkSession, d: str) -> DataFrame:
    """Diagonal alignment score of part names and types."""
    return D.read(spark, d, "part").select("p_partkey", T.diagonal_score("p_name", "p_type").alias("score"))
