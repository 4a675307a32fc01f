"""Registered queries of the analytics operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import laws, linalg, scalars
from ..operators import cluster, density, embed, factor, filters, groups, insights, prep, shape, stats, target, timeagg, typing
from ..sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many decimals; adding 0 turns -0 into 0."""
    return df.select(*((F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def r6(*names: str) -> str:
    return ", ".join(f"round({n.split(' AS ')[0]}, 6) + 0.0 AS {n.split(' AS ')[-1]}" for n in names)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the four measures that the factor analyses use."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_shipdate"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), (F.col("l_extendedprice") * F.col("l_discount")).alias("disc"), (F.col("l_extendedprice") * F.col("l_tax")).alias("tax"))


MEASURES = ["qty", "price", "disc", "tax"]
LINES = "li AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate, l_quantity AS qty, l_extendedprice AS price, l_extendedprice * l_discount AS disc, l_extendedprice * l_tax AS tax FROM lineitem)"
LONG = "long AS (SELECT row_number() OVER () AS i, unnest(['qty', 'price', 'disc', 'tax']) AS v, unnest([qty, price, disc, tax]) AS x FROM li)"


def key_of(df: DataFrame) -> DataFrame:
    """A row key of order lines."""
    return df.withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))


def scalar_frame(spark: SparkSession, values: dict) -> DataFrame:
    """One row of driver-side results."""
    return spark.range(1).select(*(F.lit(float(v) if isinstance(v, (float, np.floating)) else v).alias(k) for k, v in values.items()))


def named_values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return rounded(spark.createDataFrame(rows, schema))


# ---------------------------------------------------------------- typing and parsing


def _profile_sql() -> str:
    kinds = {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "t", "o_totalprice": "n", "o_orderpriority": "t"}
    part = []
    for i, (c, k) in enumerate(kinds.items()):
        num = f"count({c}), count(DISTINCT {c}), CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), bool_and({c} = floor({c}))" if k == "n" else f"CAST(0 AS BIGINT), count(DISTINCT {c}), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), false"
        part.append(f"SELECT {i} AS place, '{c}' AS \"column\", count(*) AS n, count({c}) AS present, {num} FROM orders")
    return "WITH t(place, \"column\", n, present, numeric_, uniq, lo, hi, whole) AS (" + " UNION ALL ".join(part) + ") SELECT \"column\", n, present, numeric_ AS n_numeric, uniq, " + r6("lo", "hi") + ", whole FROM t"


@query(_profile_sql())
def column_profile(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return rounded(typing.column_profile(o).select("column", "n", "present", F.col("numeric").alias("n_numeric"), "uniq", F.col("min").alias("lo"), F.col("max").alias("hi"), "whole"))


@query("""WITH s AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS u, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders)
SELECT c AS "column", CASE c WHEN 'o_orderkey' THEN CASE WHEN u = n AND a IN (0, 1) AND b - a + 1 = n THEN 'ident' ELSE 'quanti' END WHEN 'o_custkey' THEN 'quanti' WHEN 'o_totalprice' THEN 'quanti' ELSE 'quali' END AS role
FROM s, (VALUES ('o_orderkey'), ('o_custkey'), ('o_orderstatus'), ('o_totalprice'), ('o_orderpriority')) v(c)""")
def typing_roles(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return spark.createDataFrame(list(typing.detect(o).roles.items()), "column string, role string")


_TEXT = "CASE l_orderkey % 8 WHEN 0 THEN CAST(l_quantity AS VARCHAR) WHEN 1 THEN '1 ' || l_partkey || ',5' WHEN 2 THEN '€ ' || l_suppkey || ',25' WHEN 3 THEN l_linenumber || ' %' WHEN 4 THEN 'n/a' WHEN 5 THEN l_suppkey || 'f' WHEN 6 THEN '-' || l_linenumber || '.5e2' ELSE '  ' END"
_SPARK_TEXT = _TEXT.replace("VARCHAR", "STRING")


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, {_TEXT} AS s FROM lineitem),
u AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(s, '[ \\t]', '', 'g'), '^[€$£]', ''), '[€$£%]$', '') AS b FROM t),
w AS (SELECT *, replace(b, ',', '.') AS z FROM u)
SELECT l_orderkey, l_linenumber, s, round(CASE WHEN regexp_full_match(z, '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') THEN CAST(z AS DOUBLE) END, 6) + 0.0 AS x FROM w""")
def parse_numbers(spark, d):
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(_SPARK_TEXT).alias("s")).withColumn("x", scalars.parse_num(F.col("s"))))


@query(f"""WITH t AS (SELECT {_TEXT} AS s FROM lineitem)
SELECT s IS NULL OR trim(s) = '' OR (length(s) < 10 AND lower(trim(s)) IN ({", ".join(f"'{m}'" for m in scalars.MISSING_MARKERS)})) AS missing, count(*) AS n FROM t GROUP BY 1""")
def missing_markers(spark, d):
    return table(spark, d, "lineitem").select(scalars.is_missing(F.expr(_SPARK_TEXT)).alias("missing")).groupBy("missing").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, CAST(day0 AS VARCHAR) AS day FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE) ELSE CAST(o_orderdate AS DATE) END AS day0 FROM orders)""")
def parse_dates(spark, d):
    o, f = table(spark, d, "orders"), lambda p: F.date_format("o_orderdate", p)
    text = F.when(F.col("o_orderkey") % 5 == 0, f("yyyy-MM-dd'T'HH:mm")).when(F.col("o_orderkey") % 5 == 1, f("dd/MM/yyyy")).when(F.col("o_orderkey") % 5 == 2, f("yyyy/MM/dd")).when(F.col("o_orderkey") % 5 == 3, f("yyyy-MM")).otherwise(F.lit("31/02/2024"))
    return o.select("o_orderkey", scalars.parse_date(text).cast("date").cast("string").alias("day"))


@query("WITH g AS (SELECT l_quantity, l_discount, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, count(*) AS distinct_rows FROM g")
def quality_duplicates(spark, d):
    return typing.duplicate_rows(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag"), ["l_quantity", "l_discount", "l_returnflag"])


@query("SELECT CAST(l_orderkey AS VARCHAR) AS value, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, value LIMIT 5")
def repeated_ids(spark, d):
    return typing.repeated_values(table(spark, d, "lineitem"), "l_orderkey")


@query("""SELECT l_quantity, l_discount, l_returnflag, min(l_orderkey * 8 + l_linenumber) AS id FROM lineitem GROUP BY 1, 2, 3""")
def drop_duplicates(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return typing.drop_duplicates(df, ["l_quantity", "l_discount", "l_returnflag"], "id")


@query("""WITH b AS (SELECT min(year(o_orderdate) * 12 + month(o_orderdate) - 1) AS m, max(o_orderdate) AS last FROM orders)
SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS d_year, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 - m AS INTEGER) AS d_months, 'T' || quarter(o_orderdate) AS d_quarter, CAST(round(epoch(last - o_orderdate) / 86400.0) AS BIGINT) AS d_age, left(CAST(isodow(o_orderdate) AS VARCHAR), 1) AS d_day FROM orders, b""")
def derive_date(spark, d):
    o = prep.derive_date(table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("d")), "d")
    return o.select("o_orderkey", "d_year", "d_months", "d_quarter", "d_age", F.substring("d_weekday", 1, 1).alias("d_day"))


@query(f"WITH t AS (SELECT {_TEXT} AS s FROM lineitem) SELECT CAST(count(*) FILTER (WHERE s LIKE '%f') AS BIGINT) AS lost FROM t")
def retype_lost(spark, d):
    return scalar_frame(spark, {"lost": typing.retype(table(spark, d, "lineitem").select(F.expr(_SPARK_TEXT).alias("s")), "s", "numeric")[1]})


@query("WITH n AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS k FROM orders GROUP BY 1, 2) SELECT count(DISTINCT p) BETWEEN 1 AND 60 AND count(DISTINCT s) >= 2 AND bool_and(k >= 0 AND k = floor(k)) AS contingency FROM n")
def contingency_check(spark, d):
    t = table(spark, d, "orders").groupBy(F.concat(F.lit("p"), F.col("o_orderpriority")).alias("prio")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return scalar_frame(spark, {"contingency": typing.is_contingency(t, typing.detect(t))})


# ---------------------------------------------------------------- descriptions


@query(f"""WITH {LINES}, {LONG}, m AS (SELECT v, count(x) AS n, avg(x) AS mean, coalesce(stddev_samp(x), 0) AS sd, min(x) AS min, max(x) AS max, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3, skewness(x) AS skew, kurtosis(x) AS kurt, count(DISTINCT x) AS uniq FROM long GROUP BY v),
o AS (SELECT v, count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS out FROM long JOIN m USING (v) GROUP BY v)
SELECT v AS variable, n, CAST(0 AS BIGINT) AS miss, {r6("mean", "sd", "min", "q1", "med", "q3", "max", "q3 - q1 AS iqr", "skew", "kurt")}, uniq, round((skew * skew + 1) / (kurt + 3.0 * (n - 1) * (n - 1) / ((n - 2.0) * (n - 3))), 6) + 0.0 AS bc, out FROM m JOIN o USING (v)""")
def describe_numeric(spark, d):
    return rounded(stats.describe(lines(spark, d), MEASURES))


@query("SELECT o_orderpriority AS level, count(*) AS n FROM orders GROUP BY 1")
def level_counts(spark, d):
    return stats.level_counts(table(spark, d, "orders"), "o_orderpriority")


@query("WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS level, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, level LIMIT 100) SELECT level, n FROM t UNION ALL SELECT '(others)', CAST(sum(n) AS BIGINT) FROM c WHERE level NOT IN (SELECT level FROM t)")
def overflow_levels(spark, d):
    return stats.level_counts(table(spark, d, "orders"), "o_custkey", 100)


@query("SELECT unnest([0.005, 0.01, 0.25, 0.75, 0.99, 0.995]) + 0.0 AS share, round(unnest(quantile_cont(l_extendedprice, [0.005, 0.01, 0.25, 0.75, 0.99, 0.995])), 6) + 0.0 AS value FROM lineitem".replace("unnest([0.005, 0.01, 0.25, 0.75, 0.99, 0.995]) + 0.0", "CAST(unnest([0.005, 0.01, 0.25, 0.75, 0.99, 0.995]) AS DOUBLE)"))
def quantiles(spark, d):
    return rounded(stats.quantiles(table(spark, d, "lineitem"), "l_extendedprice", [0.005, 0.01, 0.25, 0.75, 0.99, 0.995]))


@query("""WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events), k AS (SELECT *, greatest(5, least(24, ceil((hi - lo) / (2 * iqr / pow(n, 1.0 / 3))))) AS k FROM s)
SELECT CAST(least(k - 1, floor((value - lo) / ((hi - lo) / k))) AS BIGINT) AS bin, count(*) AS n FROM events, k GROUP BY 1""")
def histogram_fd(spark, d):
    return stats.histogram(table(spark, d, "events"), "value")


@query("""SELECT CAST(CASE WHEN l_extendedprice < 20000 THEN 0 WHEN l_extendedprice = 80000 THEN 60 WHEN l_extendedprice > 80000 THEN 61 ELSE least(59, floor((l_extendedprice - 20000) * 60 / 60000.0)) + 1 END AS BIGINT) AS bin, count(*) AS n, count(*) FILTER (WHERE l_quantity < 10) AS n_mask FROM lineitem GROUP BY 1""")
def framed_histogram(spark, d):
    return stats.framed_histogram(table(spark, d, "lineitem"), "l_extendedprice", 20000.0, 80000.0, 60, F.col("l_quantity") < 10)


@query("SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY 1, 2")
def crosstab(spark, d):
    return stats.crosstab(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority")


@query("""WITH o AS (SELECT row_number() OVER () AS i, o_orderstatus, o_orderpriority, CAST(o_totalprice > 200000 AS VARCHAR) AS big FROM orders), l AS (SELECT i, unnest(['o_orderstatus', 'o_orderpriority', 'big']) AS v, unnest([o_orderstatus, o_orderpriority, big]) AS l FROM o)
SELECT x.v AS var_a, x.l AS level_a, y.v AS var_b, y.l AS level_b, count(*) AS n FROM l x JOIN l y USING (i) GROUP BY ALL""")
def burt_pairs(spark, d):
    return stats.burt(table(spark, d, "orders").withColumn("big", (F.col("o_totalprice") > 200000).cast("string")), ["o_orderstatus", "o_orderpriority", "big"])


@query(f"WITH {LINES}, {LONG} SELECT x.v AS a, y.v AS b, round(corr(x.x, y.x), 6) + 0.0 AS r FROM long x JOIN long y USING (i) WHERE (x.v, y.v) IN (('qty', 'price'), ('qty', 'disc'), ('qty', 'tax'), ('price', 'disc'), ('price', 'tax'), ('disc', 'tax')) GROUP BY 1, 2")
def corr_matrix(spark, d):
    return rounded(stats.correlations(lines(spark, d), MEASURES))


@query("WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS id, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rank FROM lineitem) SELECT id, CAST(rank AS DOUBLE) AS rank FROM r")
def avg_ranks(spark, d):
    return stats.with_ranks(key_of(lines(spark, d)), "qty").select("id", "rank")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS r, count(*) AS n FROM lineitem")
def pearson(spark, d):
    return rounded(stats.pearson(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) + 0.0 AS rho, count(*) AS n FROM r")
def spearman(spark, d):
    return rounded(stats.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("""WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY 1), s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS q, sum(n * v) AS w FROM g)
SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round((q - s * s / n) / (q - s * s / n + w), 6) + 0.0 AS eta2, round(((q - s * s / n) / (k - 1)) / (w / (n - k)), 6) + 0.0 AS f FROM s""")
def anova_eta2(spark, d):
    return rounded(stats.eta2(table(spark, d, "customer"), "c_acctbal", "c_mktsegment"))


_BANDS = "pb AS (SELECT CASE WHEN l_extendedprice > 70000 THEN 'high' WHEN l_extendedprice > 35000 THEN 'mid' ELSE 'low' END AS a, CASE WHEN l_extendedprice * l_discount > 3000 THEN 'x3' WHEN l_extendedprice * l_discount > 1000 THEN 'x2' ELSE 'x1' END AS b, l_linestatus AS s, l_quantity AS qty FROM lineitem)"


def bands(spark, d) -> DataFrame:
    x = F.col("l_extendedprice") * F.col("l_discount")
    return table(spark, d, "lineitem").select(F.when(F.col("l_extendedprice") > 70000, "high").when(F.col("l_extendedprice") > 35000, "mid").otherwise("low").alias("a"), F.when(x > 3000, "x3").when(x > 1000, "x2").otherwise("x1").alias("b"), F.col("l_linestatus").alias("s"), F.col("l_quantity").alias("qty"))


_CHI = "n AS (SELECT a, b, count(*) AS k FROM pb GROUP BY 1, 2), r AS (SELECT a, sum(k) AS ra FROM n GROUP BY 1), c AS (SELECT b, sum(k) AS cb FROM n GROUP BY 1), t AS (SELECT sum(k) AS total FROM n), x AS (SELECT any_value(total) AS total, any_value(total) * (sum(k * k / (ra * CAST(cb AS DOUBLE))) - 1) AS chi2, count(DISTINCT a) AS i, count(DISTINCT b) AS j FROM n JOIN r USING (a) JOIN c USING (b), t)"


@query(f"WITH {_BANDS}, {_CHI} SELECT CAST(total AS BIGINT) AS n, round(chi2, 4) + 0.0 AS chi2, (i - 1) * (j - 1) AS df, round(sqrt(chi2 / (total * (least(i, j) - 1))), 6) + 0.0 AS v FROM x")
def cramer_v(spark, d):
    return stats.cramer(bands(spark, d), "a", "b").select("n", (F.round("chi2", 4) + 0.0).alias("chi2"), "df", (F.round("v", 6) + 0.0).alias("v"))


@query("""WITH o AS (SELECT l_quantity AS x, l_extendedprice AS y, row_number() OVER (ORDER BY l_quantity, l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem)
SELECT CAST((SELECT count(*) FROM range(1, 10) t(b) WHERE k >= b * n // 10) AS BIGINT) AS slice, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, count(*) AS n FROM o GROUP BY 1""")
def decile_trend(spark, d):
    return rounded(stats.decile_trend(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"))


@query("WITH q AS (SELECT min(value) AS a, max(value) AS b, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM events) SELECT round(CASE WHEN b - a > 3 * (hi - lo) AND hi > lo THEN lo ELSE a END, 6) + 0.0 AS lo, round(CASE WHEN b - a > 3 * (hi - lo) AND hi > lo THEN hi ELSE b END, 6) + 0.0 AS hi, b - a > 3 * (hi - lo) AND hi > lo AS cut FROM q")
def robust_range(spark, d):
    return rounded(scalar_frame(spark, stats.robust_range(table(spark, d, "events"), "value")))


@query("WITH c AS (SELECT event_type AS level, count(*) AS n FROM events WHERE value > 50 OR event_id % 40 = 0 GROUP BY 1), t AS (SELECT sum(n) AS t FROM c) SELECT level, n, round(n / t, 6) + 0.0 AS share FROM c, t WHERE n < 0.5 * t")
def rare_levels(spark, d):
    return rounded(stats.rare_levels(table(spark, d, "events").where("value > 50 or event_id % 40 = 0"), "event_type", 0.5))


# ---------------------------------------------------------------- filters and preparation


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R')")
def filter_range_cats(spark, d):
    s = filters.FilterStack()
    s.put({"type": "range", "col": "l_quantity", "lo": 10, "hi": 20})
    s.put({"type": "cats", "col": "l_returnflag", "values": ["A", "R"]})
    return table(spark, d, "lineitem").where(s.predicate()).select("l_orderkey", "l_linenumber")


_STAR = [(5, 10000), (25, 90000), (45, 10000), (2, 60000), (48, 60000)]
_STAR_EDGES = ", ".join(f"({a}.0, {b}.0, {c}.0, {e}.0)" for (a, b), (c, e) in zip(_STAR, _STAR[1:] + _STAR[:1]) if b != e)


@query(f"""WITH e(a, b, c, f) AS (VALUES {_STAR_EDGES}), t AS (SELECT *, row_number() OVER () AS rn FROM lineitem), h AS (SELECT rn, l_orderkey, l_linenumber, count(*) FILTER (WHERE (b > l_extendedprice) <> (f > l_extendedprice) AND l_quantity < (c - a) * (l_extendedprice - b) / (f - b) + a) AS k FROM t, e WHERE l_quantity BETWEEN 2 AND 48 AND l_extendedprice BETWEEN 10000 AND 90000 GROUP BY 1, 2, 3)
SELECT l_orderkey, l_linenumber FROM h WHERE k % 2 = 1""")
def lasso_filter(spark, d):
    return table(spark, d, "lineitem").where(filters.polygon(F.col("l_quantity"), F.col("l_extendedprice"), _STAR)).select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n, round(sum(l_extendedprice), 2) + 0.0 AS total FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_extendedprice BETWEEN 20000 AND 40000")
def rect_filter(spark, d):
    return table(spark, d, "lineitem").where(filters.rect(F.col("l_quantity"), F.col("l_extendedprice"), 30, 10, 20000, 40000)).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("l_extendedprice"), 2) + 0.0).alias("total"))


@query("SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_discount > 0.05 THEN 'cheap' ELSE 'Autres' END AS grp, count(*) AS n FROM lineitem GROUP BY 1")
def named_groups(spark, d):
    g = filters.group_label([("small", F.col("l_quantity") < 10), ("cheap", F.col("l_discount") > 0.05)])
    return table(spark, d, "lineitem").groupBy(g.alias("grp")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) FILTER (WHERE l_quantity < 20 OR l_tax > 0.05) AS n_union, count(*) FILTER (WHERE (l_quantity < 20) <> (l_tax > 0.05)) AS n_toggle, count(*) FILTER (WHERE l_quantity < 20 AND NOT l_tax > 0.05) AS n_minus FROM lineitem")
def selection_algebra(spark, d):
    a, b = F.col("l_quantity") < 20, F.col("l_tax") > 0.05
    return table(spark, d, "lineitem").agg(F.count_if(filters.union(a, b)).alias("n_union"), F.count_if(filters.toggle(a, b)).alias("n_toggle"), F.count_if(filters.difference(a, b)).alias("n_minus"))


@query("SELECT round(avg(ln(l_extendedprice)), 6) + 0.0 AS log_price, round(avg(ln(1 + l_discount)), 6) + 0.0 AS log_disc, round(avg(sqrt(l_tax)), 6) + 0.0 AS sqrt_tax FROM lineitem")
def transforms(spark, d):
    t = prep.transform(table(spark, d, "lineitem"), {"l_extendedprice": "log", "l_discount": "log", "l_tax": "sqrt"})
    return rounded(t.agg(F.avg("l_extendedprice").alias("log_price"), F.avg("l_discount").alias("log_disc"), F.avg("l_tax").alias("sqrt_tax")))


@query("WITH m AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 6) + 0.0 AS l_quantity FROM lineitem, m")
def standardise(spark, d):
    return rounded(prep.standardise(table(spark, d, "lineitem"), ["l_quantity"]).select("l_orderkey", "l_linenumber", "l_quantity"))


_HOLES = "h AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_tax END AS tax, CASE WHEN l_orderkey % 22 = 0 OR l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS disc, CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_returnflag END AS flag, l_linestatus AS status FROM lineitem)"


def holes(spark, d) -> DataFrame:
    k = F.col("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(k % 11 != 0, F.col("l_tax")).alias("tax"), F.when((k % 22 != 0) & (k % 7 != 0), F.col("l_discount")).alias("disc"), F.when(F.col("l_partkey") % 13 != 0, F.col("l_returnflag")).alias("flag"), F.col("l_linestatus").alias("status"))


@query(f"WITH {_HOLES}, m AS (SELECT avg(tax) AS t, avg(disc) AS d FROM h WHERE tax IS NOT NULL OR disc IS NOT NULL) SELECT l_orderkey, l_linenumber, round(CASE WHEN tax IS NULL AND disc IS NULL THEN NULL ELSE coalesce(tax, t) END, 6) + 0.0 AS tax, round(CASE WHEN tax IS NULL AND disc IS NULL THEN NULL ELSE coalesce(disc, d) END, 6) + 0.0 AS disc FROM h, m")
def impute_mean(spark, d):
    return rounded(prep.impute_mean(holes(spark, d), ["tax", "disc"]).select("l_orderkey", "l_linenumber", "tax", "disc"))


@query(f"WITH {_HOLES} SELECT coalesce(flag, 'Manquant') AS flag, status, count(*) AS n FROM h GROUP BY 1, 2")
def impute_modal(spark, d):
    return prep.impute_modal(holes(spark, d), ["flag", "status"]).groupBy("flag", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_HOLES} SELECT count(*) AS n, round(avg(tax), 6) + 0.0 AS tax FROM h WHERE tax IS NOT NULL AND disc IS NOT NULL AND flag IS NOT NULL")
def drop_incomplete(spark, d):
    return rounded(prep.complete(holes(spark, d), ["tax", "disc", "flag"]).agg(F.count(F.lit(1)).alias("n"), F.avg("tax").alias("tax")))


@query()
def impute_pca(spark, d):
    k = F.col("l_orderkey")
    h = table(spark, d, "lineitem").select((k * 8 + F.col("l_linenumber")).alias("id"), F.when(k % 11 != 0, F.col("l_tax")).alias("tax"), F.when((k % 22 != 0) & (k % 7 != 0), F.col("l_discount")).alias("disc"), "l_quantity", "l_extendedprice")
    return prep.impute_pca(h, ["tax", "disc", "l_quantity", "l_extendedprice"], "id").select("id", "tax", "disc")


# ---------------------------------------------------------------- factor analyses


@query(f"""WITH {LINES}, {LONG}, r AS (SELECT x.v AS a, y.v AS b, corr(x.x, y.x) AS r FROM long x JOIN long y USING (i) GROUP BY 1, 2), r2 AS (SELECT p.a, q.b, sum(p.r * q.r) AS r FROM r p JOIN r q ON p.b = q.a GROUP BY 1, 2), r3 AS (SELECT p.a, q.b, sum(p.r * q.r) AS r FROM r2 p JOIN r q ON p.b = q.a GROUP BY 1, 2)
SELECT (SELECT round(sum(r), 6) + 0.0 FROM r WHERE a = b) AS s1, (SELECT round(sum(r), 6) + 0.0 FROM r2 WHERE a = b) AS s2, (SELECT round(sum(r), 6) + 0.0 FROM r3 WHERE a = b) AS s3""")
def pca_power_sums(spark, d):
    v = factor.pca(lines(spark, d), MEASURES).vals
    return rounded(scalar_frame(spark, {"s1": v.sum(), "s2": (v**2).sum(), "s3": (v**3).sum()}))


_Z2 = "m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp, corr(l_quantity, l_extendedprice) AS r, CASE WHEN corr(l_quantity, l_extendedprice) < 0 THEN -1 ELSE 1 END AS g, count(*) AS n FROM lineitem), z AS (SELECT l_orderkey, l_linenumber, l_returnflag, (l_quantity - mq) / sq AS a, (l_extendedprice - mp) / sp AS b, r, g, n FROM lineitem, m)"


def along(a: factor.Analysis, k: int):
    """An axis' score in the direction in which the first variable grows: two variables weigh alike, up to the sign."""
    return F.col(f"F{k + 1}") * float(np.sign(a.v[0, k]))


@query(f"WITH {_Z2} SELECT l_orderkey, l_linenumber, round((a + g * b) / sqrt(2.0), 6) + 0.0 AS F1, round((a - g * b) / sqrt(2.0), 6) + 0.0 AS F2 FROM z")
def pca2_closed_form(spark, d):
    t = table(spark, d, "lineitem")
    a = factor.pca(t, ["l_quantity", "l_extendedprice"])
    return rounded(a.scores(t).select("l_orderkey", "l_linenumber", *(along(a, k).alias(f"F{k + 1}") for k in range(2))))


@query(f"WITH {_Z2} SELECT l_orderkey, l_linenumber, round((n - 1.0) / n * (a * a + b * b - 2 * r * a * b) / (1 - r * r), 5) + 0.0 AS t2 FROM z")
def t2_mahalanobis(spark, d):
    t = table(spark, d, "lineitem")
    a = factor.pca(t, ["l_quantity", "l_extendedprice"])
    return t.select("l_orderkey", "l_linenumber", (F.round(a.t2(2), 5) + 0.0).alias("t2"))


@query("SELECT 4 AS axis_count, round(2.0 * (count(*) - 1) / count(*), 6) + 0.0 AS mean_t2 FROM lineitem")
def t2_q_means(spark, d):
    li = lines(spark, d)
    a = factor.pca(li, MEASURES, 2)
    return rounded(a.diagnose(li, 2).agg(F.lit(a.q).alias("axis_count"), F.avg("T2").alias("mean_t2")))


@query(f"WITH {_Z2} SELECT round(1 + abs(max(r)), 6) + 0.0 AS v1, round(1 - abs(max(r)), 6) + 0.0 AS v2 FROM z")
def pca_score_variance(spark, d):
    t = table(spark, d, "lineitem")
    a = factor.pca(t, ["l_quantity", "l_extendedprice"])
    return rounded(a.scores(t).agg(F.var_pop("F1").alias("v1"), F.var_pop("F2").alias("v2")))


@query(f"""WITH {LINES}, c AS (SELECT corr(qty, price) AS a, corr(qty, disc) AS b, corr(price, disc) AS c, count(*) AS n FROM li), p AS (SELECT *, pow(a - b * c, 2) / ((1 - b * b) * (1 - c * c)) + pow(b - a * c, 2) / ((1 - a * a) * (1 - c * c)) + pow(c - a * b, 2) / ((1 - a * a) * (1 - b * b)) AS partial FROM c)
SELECT round(-(n - 1 - 11.0 / 6) * ln(1 + 2 * a * b * c - a * a - b * b - c * c), 3) + 0.0 AS chi2, 3 AS df, round((a * a + b * b + c * c) / (a * a + b * b + c * c + partial), 6) + 0.0 AS kmo FROM p""")
def kmo_bartlett(spark, d):
    a = factor.pca(lines(spark, d), ["qty", "price", "disc"])
    r = linalg.kmo_bartlett(a.r, a.n)
    return scalar_frame(spark, {"chi2": round(r["chi2"], 3) + 0.0, "df": r["df"], "kmo": round(r["kmo"], 6)})


@query(f"WITH {_Z2} SELECT l_returnflag, round(avg((a + g * b) / sqrt(2.0)), 6) + 0.0 AS f1, count(*) AS n FROM z GROUP BY 1")
def group_barycentres(spark, d):
    t = table(spark, d, "lineitem")
    a = factor.pca(t, ["l_quantity", "l_extendedprice"])
    return rounded(a.scores(t, 1).groupBy("l_returnflag").agg(F.avg(along(a, 0)).alias("f1"), F.count(F.lit(1)).alias("n")))


@query(f"WITH {_BANDS}, {_CHI} SELECT round(chi2 / total, 6) + 0.0 AS phi2, (i - 1) * (j - 1) AS df FROM x")
def ca_inertia(spark, d):
    r = factor.ca(bands(spark, d), "a", "b")
    return rounded(scalar_frame(spark, {"phi2": r["vals"].sum(), "df": r["df"]}))


@query("""WITH n AS (SELECT o_totalprice > 200000 AS a, o_orderpriority AS b, count(*) AS k FROM orders GROUP BY 1, 2), c AS (SELECT b, sum(k) AS cb, sum(k) FILTER (WHERE a) AS c1 FROM n GROUP BY 1), t AS (SELECT sum(k) AS t, sum(k) FILTER (WHERE a) AS t1 FROM n)
SELECT b AS level, round(abs(c1 / cb - t1 / t) / sqrt(t1 / t * (1 - t1 / t)), 6) + 0.0 AS g FROM c, t""")
def ca_two_rows(spark, d):
    r = factor.ca(table(spark, d, "orders").withColumn("big", F.col("o_totalprice") > 200000), "big", "o_orderpriority")
    return named_values(spark, [(x, abs(float(g))) for x, g in zip(r["cols"], r["G"][:, 0], strict=True)], "level string, g double")


@query(f"""WITH pb0 AS (SELECT * FROM (WITH {_BANDS} SELECT a, s AS b FROM pb)), pb AS (SELECT CASE WHEN a = 'low' THEN 'low' ELSE 'up' END AS a, b FROM pb0), {_CHI} SELECT round((1 + sqrt(chi2 / total)) / 2, 6) + 0.0 AS l1, round((1 - sqrt(chi2 / total)) / 2, 6) + 0.0 AS l2 FROM x""")
def mca_two_variables(spark, d):
    b = bands(spark, d).select(F.when(F.col("a") == "low", "low").otherwise("up").alias("a"), "s")
    v = factor.mca(b, ["a", "s"]).vals
    return rounded(scalar_frame(spark, {"l1": v[0], "l2": v[1]}))


@query("SELECT round(1 + abs(corr(l_quantity, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)), 6) + 0.0 AS l1, round(1 - abs(corr(l_quantity, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)), 6) + 0.0 AS l2 FROM lineitem")
def famd_number_binary(spark, d):
    v = factor.famd(table(spark, d, "lineitem"), ["l_quantity"], ["l_linestatus"]).vals
    return rounded(scalar_frame(spark, {"l1": v[0], "l2": v[1]}))


@query(f"WITH {LINES}, m AS (SELECT avg(qty) AS mq, stddev_pop(qty) AS sq, avg(price) AS mp, stddev_pop(price) AS sp, CASE WHEN corr(qty, price) < 0 THEN -1 ELSE 1 END AS g FROM li) SELECT round(corr(tax, (qty - mq) / sq + g * (price - mp) / sp), 6) + 0.0 AS r1, round(corr(tax, (qty - mq) / sq - g * (price - mp) / sp), 6) + 0.0 AS r2 FROM li, m")
def supplementary_correlation(spark, d):
    li = lines(spark, d)
    a = factor.pca(li, ["qty", "price"])
    r = factor.supplementary(a, li, ["tax"])["numeric"]["tax"] * np.sign(a.v[0])
    return rounded(scalar_frame(spark, {"r1": r[0], "r2": r[1]}))


@query("WITH m AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_pop(l_extendedprice) AS sp, CASE WHEN corr(l_quantity, l_extendedprice) < 0 THEN -1 ELSE 1 END AS g FROM lineitem) SELECT p_partkey, round(((p_size - mq) / sq + g * (p_retailprice * 20 - mp) / sp) / sqrt(2.0), 6) + 0.0 AS F1 FROM part, m")
def project_new_rows(spark, d):
    a = factor.pca(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"])
    new = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("l_quantity"), (F.col("p_retailprice") * 20).alias("l_extendedprice"))
    return rounded(a.scores(new, 1).select("p_partkey", along(a, 0).alias("F1")))


@query()
def outliers_top25(spark, d):
    li = key_of(lines(spark, d))
    return factor.outliers(factor.pca(li, MEASURES, 2), li, 25, key="id").select("id", "T2", "Q", "ratio")


@query()
def horn_eigenvalues(spark, d):
    n = table(spark, d, "lineitem").count()
    return spark.createDataFrame([(k + 1, float(v)) for k, v in enumerate(factor.horn(n, 4))], "axis int, limit double")


@query()
def bootstrap_eigenvalues(spark, d):
    li = key_of(lines(spark, d))
    a = factor.pca(li, MEASURES, 2)
    b = factor.bootstrap_eigenvalues(a, li, "id")
    return spark.createDataFrame([(k + 1, float(a.vals[k]), float(b["low"][k]), float(b["high"][k])) for k in range(a.q)], "axis int, value double, low double, high double")


# ---------------------------------------------------------------- densities, groups


@query("SELECT CAST(floor((l_quantity - 0) * (25 / 51.0)) AS BIGINT) AS gx, CAST(floor((l_extendedprice - 0) * (20 / 110000.0)) AS BIGINT) AS gy, count(*) AS n, count(*) FILTER (WHERE l_discount > 0.05) AS n_selected, round(avg(l_tax), 6) + 0.0 AS mean FROM lineitem WHERE floor(l_extendedprice * (20 / 110000.0)) BETWEEN 0 AND 19 AND floor(l_quantity * (25 / 51.0)) BETWEEN 0 AND 24 GROUP BY 1, 2")
def density_grid(spark, d):
    return rounded(density.density(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), (0, 51, 0, 110000), (25, 20), F.col("l_discount") > 0.05, value=F.col("l_tax")))


@query("WITH g AS (SELECT CAST(floor(l_quantity * (25 / 51.0)) AS BIGINT) AS gx, CAST(floor(l_extendedprice * (20 / 110000.0)) AS BIGINT) AS gy, count(*) AS n FROM lineitem WHERE floor(l_extendedprice * (20 / 110000.0)) BETWEEN 0 AND 19 AND floor(l_quantity * (25 / 51.0)) BETWEEN 0 AND 24 GROUP BY 1, 2) SELECT gx, gy, n, round(cume_dist() OVER (ORDER BY n), 6) + 0.0 AS intensity FROM g")
def density_equalised(spark, d):
    return rounded(density.intensity(density.density(table(spark, d, "lineitem"), F.col("l_quantity"), F.col("l_extendedprice"), (0, 51, 0, 110000), (25, 20))))


_SEL = "l_extendedprice > 60000"


@query(f"""WITH t AS (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS c, unnest([l_quantity, l_discount, l_tax]) AS x, {_SEL} AS s FROM lineitem), g AS (SELECT c, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd, count(*) FILTER (WHERE s) AS k, avg(x) FILTER (WHERE s) AS mk FROM t GROUP BY 1)
SELECT c AS "column", k AS n_sel, {r6("mk AS mean_sel", "m AS mean_all", "(mk - m) / sd AS d")}, round((mk - m) / sqrt(sd * sd / k * (n - k) / (n - 1)), 4) + 0.0 AS v FROM g""")
def selection_numbers(spark, d):
    s = groups.selection_summary(table(spark, d, "lineitem"), F.expr(_SEL), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"])[0]
    return rounded(s.withColumn("v", F.round("v", 4)))


@query(f"""WITH t AS (SELECT unnest(['l_returnflag', 'l_linestatus']) AS c, unnest([l_returnflag, l_linestatus]) AS l, {_SEL} AS s FROM lineitem), g AS (SELECT c, l, count(*) AS n, count(*) FILTER (WHERE s) AS k FROM t GROUP BY 1, 2), u AS (SELECT *, sum(n) OVER (PARTITION BY c) AS tn, sum(k) OVER (PARTITION BY c) AS tk FROM g)
SELECT c AS "column", l AS level, k AS n_sel, {r6("k / tk AS share", "n / tn AS glob", "(k / tk) / (n / tn) AS lift")}, round((k - tk * n / tn) / sqrt(tk * (n / tn) * (1 - n / tn) * (tn - tk) / (tn - 1)), 4) + 0.0 AS v FROM u""")
def selection_levels(spark, d):
    s = groups.selection_summary(table(spark, d, "lineitem"), F.expr(_SEL), ["l_quantity"], ["l_returnflag", "l_linestatus"])[1]
    return rounded(s.withColumn("v", F.round("v", 4)))


@query("WITH g AS (SELECT count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS s2, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS k, avg(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') AS mk FROM customer) SELECT n, k, round(m, 6) + 0.0 AS m, round(mk, 6) + 0.0 AS mk, round((mk - m) / sqrt(s2 / k * (n - k) / (n - 1)), 6) + 0.0 AS v FROM g")
def test_value_numeric(spark, d):
    return rounded(stats.test_value(table(spark, d, "customer"), "c_acctbal", F.col("c_mktsegment") == "BUILDING"))


@query("WITH g AS (SELECT o_orderpriority AS l, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 200000) AS k FROM orders GROUP BY 1), t AS (SELECT sum(n) AS tn, sum(k) AS tk FROM g) SELECT 'o_orderpriority' AS \"column\", l AS level, n, k, " + r6("k / n AS clamod", "k / tk AS modcla", "n / tn AS glob") + " FROM g, t")
def level_representation(spark, d):
    return rounded(groups.level_representation(table(spark, d, "orders"), ["o_orderpriority"], F.col("o_totalprice") > 200000))


@query(f"""WITH t AS (SELECT unnest(['l_quantity', 'l_extendedprice']) AS c, unnest([l_quantity, l_extendedprice]) AS x, l_returnflag = 'R' AS a FROM lineitem), g AS (SELECT c, count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE NOT a) AS nb, avg(x) FILTER (WHERE a) AS ma, avg(x) FILTER (WHERE NOT a) AS mb, var_samp(x) FILTER (WHERE a) AS va, var_samp(x) FILTER (WHERE NOT a) AS vb FROM t GROUP BY 1)
SELECT c AS "column", na, nb, {r6("ma", "mb", "(ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d", "(ma - mb) / sqrt(va / na + vb / nb) AS t")}, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 3) + 0.0 AS df FROM g""")
def cohen_welch(spark, d):
    a = F.col("l_returnflag") == "R"
    c = groups.compare_numeric(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], a, ~a)
    return rounded(c.withColumn("df", F.round("df", 3)))


@query("SELECT 'l_linestatus' AS \"column\", l_linestatus AS level, count(*) FILTER (WHERE l_returnflag = 'R') AS ka, count(*) FILTER (WHERE l_returnflag <> 'R') AS kb FROM lineitem GROUP BY 2")
def anti_group(spark, d):
    a = F.col("l_returnflag") == "R"
    return groups.compare_levels(table(spark, d, "lineitem"), ["l_linestatus"], a, ~a)


@query("WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), b AS (SELECT l_returnflag AS grp, CAST(least(23, floor((l_extendedprice - lo) / ((hi - lo) / 24))) AS BIGINT) AS bin, count(*) AS n FROM lineitem, r GROUP BY 1, 2) SELECT grp, bin, n, round(n / sum(n) OVER (PARTITION BY grp), 6) + 0.0 AS share FROM b")
def group_histogram(spark, d):
    return rounded(groups.group_histogram(table(spark, d, "lineitem"), "l_extendedprice", F.col("l_returnflag")))


@query("WITH m AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) SELECT l_returnflag, count(*) AS n, round((avg(l_quantity) - max(m)) / max(s), 6) + 0.0 AS l_quantity FROM lineitem, m GROUP BY 1")
def group_means(spark, d):
    return rounded(groups.group_means(table(spark, d, "lineitem"), "l_returnflag", ["l_quantity"]))


# ---------------------------------------------------------------- time


@query("SELECT CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS period, count(*) AS n, round(avg(o_totalprice), 6) + 0.0 AS mean_o_totalprice, 'T' || quarter(o_orderdate) || ' ' || year(o_orderdate) AS label FROM orders GROUP BY 1, 4")
def time_aggregate(spark, d):
    return rounded(timeagg.time_aggregate(table(spark, d, "orders"), "o_orderdate", "quarter", ["o_totalprice"]))


@query("SELECT CASE WHEN date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 365.25 > 6 THEN 'year' WHEN date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) / 365.25 > 2.5 THEN 'quarter' ELSE 'month' END AS grain FROM orders")
def auto_period(spark, d):
    return scalar_frame(spark, {"grain": timeagg.auto_period(table(spark, d, "orders"), "o_orderdate")})


@query("SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS BIGINT) AS period, o_orderstatus AS class, count(*) AS n FROM orders GROUP BY 1, 2")
def class_by_period(spark, d):
    return timeagg.composition(table(spark, d, "orders"), "o_orderdate", "month", "o_orderstatus")


# ---------------------------------------------------------------- clusters

_CENTRES = np.array([[10.0, 20000.0], [25.0, 40000.0], [40.0, 70000.0]])
_D = [f"pow(l_quantity - {a}, 2) + pow(l_extendedprice - {b}, 2)" for a, b in _CENTRES.tolist()]
_NEAREST = f"CASE WHEN {_D[0]} <= {_D[1]} AND {_D[0]} <= {_D[2]} THEN 0 WHEN {_D[1]} <= {_D[2]} THEN 1 ELSE 2 END"


@query(f"SELECT CAST({_NEAREST} AS INTEGER) AS k, count(*) AS n FROM lineitem GROUP BY 1")
def nearest_centre(spark, d):
    return table(spark, d, "lineitem").groupBy(cluster.nearest_centre([F.col("l_quantity"), F.col("l_extendedprice")], _CENTRES).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT CAST({_NEAREST} AS INTEGER) AS k, round(avg(l_quantity), 6) + 0.0 AS l_quantity, round(avg(l_extendedprice), 4) + 0.0 AS l_extendedprice FROM lineitem GROUP BY 1")
def kmeans_step(spark, d):
    c = cluster.consolidate(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], _CENTRES, 1)
    return spark.createDataFrame([(k, round(float(a), 6), round(float(b), 4)) for k, (a, b) in enumerate(c)], "k int, l_quantity double, l_extendedprice double")


@query(f"WITH m AS (SELECT avg(l_tax) AS m, stddev_pop(l_tax) AS s FROM lineitem) SELECT CAST({_NEAREST} AS INTEGER) AS k, count(*) AS n, round((avg(l_tax) - max(m)) / max(s), 6) + 0.0 AS l_tax FROM lineitem, m GROUP BY 1")
def class_profiles(spark, d):
    t = table(spark, d, "lineitem")
    return rounded(cluster.class_profiles(t.withColumn("k", cluster.nearest_centre([F.col("l_quantity"), F.col("l_extendedprice")], _CENTRES)), "k", ["l_tax"]))


@query("""WITH v AS (SELECT s_suppkey AS i, s_nationkey % 3 AS l, s_acctbal AS x FROM supplier ORDER BY s_suppkey LIMIT 1500), p AS (SELECT a.i, a.l AS la, b.l AS lb, abs(a.x - b.x) AS d FROM v a JOIN v b ON a.i <> b.i), m AS (SELECT i, la, avg(d) FILTER (WHERE la = lb) AS a, lb, avg(d) AS b FROM p GROUP BY i, la, lb), s AS (SELECT i, max(a) AS a, min(b) FILTER (WHERE la <> lb) AS b FROM m GROUP BY i)
SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) + 0.0 AS silhouette FROM s""")
def silhouette_sample(spark, d):
    p = table(spark, d, "supplier").orderBy("s_suppkey").select("s_nationkey", "s_acctbal").limit(cluster.SILHOUETTE_ROWS).toPandas()
    s = cluster.silhouette(p[["s_acctbal"]].to_numpy(), p["s_nationkey"].to_numpy() % 3)
    return scalar_frame(spark, {"silhouette": round(s, 6) + 0.0})


@query()
def hcpc(spark, d):
    li = key_of(lines(spark, d))
    rows = factor.pca(li, MEASURES, 3).scores(li, 3)
    return cluster.hcpc(rows, ["F1", "F2", "F3"], "id").assign(rows).select("id", "class")


@query()
def paragons(spark, d):
    li = key_of(lines(spark, d))
    rows = factor.pca(li, MEASURES, 3).scores(li, 3)
    c = cluster.hcpc(rows, ["F1", "F2", "F3"], "id", 3)
    return cluster.paragons(rows, c, key="id")[0].select("id", "class", "rank", "own")


@query("SELECT count(*) AS n, round(var_pop(s_acctbal), 3) + 0.0 AS inertia FROM (SELECT s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 1200)")
def ward_inertia(spark, d):
    """The heights of Ward's tree add up to the inertia."""
    x = table(spark, d, "supplier").orderBy("s_suppkey").select("s_acctbal").limit(cluster.WARD_ROWS).toPandas().to_numpy(float)
    return scalar_frame(spark, {"n": len(x), "inertia": round(sum(h for _, _, h, _ in cluster.ward(x)), 3) + 0.0})


# ---------------------------------------------------------------- supervised


@query("""WITH g AS (SELECT o_orderpriority AS l, count(*) FILTER (WHERE o_orderstatus = 'F') AS e, count(*) FILTER (WHERE o_orderstatus <> 'F') AS ne FROM orders GROUP BY 1), t AS (SELECT sum(e) AS E, sum(ne) AS N, count(*) AS g FROM g), p AS (SELECT (g.e + 0.5) / (t.E + 0.5 * t.g) AS pe, (g.ne + 0.5) / (t.N + 0.5 * t.g) AS pn FROM g, t)
SELECT round(sum((pe - pn) * ln(pe / pn)), 6) + 0.0 AS iv FROM p""".replace("t AS (SELECT sum(e) AS E, sum(ne) AS N, count(*) AS g FROM g)", "t AS (SELECT sum(e) AS te, sum(ne) AS tn, count(*) AS tg FROM g)").replace("t.E", "te").replace("t.N", "tn").replace("t.g", "tg").replace("g.e", "e").replace("g.ne", "ne"))
def iv_levels(spark, d):
    o = table(spark, d, "orders")
    by = target.target_by_level(o, "o_orderpriority", (F.col("o_orderstatus") == "F").cast("double"))
    return rounded(target.iv_of(by.select("e", (F.col("n") - F.col("e")).alias("ne"))))


_DECILES = "q AS (SELECT list_distinct(quantile_cont(n_chars, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS cuts FROM documents JOIN labels USING (doc_id)), b AS (SELECT len(list_filter(cuts, lambda c: n_chars > c)) AS bin, n_chars, quality FROM documents JOIN labels USING (doc_id), q)"


@query(f"WITH {_DECILES}, g AS (SELECT bin, sum(quality) AS e, count(*) - sum(quality) AS ne FROM b GROUP BY 1), t AS (SELECT sum(e) AS te, sum(ne) AS tn, count(*) AS tg FROM g), p AS (SELECT (e + 0.5) / (te + 0.5 * tg) AS pe, (ne + 0.5) / (tn + 0.5 * tg) AS pn FROM g, t) SELECT round(sum((pe - pn) * ln(pe / pn)), 6) + 0.0 AS iv FROM p")
def iv_deciles(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    by = target.target_by_decile(x, "n_chars", F.col("quality").cast("double"))
    return rounded(target.iv_of(by.select("e", (F.col("n") - F.col("e")).alias("ne"))))


@query(f"WITH {_DECILES} SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(avg(quality), 6) + 0.0 AS mean, CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi, CAST(sum(quality) AS DOUBLE) AS e FROM b GROUP BY 1")
def target_by_decile(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rounded(target.target_by_decile(x, "n_chars", F.col("quality").cast("double")))


@query("""WITH r AS (SELECT quality, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM documents JOIN labels USING (doc_id)), s AS (SELECT sum(r) FILTER (WHERE quality = 1) AS r1, CAST(sum(quality) AS DOUBLE) AS n1, count(*) AS n FROM r)
SELECT round((r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)), 6) + 0.0 AS auc, round(2 * (r1 - n1 * (n1 + 1) / 2) / (n1 * (n - n1)) - 1, 6) + 0.0 AS gini, n FROM s""")
def auc(spark, d):
    return rounded(target.auc(table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id"), "n_chars", F.col("quality").cast("double")))


@query("""WITH t AS (SELECT CAST(o_orderstatus = 'F' AS INTEGER) AS y, unnest(['o_totalprice', 'copy']) AS c, unnest([o_totalprice, CAST(o_orderstatus = 'F' AS INTEGER) * 2.0 + 1]) AS x FROM orders), r AS (SELECT c, y, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / 2.0 AS r FROM t), a AS (SELECT c, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auc FROM r GROUP BY 1)
SELECT c AS "column", greatest(auc, 1 - auc) >= 0.95 AS leak FROM a""")
def leak_flags(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_totalprice").withColumn("copy", F.col("y") * 2.0 + 1)
    return spark.createDataFrame([(r["column"], bool(r["leak"])) for r in target.importance(o, target.target_spec(o, "y"), ["o_totalprice", "copy"])], "column string, leak boolean")


@query()
def cart_leaves(spark, d):
    o = table(spark, d, "lineitem").select((F.col("l_extendedprice") * F.col("l_discount") > 2000).cast("int").alias("y"), "l_extendedprice", "l_discount", "l_returnflag")
    spec = target.target_spec(o, "y")
    return target.leaf_table(o, spec, target.cart(o, spec, ["l_extendedprice", "l_discount", "l_returnflag"]))


# ---------------------------------------------------------------- shapes and projections


def small_points(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y"))


@query("""WITH v AS (SELECT s_suppkey AS i, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier), p AS (SELECT sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d, sqrt(pow(a.x - b.x, 2)) AS e FROM v a JOIN v b ON a.i < b.i) SELECT count(*) AS pairs, round(sum(e * e) / sum(d * d), 6) + 0.0 AS kept, round(corr(d, e), 6) + 0.0 AS r FROM p""")
def pairwise_shepard(spark, d):
    return rounded(embed.shepard(small_points(spark, d), ["x", "y"], ["x"], "id"))


@query("""WITH v AS (SELECT s_suppkey AS i, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier), p AS (SELECT a.i AS i, b.i AS j, abs(a.x - b.x) AS a, abs(a.y - b.y) AS b FROM v a, v b), c AS (SELECT a - avg(a) OVER (PARTITION BY i) - avg(a) OVER (PARTITION BY j) + avg(a) OVER () AS a, b - avg(b) OVER (PARTITION BY i) - avg(b) OVER (PARTITION BY j) + avg(b) OVER () AS b FROM p) SELECT round(sqrt(sum(a * b) / sqrt(sum(a * a) * sum(b * b))), 6) + 0.0 AS dcor FROM c""")
def dcor_sample(spark, d):
    return rounded(shape.dcor_table(small_points(spark, d), "x", "y", "id"))


@query("""WITH v AS (SELECT s_suppkey AS i, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier), p AS (SELECT a.i AS i, b.i AS j, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS d FROM v a JOIN v b ON a.i <> b.i), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM p) SELECT i, j, round(d, 6) + 0.0 AS distance, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 3""")
def nearest_rows(spark, d):
    return rounded(embed.nearest_rows(small_points(spark, d), ["x", "y"], "id", 3))


@query()
def scagnostics(spark, d):
    li = key_of(lines(spark, d))
    names = ["monotonic", "outlying", "skewed", "clumpy", "striated", "stringy"]
    return spark.createDataFrame([(r["a"], r["b"], *(float(r[n]) for n in names)) for r in shape.scan_pairs(li, MEASURES, "id")], "a string, b string, " + ", ".join(f"{n} double" for n in names))


def _vectors(spark, d, rows: int):
    p = table(spark, d, "embeddings").orderBy(F.xxhash64("vec_id"), "vec_id").limit(rows).toPandas()
    return p["vec_id"].tolist(), np.stack(p["embedding"].to_numpy()).astype(float)


@query()
def tsne(spark, d):
    ids, x = _vectors(spark, d, embed.TSNE_ROWS)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in zip(ids, embed.tsne(x), strict=True)], "vec_id long, x double, y double")


@query()
def umap(spark, d):
    ids, x = _vectors(spark, d, embed.UMAP_ROWS)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in zip(ids, embed.umap(x), strict=True)], "vec_id long, x double, y double")


@query(f"""WITH v AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS h, CAST(embedding[1:8] AS DOUBLE[]) AS l FROM embeddings ORDER BY vec_id LIMIT {embed.TRUST_ROWS}),
p AS (SELECT a.i AS i, row_number() OVER (PARTITION BY a.i ORDER BY list_distance(a.h, b.h), b.i) AS rh, row_number() OVER (PARTITION BY a.i ORDER BY list_distance(a.l, b.l), b.i) AS rl FROM v a JOIN v b ON a.i <> b.i),
s AS (SELECT count(*) AS n, CAST(least(greatest((count(*) - 1) // 4, 3), 10) AS BIGINT) AS k FROM v)
SELECT round(1 - 2.0 / (max(n) * max(k) * (2 * max(n) - 3 * max(k) - 1)) * coalesce(sum(rh - k) FILTER (WHERE rl <= k AND rh > k), 0), 6) + 0.0 AS trust, round(1 - 2.0 / (max(n) * max(k) * (2 * max(n) - 3 * max(k) - 1)) * coalesce(sum(rl - k) FILTER (WHERE rh <= k AND rl > k), 0), 6) + 0.0 AS continuity, round(CAST(count(*) FILTER (WHERE rh <= k AND rl <= k) AS DOUBLE) / (max(n) * max(k)), 6) + 0.0 AS overlap FROM p, s""")
def trust_of_projection(spark, d):
    p = table(spark, d, "embeddings").orderBy("vec_id").limit(embed.TRUST_ROWS).toPandas()
    x = np.stack(p["embedding"].to_numpy()).astype(float)
    q = embed.neighbourhood_quality(x, x[:, :8])
    return rounded(scalar_frame(spark, {k: q[k] for k in ("trust", "continuity", "overlap")}))


@query()
def automatic_insights(spark, d):
    li = key_of(lines(spark, d))
    found = insights.build(factor.pca(li, MEASURES, 2), li, key="id", colour="l_linestatus", texts=["l_returnflag", "l_linestatus"])
    return spark.createDataFrame([(x["kind"], x["score"], x["text"]) for x in found], "kind string, score double, text string")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row_id FROM orders")
def numbered_rows(spark, d):
    return writers.numbered(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", F.col("row_id").cast("long").alias("row_id"))


@query("WITH c AS (SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1) SELECT l_orderkey, l_linenumber, copies FROM lineitem JOIN c USING (l_orderkey)")
def repeated_rows(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return writers.repeated_rows(t, ["l_orderkey"], "id").select("l_orderkey", "l_linenumber", "copies")


@query()
def hash_sample(spark, d):
    return writers.sample(key_of(lines(spark, d)), "id", 500).select("id", "qty", "price")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Principal components of the order lines: mean scores and the share of outliers by return flag."""
    li = lines(spark, sf_dir)
    a = factor.pca(li, MEASURES, 2)
    rows = a.diagnose(a.scores(li, 2), 2)
    return rounded(rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("F1").alias("f1"), F.avg("F2").alias("f2"), F.avg(F.col("outlier").cast("int")).alias("outliers")))


QUERIES["pca_by_flag"] = flagship

from . import checks  # noqa: E402, F401  registers its queries
