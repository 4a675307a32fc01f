"""Registered queries of single parts: laws, small matrices, readers, selections, axes and insights, with their oracles."""

from __future__ import annotations

import json
import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import laws, linalg, scalars, text
from ..operators import cluster, density, embed, factor, filters, groups, insights, prep, shape, stats, target, typing, views
from ..sources import readers, writers
from .api import Engine
from .registry import _CENTRES, _D, _NEAREST, _Z2, LINES, MEASURES, along, key_of, lines, query, rounded, scalar_frame, table
from .spec import AnalysisSpec, History

PAIR = ["l_quantity", "l_extendedprice"]


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return rounded(spark.createDataFrame(rows, schema), 9)


def pair_pca(spark: SparkSession, d: str) -> tuple[DataFrame, factor.Analysis]:
    t = table(spark, d, "lineitem")
    return t, factor.pca(t, PAIR)


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share, or, in one process, a local one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext._jsc.sc().isLocal():
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{(named or tempfile.gettempdir()).rstrip('/')}/tables-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- probability laws


@query("WITH p AS (SELECT k, x, x / 2.0 AS h FROM (VALUES (2), (4), (10), (30)) k(k), (VALUES (0.5), (3.84), (12.3), (40.0)) x(x)) SELECT CAST(k AS BIGINT) AS k, CAST(x AS DOUBLE) AS x, round(exp(-h) * list_sum(list_transform(range(k // 2), lambda i: pow(h, i) / factorial(CAST(i AS INTEGER)))), 9) + 0.0 AS p FROM p")
def law_chi2_sf(spark, d):
    return frame(spark, [(k, x, laws.chi2_sf(x, k)) for k in (2, 4, 10, 30) for x in (0.5, 3.84, 12.3, 40.0)], "k long, x double, p double")


@query("SELECT CAST(p AS DOUBLE) AS p, round(-2 * ln(1 - p), 9) + 0.0 AS x FROM (VALUES (0.001), (0.05), (0.5), (0.95), (0.999)) t(p)")
def law_chi2_inv(spark, d):
    return frame(spark, [(p, laws.chi2_inv(p, 2)) for p in (0.001, 0.05, 0.5, 0.95, 0.999)], "p double, x double")


@query("WITH p AS (SELECT * FROM (VALUES (2, 3), (5, 5), (1, 8), (12, 4)) t(a, b), (VALUES (0.1), (0.35), (0.8)) x(x)) SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(x AS DOUBLE) AS x, round(list_sum(list_transform(range(a, a + b), lambda j: exp(lgamma(a + b) - lgamma(j + 1) - lgamma(a + b - j)) * pow(x, j) * pow(1 - x, a + b - 1 - j))), 9) + 0.0 AS p FROM p")
def law_beta_cdf(spark, d):
    """With whole parameters it is a tail of the binomial law."""
    return frame(spark, [(a, b, x, laws.beta_cdf(a, b, x)) for a, b in ((2, 3), (5, 5), (1, 8), (12, 4)) for x in (0.1, 0.35, 0.8)], "a long, b long, x double, p double")


@query("SELECT CAST(p AS DOUBLE) AS p, CAST(b AS DOUBLE) AS b, round(1 - pow(1 - p, 1 / b), 9) + 0.0 AS first, round(pow(p, 1 / b), 9) + 0.0 AS second FROM (VALUES (0.01), (0.5), (0.95), (0.99)) t(p), (VALUES (1.5), (4.0), (45.5)) u(b)")
def law_beta_inv(spark, d):
    return frame(spark, [(p, b, laws.beta_inv(p, 1, b), laws.beta_inv(p, b, 1)) for p in (0.01, 0.5, 0.95, 0.99) for b in (1.5, 4.0, 45.5)], "p double, b double, first double, second double")


_SIMPSON = "list_sum(list_transform(range(2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(z * i / 2000.0, 2) / 2))) * z / 6000.0 / sqrt(2 * pi())"


@query(f"SELECT CAST(z AS DOUBLE) AS z, round(0.5 - {_SIMPSON}, 9) + 0.0 AS sf, round(0.5 + {_SIMPSON}, 9) + 0.0 AS cdf FROM (VALUES (-3.1), (-1.0), (0.0), (0.7), (1.96), (4.2)) t(z)")
def law_normal(spark, d):
    """Against Simpson's rule."""
    return frame(spark, [(z, laws.norm_sf(z), laws.norm_cdf(z)) for z in (-3.1, -1.0, 0.0, 0.7, 1.96, 4.2)], "z double, sf double, cdf double")


@query(f"SELECT round(0.5 + {_SIMPSON}, 9) + 0.0 AS p, CAST(z AS DOUBLE) AS z FROM (VALUES (-3.1), (-1.0), (0.7), (1.96), (2.6)) t(z)")
def law_normal_inv(spark, d):
    """Probabilities by Simpson's rule; the quantile of each is the place where the integral ends."""
    points = (-3.1, -1.0, 0.7, 1.96, 2.6)
    p = [0.5 + sum((1 if i in (0, 2000) else 4 if i % 2 else 2) * math.exp(-((z * i / 2000) ** 2) / 2) for i in range(2001)) * z / 6000 / math.sqrt(2 * math.pi) for z in points]
    return spark.createDataFrame([(round(x, 9), round(laws.norm_inv(x), 6) + 0.0) for x in p], "p double, z double")


@query("SELECT CAST(f AS DOUBLE) AS f, CAST(n AS DOUBLE) AS n, round(pow(1 + 2 * f / n, -n / 2), 9) + 0.0 AS p FROM (VALUES (0.3), (1.0), (4.5), (20.0)) t(f), (VALUES (1.0), (7.0), (120.0)) u(n)")
def law_f_sf(spark, d):
    return frame(spark, [(f, n, laws.f_sf(f, 2, n)) for f in (0.3, 1.0, 4.5, 20.0) for n in (1.0, 7.0, 120.0)], "f double, n double, p double")


@query("SELECT CAST(t AS DOUBLE) AS t, round(1 - 2 * atan(t) / pi(), 9) + 0.0 AS one, round(1 - t / sqrt(2 + t * t), 9) + 0.0 AS two FROM (VALUES (0.1), (1.0), (2.5), (12.0)) v(t)")
def law_t_sf(spark, d):
    return frame(spark, [(t, laws.t_sf2(t, 1), laws.t_sf2(t, 2)) for t in (0.1, 1.0, 2.5, 12.0)], "t double, one double, two double")


_HYPER = [(7, 50, 12, 20), (2, 50, 12, 20), (40, 600, 120, 150), (0, 30, 5, 6)]


@query(f"""WITH p(x, n, m, k) AS (VALUES {", ".join(map(str, _HYPER))}), q AS (SELECT *, list_transform(range(greatest(0, k + m - n), least(k, m) + 1), lambda j: struct_pack(j := j, p := exp(lgamma(m + 1) - lgamma(j + 1) - lgamma(m - j + 1) + lgamma(n - m + 1) - lgamma(k - j + 1) - lgamma(n - m - k + j + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1)))) AS all_ FROM p)
SELECT CAST(x AS BIGINT) AS x, CAST(n AS BIGINT) AS n, round(coalesce(list_sum(list_transform(list_filter(all_, lambda s: s.j >= x), lambda s: s.p)), 0), 9) + 0.0 AS upper, round(coalesce(list_sum(list_transform(list_filter(all_, lambda s: s.j <= x), lambda s: s.p)), 0), 9) + 0.0 AS lower FROM q""")
def law_hypergeometric(spark, d):
    return frame(spark, [(x, n, laws.hyper_tail(x, n, m, k, True), laws.hyper_tail(x, n, m, k, False)) for x, n, m, k in _HYPER], "x long, n long, upper double, lower double")


@query("SELECT o_orderkey, round(lgamma(o_totalprice / 1000.0 + 0.5), 6) + 0.0 AS g, round(lgamma(61.0) - lgamma(o_custkey % 60 + 1.0) - lgamma(61.0 - o_custkey % 60), 6) + 0.0 AS choose FROM orders WHERE o_orderkey % 100 = 0")
def law_gamma_log(spark, d):
    rows = table(spark, d, "orders").where("o_orderkey % 100 = 0").select("o_orderkey", "o_totalprice", "o_custkey").collect()
    return rounded(spark.createDataFrame([(r[0], math.lgamma(r[1] / 1000 + 0.5), laws.log_choose(60, r[2] % 60)) for r in rows], "o_orderkey long, g double, choose double"))


# ---------------------------------------------------------------- small matrices

_R3 = f"{LINES}, c AS (SELECT corr(qty, price) AS a, corr(qty, disc) AS b, corr(price, disc) AS c, count(*) AS n FROM li)"


@query(f"""WITH {_R3}, p AS (SELECT a, b, c, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM c)
SELECT 'qty' AS x, round((1 - c * c) / det, 6) + 0.0 AS vif, round((b - a * c) / sqrt((1 - a * a) * (1 - c * c)), 6) + 0.0 AS with_disc FROM p UNION ALL SELECT 'price', round((1 - b * b) / det, 6) + 0.0, round((c - a * b) / sqrt((1 - a * a) * (1 - b * b)), 6) + 0.0 FROM p""")
def partial_and_vif(spark, d):
    r = factor.pca(lines(spark, d), ["qty", "price", "disc"]).r
    p, v = linalg.partial_correlation(r), shape.vif(r)
    return rounded(spark.createDataFrame([("qty", float(v[0]), float(p[0, 2])), ("price", float(v[1]), float(p[1, 2]))], "x string, vif double, with_disc double"))


@query(f"""WITH {_R3}, e AS (SELECT 'price' AS x, 'disc' AS y, c AS r, (c - a * b) / sqrt((1 - a * a) * (1 - b * b)) AS p FROM c UNION ALL SELECT 'qty', 'price', a, (a - b * c) / sqrt((1 - b * b) * (1 - c * c)) FROM c UNION ALL SELECT 'qty', 'disc', b, (b - a * c) / sqrt((1 - a * a) * (1 - c * c)) FROM c)
SELECT 'raw' AS kind, x, y, round(r, 6) + 0.0 AS r FROM e WHERE abs(r) >= 0.3 UNION ALL SELECT 'partial', x, y, round(p, 6) + 0.0 FROM e WHERE abs(p) >= 0.3""")
def correlation_network(spark, d):
    n = shape.network(factor.pca(lines(spark, d), ["qty", "price", "disc"]).r, ["qty", "price", "disc"])
    return rounded(spark.createDataFrame([(k, x, y, float(r)) for k in ("raw", "partial") for (x, y), r in n[k].items()], "kind string, x string, y string, r double"))


@query(f"WITH {LINES} SELECT round(var_pop(qty) / (var_pop(qty) + var_pop(disc)), 9) + 0.0 AS first, CAST(1.0 AS DOUBLE) AS both_ FROM li")
def inertia_of_frames(spark, d):
    _, _, sd, r = stats_of(spark, d, ["qty", "disc"])
    cov = r * np.outer(sd, sd)
    return scalar_frame(spark, {"first": round(linalg.projected_inertia(cov, np.eye(2)[:, :1]), 9), "both_": round(linalg.projected_inertia(cov, np.eye(2)), 9)})


def stats_of(spark: SparkSession, d: str, columns: list[str]):
    return factor.moments(lines(spark, d), columns)


@query("WITH v AS (SELECT list(n ORDER BY n DESC) AS v FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey)) SELECT 1 + list_min(list_filter(range(1, len(v) - 1), lambda k: v[k + 1] - v[k + 2] = list_max(list_transform(range(1, len(v) - 1), lambda j: v[j + 1] - v[j + 2])))) AS elbow FROM v")
def elbow_of_counts(spark, d):
    v = sorted((r["count"] for r in table(spark, d, "customer").groupBy("c_nationkey").count().collect()), reverse=True)
    return scalar_frame(spark, {"elbow": linalg.elbow(v)})


# ---------------------------------------------------------------- scalars


@query("SELECT o_orderkey, CASE WHEN x = 0 THEN 0.0 ELSE round(x * pow(10.0, 3 - floor(log10(abs(x))))) / pow(10.0, 3 - floor(log10(abs(x)))) END + 0.0 AS s FROM (SELECT o_orderkey, o_totalprice * CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -0.001 END AS x FROM orders)")
def significant_digits(spark, d):
    x = F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-0.001))
    return table(spark, d, "orders").select("o_orderkey", (scalars.significant(x, 4) + 0.0).alias("s"))


@query("WITH s AS (SELECT c_nationkey, max(c_acctbal) / 7 AS x FROM customer GROUP BY 1 HAVING max(c_acctbal) > 0), p AS (SELECT *, pow(10.0, floor(log10(x))) AS p FROM s) SELECT c_nationkey, CASE WHEN x <= p THEN p WHEN x <= 2 * p THEN 2 * p WHEN x <= 5 * p THEN 5 * p ELSE 10 * p END AS step FROM p")
def nice_steps(spark, d):
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg((F.max("c_acctbal") / 7).alias("x")).where("x > 0").collect()
    return spark.createDataFrame([(r[0], scalars.nice_step(r[1])) for r in rows], "c_nationkey int, step double")


@query("WITH t AS (SELECT count(*) AS n FROM embeddings) SELECT least(greatest((n - 1) // 4, 3), 10) AS k FROM t")
def neighbours_compared(spark, d):
    return scalar_frame(spark, {"k": embed.trust_k(table(spark, d, "embeddings").count())})


@query("SELECT round(min(s_acctbal) - greatest(0, (max(s_nationkey) - min(s_nationkey)) - (max(s_acctbal) - min(s_acctbal))) / 2, 6) + 0.0 AS x0, round((min(s_nationkey) + max(s_nationkey)) / 2.0 - (max(s_acctbal) - min(s_acctbal)) / 2, 6) + 0.0 AS y0 FROM supplier")
def one_scale(spark, d):
    r = table(spark, d, "supplier").agg(F.min("s_acctbal"), F.max("s_acctbal"), F.min("s_nationkey"), F.max("s_nationkey")).first()
    x, y = density.square_frame((r[0], r[1]), (r[2], r[3]))
    return rounded(scalar_frame(spark, {"x0": x[0], "y0": y[0]}))


# ---------------------------------------------------------------- readers and settings


@query("SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def csv_round_trip(spark, d):
    place = scratch(spark)
    writers.export_rows(table(spark, d, "nation").coalesce(1), place)
    return readers.read(spark, place)


@query("SELECT CAST(r_regionkey AS DOUBLE) AS r_regionkey, r_name FROM region")
def json_round_trip(spark, d):
    place = f"{scratch(spark)}.json"
    rows = table(spark, d, "region")
    rows.agg(F.to_json(F.struct(F.collect_list(F.struct("r_regionkey", "r_name")).alias("rows"))).alias("value")).coalesce(1).write.text(place)
    return readers.read(spark, place).select("r_regionkey", "r_name")


@query("SELECT vec_id, label FROM embeddings")
def parquet_in_bulk(spark, d):
    return readers.read_parquet(spark, f"{d}/embeddings.parquet", bulk=True)


@query("SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_totalprice FROM orders")
def parquet_in_rows(spark, d):
    return readers.read(spark, f"{d}/orders.parquet").select("o_orderkey", "o_orderdate", "o_totalprice")


@query("SELECT r_name AS name, CAST(r_regionkey AS DOUBLE) AS key, CASE WHEN r_regionkey = 3 THEN 'late' END AS more FROM region")
def rows_from_objects(spark, d):
    rows = [{"name": r["r_name"], "key": r["r_regionkey"]} | ({"more": "late"} if r["r_regionkey"] == 3 else {}) for r in table(spark, d, "region").collect()]
    return Engine(spark).load_rows(rows).table


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey + 0.5 END AS \"Colonne 2\", CAST(n_regionkey AS DOUBLE) AS \"name (2)\" FROM nation")
def rows_from_matrix(spark, d):
    """Repeated and empty headers, decimal commas, missing markers."""
    rows = table(spark, d, "nation").collect()
    return readers.from_matrix(spark, [["name", " ", "name"], *([r["n_name"], "n/a" if r["n_nationkey"] % 5 == 0 else f"{r['n_nationkey']},5", r["n_regionkey"]] for r in rows), [None, "", ""]])


@query("SELECT * FROM (VALUES (';', true, 25), ('\t', false, 25), ('|', true, 25), (',', false, 25)) t(delimiter, comma, fields)")
def sniffed_formats(spark, d):
    out = []
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    for sep, comma in ((";", True), ("\t", False), ("|", True), (",", False)):
        text = "name" + sep + "x\n" + "\n".join(f'"{r["n_name"]}{sep}"{sep}{r["n_nationkey"]}{"," if comma else "."}5' for r in rows)
        s = readers.sniff(text.encode())
        out.append((s["delimiter"], s["decimal_comma"], sum(len(readers.fields_of(x, s["delimiter"])) == 2 for x in text.splitlines()[1:])))
    return spark.createDataFrame(out, "delimiter string, comma boolean, fields int")


@query("SELECT 'PCA' AS method, string_agg(column_name, ',' ORDER BY column_index) AS vars, 'o_orderstatus' AS color FROM (SELECT * FROM duckdb_columns() WHERE table_name = 'orders') WHERE column_name IN ('o_custkey', 'o_totalprice')")
def settings_link(spark, d):
    """Settings that go through a link, a change, an undo and a redo."""
    h = History(AnalysisSpec.from_link(AnalysisSpec(method="PCA", vars=("o_custkey", "o_totalprice", "gone"), color="o_orderstatus").to_link()))
    h.put(h.now.pruned(table(spark, d, "orders").columns))
    h.put(h.now.with_role("o_custkey", "illustrative"))
    h.undo(), h.redo(), h.undo()
    return scalar_frame(spark, {"method": h.now.method, "vars": ",".join(h.now.vars), "color": h.now.color})


@query("SELECT * FROM (VALUES ('o_orderkey', 'skip'), ('o_custkey', 'num'), ('o_orderstatus', 'cat'), ('o_totalprice', 'num'), ('o_orderpriority', 'cat')) t(name, role)")
def bulk_roles(spark, d):
    """The key counts up from 0; statuses and priorities have a few levels."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return spark.createDataFrame([(c, r) for c, (r, _) in typing.detect_big(o).items()], "name string, role string")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS dates FROM orders")
def open_engine(spark, d):
    """A table opened by the engine: its rows, and how many dates its text column holds."""
    o = table(spark, d, "orders").select("o_totalprice", "o_orderstatus", F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).alias("day"))
    e = Engine(spark).load_frame(o)
    dates = typing.date_columns(o, ["o_orderstatus", "day"])
    found = o.agg(F.count(scalars.parse_date(F.col(dates[0])))).first()[0] if dates else 0
    return scalar_frame(spark, {"n": e.summary()["rows"], "dates": found})


# ---------------------------------------------------------------- selections


@query("SELECT count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem WHERE l_quantity BETWEEN 10 AND 30 AND l_discount BETWEEN 0.02 AND 0.05")
def brushed_rows(spark, d):
    inside = filters.brushes({"l_quantity": (10, 30), "l_discount": (0.02, 0.05)})
    return table(spark, d, "lineitem").where(inside).agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'al')")
def rows_by_name(spark, d):
    return table(spark, d, "part").where(filters.name_contains(F.col("p_name"), "AL")).select("p_partkey", "p_name")


@query("SELECT count(*) FILTER (WHERE l_quantity BETWEEN 5 AND 20) AS undone, count(*) FILTER (WHERE l_quantity BETWEEN 5 AND 20 AND l_returnflag IN ('A', 'R')) AS redone FROM lineitem")
def filters_undone(spark, d):
    s = filters.FilterStack()
    s.put({"type": "range", "col": "l_quantity", "lo": 0, "hi": 9})
    s.put({"type": "range", "col": "l_quantity", "lo": 5, "hi": 20})
    s.put({"type": "cats", "col": "l_returnflag", "values": ["A", "R"]})
    s.undo()
    one = s.predicate()
    s.redo()
    return table(spark, d, "lineitem").agg(F.count_if(one).alias("undone"), F.count_if(s.predicate()).alias("redone"))


_T2 = f"{_Z2}, t AS (SELECT *, (n - 1.0) / n * (a * a + b * b - 2 * r * a * b) / (1 - r * r) AS t2, CASE WHEN n > {factor.CHI2_ROWS} THEN -2 * ln(0.05) * (n - 1.0) / n ELSE pow(n - 1.0, 2) / n * (1 - pow(0.05, 2.0 / (n - 3))) END AS top FROM z)"


@query(f"WITH {_T2} SELECT count(*) FILTER (WHERE t2 > top) AS beyond, count(*) AS n, round(max(top), 6) + 0.0 AS limit_ FROM t")
def rows_beyond_limits(spark, d):
    t, a = pair_pca(spark, d)
    limit, q = a.limits(2)
    rows = a.diagnose(t, 2)
    return rounded(rows.agg(F.count_if(filters.beyond(F.col("T2"), F.col("Q"), limit, q)).alias("beyond"), F.count(F.lit(1)).alias("n"), F.lit(float(limit)).alias("limit_")))


@query(f"WITH {_T2} SELECT l_orderkey, l_linenumber, round(t2 / top, 5) + 0.0 AS ratio FROM t ORDER BY t2 / top DESC, l_orderkey * 8 + l_linenumber LIMIT 25")
def worst_rows(spark, d):
    t, a = pair_pca(spark, d)
    worst = factor.outliers(a, key_of(t), 25, 2, key="id")
    return worst.select("l_orderkey", "l_linenumber", (F.round("ratio", 5) + 0.0).alias("ratio"))


@query("""WITH t AS (SELECT unnest(['status', 'priority']) AS "column", unnest([o_orderstatus, o_orderpriority]) AS level, o_totalprice > 200000 AS s FROM orders), c AS (SELECT "column", level, count(*) AS n, count(*) FILTER (WHERE s) AS k FROM t GROUP BY ALL), w AS (SELECT *, sum(n) OVER (PARTITION BY "column") AS total, sum(k) OVER (PARTITION BY "column") AS drawn FROM c), l AS (SELECT "column", level, k AS n_sel, k / drawn AS share, n / total AS overall, (k / drawn) / (n / total) AS lift FROM w)
SELECT 'over' AS side, "column", level, n_sel, round(lift, 6) + 0.0 AS lift FROM (SELECT * FROM l WHERE n_sel >= 30 AND share >= 0.02 AND lift > 1.1 ORDER BY lift DESC, "column", level LIMIT 6) UNION ALL SELECT 'under', "column", level, n_sel, round(lift, 6) + 0.0 FROM (SELECT * FROM l WHERE lift < 0.9 AND overall >= 0.05 ORDER BY lift, "column", level LIMIT 3)""")
def strongest_lifts(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), "o_totalprice")
    high, low = groups.top_lifts(groups.selection_summary(o, F.col("o_totalprice") > 200000, ["o_totalprice"], ["status", "priority"])[1])
    part = lambda t, side: t.select(F.lit(side).alias("side"), "column", "level", "n_sel", "lift")
    return rounded(part(high, "over").unionByName(part(low, "under")))


@query("WITH c AS (SELECT avg(s_acctbal) AS m FROM supplier WHERE s_nationkey < 12) SELECT s_suppkey, round(abs(s_acctbal - m), 6) + 0.0 AS distance FROM supplier, c WHERE s_nationkey < 12 ORDER BY abs(s_acctbal - m) LIMIT 5")
def typical_of_selection(spark, d):
    return rounded(groups.typical_rows(table(spark, d, "supplier"), F.col("s_nationkey") < 12, ["s_acctbal"]).select("s_suppkey", "distance"))


_SEL_COLUMNS = "unnest(['l_quantity', 'l_discount', 'l_tax', 'l_extendedprice']) AS c, unnest([l_quantity, l_discount, l_tax, l_extendedprice]) AS x"


@query(f"""WITH t AS (SELECT {_SEL_COLUMNS}, l_extendedprice > 60000 AS s FROM lineitem), g AS (SELECT c, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd, count(*) FILTER (WHERE s) AS k, avg(x) FILTER (WHERE s) AS mk FROM t GROUP BY 1), v AS (SELECT c AS name, (mk - m) / sqrt(sd * sd / k * (n - k) / (n - 1)) AS v FROM g)
SELECT name, round(v, 5) + 0.0 AS v FROM v WHERE abs(v) >= 2""")
def explained_selection(spark, d):
    t = table(spark, d, "lineitem")
    got = groups.explain_selection(t, F.col("l_extendedprice") > 60000, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])
    return rounded(spark.createDataFrame([(r["column"], float(r["v"])) for r in got], "name string, v double"), 5)


# ---------------------------------------------------------------- axes


@query(f"WITH {_Z2} SELECT round(50 * (1 + abs(max(r))), 6) + 0.0 AS first, CAST(100.0 AS DOUBLE) AS second, round((1 + abs(max(r))) / 2, 6) + 0.0 AS flow1, round((1 - abs(max(r))) / 2, 6) + 0.0 AS flow2 FROM z")
def cumulative_inertia(spark, d):
    _, a = pair_pca(spark, d)
    flows = a.inertia_flows()
    return rounded(scalar_frame(spark, {"first": a.cum[0], "second": a.cum[1], "flow1": flows[0, 0], "flow2": flows[1, 1]}))


@query(f"WITH {_Z2} SELECT l_orderkey, l_linenumber, round(pow(a + g * b, 2) / 2 / greatest(a * a + b * b, 1e-12), 6) + 0.0 AS cos2_1, round(100 * pow(a + g * b, 2) / 2 / (n * (1 + abs(r))), 6) + 0.0 AS ctr_1 FROM z")
def quality_of_rows(spark, d):
    t, a = pair_pca(spark, d)
    return rounded(a.row_quality(t, 1).select("l_orderkey", "l_linenumber", "cos2_1", "ctr_1"))


@query(f"WITH {_Z2} SELECT l_orderkey, l_linenumber, round((a + g * b) / 2, 6) + 0.0 AS z_l_quantity, round(g * (a + g * b) / 2, 6) + 0.0 AS z_l_extendedprice FROM z")
def rows_from_one_axis(spark, d):
    t, a = pair_pca(spark, d)
    return rounded(a.reconstruct(t, 1).select("l_orderkey", "l_linenumber", "z_l_quantity", "z_l_extendedprice"))


@query(f"WITH {_Z2} SELECT least(1000, count(*) FILTER (WHERE (a + g * b) / sqrt(2.0) > sqrt(1 + abs(r)))) AS high, least(1000, count(*) FILTER (WHERE (a + g * b) / sqrt(2.0) < -sqrt(1 + abs(r)))) AS low FROM z")
def extremes_of_axis(spark, d):
    t, a = pair_pca(spark, d)
    got = factor.interpret(a, t, 0)
    high, low = (got["high"], got["low"]) if a.v[0, 0] > 0 else (got["low"], got["high"])
    return scalar_frame(spark, {"high": high.count(), "low": low.count()})


@query(f"WITH {_Z2} SELECT l_orderkey, l_linenumber, round(sqrt(pow(a - 1, 2) + pow(b + 0.5, 2)), 6) + 0.0 AS distance FROM z ORDER BY pow(a - 1, 2) + pow(b + 0.5, 2) LIMIT 3")
def neighbours_of_point(spark, d):
    """The point of given standardised values, which its rotation doesn't move."""
    t, a = pair_pca(spark, d)
    return rounded(factor.neighbours(a, t, np.array([1.0, -0.5]) @ a.v, 3).select("l_orderkey", "l_linenumber", "distance"))


@query(f"WITH {_Z2}, m1 AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq FROM lineitem) SELECT round((40 - max(mq)) / max(sq) / sqrt(2.0), 6) + 0.0 AS p1, round((40 - max(mq)) / max(sq) / sqrt(2.0), 6) + 0.0 AS p2 FROM m1")
def point_on_calibrated_axis(spark, d):
    _, a = pair_pca(spark, d)
    p = factor.calibrated(a, 0, 40.0) * np.sign(a.v[0])
    return rounded(scalar_frame(spark, {"p1": p[0], "p2": p[1]}))


@query(f"WITH {_Z2} SELECT 'PCA' AS method, max(n) AS n, round(1 + abs(max(r)), 6) + 0.0 AS first, round(1 - abs(max(r)), 6) + 0.0 AS second, 2 AS axes_reported FROM z")
def results_as_json(spark, d):
    _, a = pair_pca(spark, d)
    r = json.loads(json.dumps(writers.results(a)))
    return scalar_frame(spark, {"method": r["method"], "n": r["n"], "first": r["eigenvalues"][0], "second": r["eigenvalues"][1], "axes_reported": len(writers.report(a)["axes"])})


_NORMED = "list_transform(w, lambda x: x / sqrt(list_dot_product(w, w)))"
_SIGNED = "list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))]))"
#: The first two axes of the four measures, by power iterations.
_FOUR = f"""{LINES}, s AS (SELECT count(*) AS n, avg(qty) AS m1, avg(price) AS m2, avg(disc) AS m3, avg(tax) AS m4, stddev_pop(qty) AS s1, stddev_pop(price) AS s2, stddev_pop(disc) AS s3, stddev_pop(tax) AS s4, corr(qty, price) AS a, corr(qty, disc) AS b, corr(qty, tax) AS c, corr(price, disc) AS d, corr(price, tax) AS e, corr(disc, tax) AS f FROM li),
r1 AS (SELECT [[1.0, a, b, c], [a, 1.0, d, e], [b, d, 1.0, f], [c, e, f, 1.0]] AS m FROM s),
p1(i, v) AS (SELECT 0, CAST([0.3, 0.7, 0.5, 0.4] AS DOUBLE[]) UNION ALL SELECT i + 1, {_NORMED} FROM (SELECT i, list_transform(m, lambda row: list_dot_product(row, v)) AS w FROM p1, r1 WHERE i < 300)),
x1 AS (SELECT {_SIGNED} AS v FROM p1 WHERE i = 300), l1 AS (SELECT v, list_dot_product(v, list_transform(m, lambda row: list_dot_product(row, v))) AS l FROM x1, r1),
r2 AS (SELECT list_transform([1, 2, 3, 4], lambda i: list_transform([1, 2, 3, 4], lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM r1, l1),
p2(i, v) AS (SELECT 0, CAST([0.9, 0.2, 0.3, -0.4] AS DOUBLE[]) UNION ALL SELECT i + 1, {_NORMED} FROM (SELECT i, list_transform(m, lambda row: list_dot_product(row, v)) AS w FROM p2, r2 WHERE i < 300)),
x2 AS (SELECT {_SIGNED} AS v FROM p2 WHERE i = 300), l2 AS (SELECT v, list_dot_product(v, list_transform(m, lambda row: list_dot_product(row, v))) AS l FROM x2, r2),
g AS (SELECT l_orderkey, l_linenumber, [(qty - m1) / s1, (price - m2) / s2, (disc - m3) / s3, (tax - m4) / s4] AS z FROM li, s)"""


@query(f"""WITH RECURSIVE {_FOUR}, h AS (SELECT l_orderkey, l_linenumber, list_dot_product(z, l1.v) AS f1, list_dot_product(z, l2.v) AS f2, list_dot_product(z, z) AS whole, l1.l AS e1, l2.l AS e2 FROM g, l1, l2)
SELECT l_orderkey, l_linenumber, round(f1, 5) + 0.0 AS f1, round(f2, 5) + 0.0 AS f2, round((f1 * f1 / e1 + f2 * f2 / e2) * (n - 1.0) / n, 4) + 0.0 AS t2, round(greatest(whole - f1 * f1 - f2 * f2, 0), 4) + 0.0 AS q FROM h, s""")
def scores_of_four(spark, d):
    li = lines(spark, d)
    a = factor.pca(li, MEASURES, 2)
    shown = lambda c, k: (F.round(c, k) + 0.0)
    return li.select("l_orderkey", "l_linenumber", shown(a.score(0), 5).alias("f1"), shown(a.score(1), 5).alias("f2"), shown(a.t2(2), 4).alias("t2"), shown(a.q_residual(2), 4).alias("q"))


@query(f"""WITH RECURSIVE {_FOUR}, k AS (SELECT 1 AS axis, v, l FROM l1 UNION ALL SELECT 2, v, l FROM l2), u AS (SELECT axis, l, unnest(['qty', 'price', 'disc', 'tax']) AS name, unnest(v) AS v FROM k)
SELECT name, CAST(axis AS BIGINT) AS axis, round(v * sqrt(l), 5) + 0.0 AS coord, round(v * v * l, 5) + 0.0 AS cos2, round(100 * v * v, 4) + 0.0 AS ctr FROM u""")
def loadings_of_four(spark, d):
    a = factor.pca(lines(spark, d), MEASURES, 2)
    rows = [(c, k + 1, round(float(a.coord[j, k]), 5) + 0.0, round(float(a.cos2[j, k]), 5) + 0.0, round(float(a.ctr[j, k]), 4) + 0.0) for j, c in enumerate(MEASURES) for k in range(2)]
    return spark.createDataFrame(rows, "name string, axis long, coord double, cos2 double, ctr double")


# ---------------------------------------------------------------- classes, shapes, densities


@query(f"""WITH k AS (SELECT l_orderkey, l_linenumber, {_NEAREST} AS class, least({", ".join(_D)}) AS d FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY d, l_orderkey * 8 + l_linenumber) AS rank FROM k)
SELECT l_orderkey, l_linenumber, CAST(class AS INTEGER) AS class, CAST(rank AS INTEGER) AS rank, round(sqrt(d), 6) + 0.0 AS own FROM r WHERE rank <= 5""")
def paragons_of_centres(spark, d):
    c = cluster.Classes(3, _CENTRES, PAIR, [], [], 0.0, [])
    return rounded(cluster.paragons(key_of(table(spark, d, "lineitem")), c, key="id")[0].select("l_orderkey", "l_linenumber", "class", "rank", "own"))


@query(f"SELECT CAST({_NEAREST} AS VARCHAR) AS level, count(*) AS n, round(avg(CAST(l_returnflag = 'R' AS INTEGER)), 6) + 0.0 AS mean FROM lineitem GROUP BY 1")
def target_by_class(spark, d):
    t = table(spark, d, "lineitem").withColumn("class", cluster.nearest_centre([F.col(c) for c in PAIR], _CENTRES))
    return rounded(target.target_by_level(t, "class", (F.col("l_returnflag") == "R").cast("double")).select("level", "n", "mean"))


@query("SELECT count(*) AS points, round(max(s_acctbal) - min(s_acctbal), 3) + 0.0 AS length FROM (SELECT s_acctbal FROM supplier ORDER BY s_suppkey LIMIT 1200)")
def length_of_spanning_tree(spark, d):
    """Of points on a line the tree is as long as the line."""
    x = table(spark, d, "supplier").orderBy("s_suppkey").limit(1_200).select("s_acctbal").toPandas().to_numpy(float)
    return scalar_frame(spark, {"points": len(x), "length": round(sum(e[2] for e in shape.spanning_tree(np.column_stack([x, np.zeros(len(x))]))), 3) + 0.0})


@query("WITH n AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS n FROM orders GROUP BY ALL) SELECT a AS level_a, b AS level_b, round(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b)), 6) + 0.0 AS ratio FROM n")
def observed_over_expected(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    out = shape.burt_ratio(stats.burt(o, ["o_orderstatus", "o_orderpriority"]), o.count()).where("var_a = 'o_orderstatus' and var_b = 'o_orderpriority'")
    return rounded(out.select("level_a", "level_b", F.col(out.columns[-1]).alias("ratio")))


@query("WITH q AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, quantile_cont(l_extendedprice, 0.001) AS a, quantile_cont(l_extendedprice, 0.999) AS b FROM lineitem), f AS (SELECT CASE WHEN hi - lo <= 1.6 * (b - a) THEN lo ELSE a END AS a, CASE WHEN hi - lo <= 1.6 * (b - a) THEN hi ELSE b END AS b FROM q) SELECT round(a - 0.06 * (b - a), 6) + 0.0 AS low, round(b + 0.06 * (b - a), 6) + 0.0 AS high FROM f")
def extent_of_plane(spark, d):
    lo, hi = density.extent(table(spark, d, "lineitem"), F.col("l_extendedprice"))
    return rounded(scalar_frame(spark, {"low": lo, "high": hi}))


@query("SELECT round(quantile_cont(o_totalprice, 0.05), 6) + 0.0 AS low, round(quantile_cont(o_totalprice, 0.95), 6) + 0.0 AS high FROM orders")
def scale_of_colours(spark, d):
    lo, hi = density.colour_scale(table(spark, d, "orders"), F.col("o_totalprice"))
    return rounded(scalar_frame(spark, {"low": lo, "high": hi}))


@query("""WITH v AS (SELECT s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier ORDER BY s_suppkey LIMIT 500), h AS (SELECT count(*) AS n, stddev_pop(x) * pow(count(*), -1 / 6.0) AS hx, stddev_pop(y) * pow(count(*), -1 / 6.0) AS hy FROM v), g AS (SELECT * FROM (VALUES (0.0), (5000.0)) a(gx), (VALUES (5.0), (12.0)) b(gy))
SELECT gx, gy, round(1e6 * sum(exp(-0.5 * pow((gx - x) / hx, 2) - 0.5 * pow((gy - y) / hy, 2)) / (n * 2 * pi() * hx * hy)), 6) + 0.0 AS density FROM (SELECT CAST(gx AS DOUBLE) AS gx, CAST(gy AS DOUBLE) AS gy FROM g), v, h GROUP BY gx, gy""")
def kernel_density(spark, d):
    p = table(spark, d, "supplier").orderBy("s_suppkey").limit(500).select("s_acctbal", F.col("s_nationkey").cast("double")).toPandas().to_numpy(float)
    gx, gy = np.array([0.0, 5000.0]), np.array([5.0, 12.0])
    z = density.kde(p[:, 0], p[:, 1], None, gx, gy)
    return rounded(spark.createDataFrame([(float(x), float(y), 1e6 * float(z[j, i])) for i, x in enumerate(gx) for j, y in enumerate(gy)], "gx double, gy double, density double"))


# ---------------------------------------------------------------- quality, missing values, targets, insights


@query("WITH g AS (SELECT count(*) AS c FROM lineitem GROUP BY l_quantity, l_discount, l_returnflag), t AS (SELECT sum(c) AS n, sum(c - 1) AS dup FROM g) SELECT CAST(n AS BIGINT) AS n, CAST(dup AS BIGINT) AS duplicates, CAST(greatest(0, round_even(100 - CASE WHEN dup > 0.05 * n THEN 12 WHEN dup > 0 THEN 5 ELSE 0 END - least(25, 300.0 * dup / n), 0)) AS BIGINT) AS score FROM t")
def quality_score(spark, d):
    q = typing.quality_report(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_returnflag"))
    return scalar_frame(spark, {"n": q["rows"], "duplicates": q["duplicates"], "score": q["score"]})


@query("WITH h AS (SELECT CASE WHEN l_orderkey % 7 <> 0 THEN l_tax END AS tax, CASE WHEN l_orderkey % 5 <> 0 THEN l_returnflag END AS flag FROM lineitem), m AS (SELECT avg(tax) AS m FROM h) SELECT 'drop' AS how, count(*) AS n, round(avg(tax), 6) + 0.0 AS tax FROM h WHERE tax IS NOT NULL AND flag IS NOT NULL UNION ALL SELECT 'mean', count(*), round(avg(coalesce(tax, m)), 6) + 0.0 FROM h, m WHERE tax IS NOT NULL")
def missing_by_method(spark, d):
    k = F.col("l_orderkey")
    h = table(spark, d, "lineitem").select(F.when(k % 7 != 0, F.col("l_tax")).alias("tax"), F.when(k % 5 != 0, F.col("l_returnflag")).alias("flag"))
    of = lambda how: prep.apply_missing(h, how, ["tax"], ["flag"]).where("tax is not null").agg(F.lit(how).alias("how"), F.count(F.lit(1)).alias("n"), F.avg("tax").alias("tax"))
    return rounded(of("drop").unionByName(of("mean")))


@query("WITH s AS (SELECT l_linestatus AS l, count(*) AS n FROM lineitem GROUP BY 1), p AS (SELECT l FROM s ORDER BY n, l LIMIT 1) SELECT 'binary' AS kind, p.l AS positive, count(*) FILTER (WHERE l_linestatus = p.l) AS events FROM lineitem, p GROUP BY p.l")
def kind_of_target(spark, d):
    t = table(spark, d, "lineitem")
    s = target.target_spec(t, "l_linestatus")
    return t.agg(F.lit(s.kind).alias("kind"), F.lit(s.positive).alias("positive"), F.sum(s.y()).cast("long").alias("events"))


@query("SELECT CAST(v AS DOUBLE) AS iv, CASE WHEN v < 0.02 THEN 'none' WHEN v < 0.1 THEN 'weak' WHEN v < 0.3 THEN 'medium' WHEN v < 0.5 THEN 'strong' ELSE 'very strong' END AS label FROM (VALUES (0.0), (0.02), (0.0999), (0.2), (0.3), (0.7)) t(v)")
def bands_of_iv(spark, d):
    return spark.createDataFrame([(v, target.iv_label(v)) for v in (0.0, 0.02, 0.0999, 0.2, 0.3, 0.7)], "iv double, label string")


@query("""WITH g AS (SELECT o_orderpriority AS l, count(*) AS n, sum(o_totalprice) AS s, sum(o_totalprice * o_totalprice) AS q FROM orders GROUP BY 1), c AS (SELECT l, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(q) OVER w AS lq, sum(n) OVER () AS n, sum(s) OVER () AS s, sum(q) OVER () AS q FROM g WINDOW w AS (ORDER BY s / n, l ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, (q - s * s / n) - (lq - ls * ls / ln) - ((q - lq) - (s - ls) * (s - ls) / (n - ln)) AS gain FROM c WHERE ln < n AND ln >= greatest(30, ceil(0.01 * n)) AND n - ln >= greatest(30, ceil(0.01 * n))), b AS (SELECT * FROM k ORDER BY gain DESC LIMIT 1), t AS (SELECT CASE WHEN gain > 0.002 * (q - s * s / n) THEN 1 ELSE 0 END AS split, * FROM b)
SELECT CAST(0 AS INTEGER) AS leaf, CAST(CASE WHEN split = 1 THEN ln ELSE n END AS BIGINT) AS n, round(CASE WHEN split = 1 THEN ls / ln ELSE s / n END, 4) + 0.0 AS mean FROM t UNION ALL SELECT 1, CAST(n - ln AS BIGINT), round((s - ls) / (n - ln), 4) + 0.0 FROM t WHERE split = 1""")
def stump_by_level(spark, d):
    """A tree of one split over a categorical column."""
    o = table(spark, d, "orders")
    spec = target.Target("o_totalprice", "numeric")
    return rounded(target.leaf_table(o, spec, target.cart(o, spec, ["o_orderpriority"], depth=1)), 4)


@query("""WITH t AS (SELECT CAST(l_extendedprice > 60000 AS INTEGER) AS y, CAST(l_quantity AS INTEGER) % 4 AS x FROM lineitem), g AS (SELECT x, count(*) AS n, sum(y) AS s FROM t GROUP BY 1), c AS (SELECT x, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER () AS n, sum(s) OVER () AS s FROM g WINDOW w AS (ORDER BY x ROWS UNBOUNDED PRECEDING)),
k AS (SELECT *, (s - s * s / n) - (ls - ls * ls / ln) - ((s - ls) - (s - ls) * (s - ls) / (n - ln)) AS gain FROM c WHERE ln < n), b AS (SELECT *, gain > 0.002 * (s - s * s / n) AS split FROM k ORDER BY gain DESC, x LIMIT 1)
SELECT CAST(0 AS INTEGER) AS leaf, CAST(CASE WHEN split THEN ln ELSE n END AS BIGINT) AS n, round(CASE WHEN split THEN ls / ln ELSE s / n END, 6) + 0.0 AS mean FROM b UNION ALL SELECT 1, CAST(n - ln AS BIGINT), round((s - ls) / (n - ln), 6) + 0.0 FROM b WHERE split""")
def stump_by_number(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_extendedprice") > 60000).cast("int").alias("y"), (F.col("l_quantity").cast("int") % 4).alias("x"))
    spec = target.Target("y", "binary", "1")
    return rounded(target.leaf_table(t, spec, target.cart(t, spec, ["x"], depth=1)))


def _found(spark: SparkSession, d: str) -> list[dict]:
    li = key_of(lines(spark, d)).withColumn("tax", F.when(F.col("l_orderkey") % 9 != 0, F.col("tax"))).withColumn("heavy", F.when(F.col("qty") > 49, "x").otherwise("y")).withColumn("weight", F.when(F.col("qty") > 49, "p").when(F.col("qty") > 25, "q").otherwise("r"))
    a = factor.pca(li, MEASURES, 2)
    shapes = [{"a": "qty", "b": "disc", "nonmono": 0.2, "dcorR": 0.5, "curve": 0.0, "spearman": 0.0, "clumpy": 0.7, "striated": 0.0}, {"a": "qty", "b": "tax", "nonmono": 0.0, "dcorR": 0.0, "curve": 0.2, "spearman": -0.5, "clumpy": 0.0, "striated": 0.4}]
    classes = cluster.Classes(3, _CENTRES, PAIR, [], [], 0.5, [])
    return insights.build(a, li, classes, shapes, key="id", texts=["heavy", "weight"])


_INSIGHT_LINES = f"{LINES}, l AS (SELECT qty, price, disc, CASE WHEN l_orderkey % 9 <> 0 THEN tax END AS tax, CASE WHEN qty > 49 THEN 'x' ELSE 'y' END AS heavy, CASE WHEN qty > 49 THEN 'p' WHEN qty > 25 THEN 'q' ELSE 'r' END AS weight FROM li), f AS (SELECT * FROM l WHERE tax IS NOT NULL)"


@query(f"""WITH {_INSIGHT_LINES}, r AS (SELECT unnest(['qty price', 'qty disc', 'qty tax', 'price disc', 'price tax', 'disc tax']) AS names, unnest([corr(qty, price), corr(qty, disc), corr(qty, tax), corr(price, disc), corr(price, tax), corr(disc, tax)]) AS r FROM f), c AS (SELECT names, abs(r) AS r FROM r WHERE abs(r) >= 0.5 ORDER BY abs(r) DESC LIMIT 3),
m AS (SELECT 100.0 * (count(*) - count(tax)) / count(*) AS share FROM l), w AS (SELECT count(*) FILTER (WHERE heavy = 'x') / count(*) AS rare FROM l)
SELECT 'corr' AS kind, names, round(0.95 * r, 6) + 0.0 AS score FROM c UNION ALL SELECT 'missing', 'tax', round(greatest(0.3, least(0.85, share / 30)), 6) + 0.0 FROM m WHERE share >= 3 UNION ALL SELECT 'missing', v, CAST(0.4 AS DOUBLE) FROM w, (VALUES ('heavy'), ('weight')) t(v) WHERE rare < 0.05
UNION ALL SELECT 'assoc', 'heavy weight', CAST(0.9 AS DOUBLE) UNION ALL SELECT 'nonlin', 'qty disc', round(0.5 + 1.6 * 0.2, 6) + 0.0 UNION ALL SELECT 'curve', 'qty tax', round(0.4 + 1.5 * 0.2, 6) + 0.0 UNION ALL SELECT 'shape', 'qty disc', round(0.35 + 0.4 * 0.7, 6) + 0.0 UNION ALL SELECT 'shape', 'qty tax', round(0.3 + 0.3 * 0.4, 6) + 0.0 UNION ALL SELECT 'clusters', '', round(0.35 + 0.6 * 0.5, 6) + 0.0""")
def insights_by_kind(spark, d):
    """Correlations, missing and rare values and associations of the lines; shapes and classes are given."""
    kinds = ("corr", "missing", "assoc", "nonlin", "curve", "shape", "clusters")
    return rounded(spark.createDataFrame([(x["kind"], " ".join(x["names"]), x["score"]) for x in _found(spark, d) if x["kind"] in kinds], "kind string, names string, score double"))


@query("WITH n AS (SELECT c_mktsegment AS names, count(*) / sum(count(*)) OVER () AS score FROM customer GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, names) AS k FROM n) SELECT names, round(score, 6) + 0.0 AS score FROM r WHERE k <= 3")
def insights_capped(spark, d):
    rows = table(spark, d, "customer").groupBy("c_mktsegment").count().collect()
    total = sum(r["count"] for r in rows)
    found = [{"kind": "skew", "names": (r["c_mktsegment"],), "score": r["count"] / total} for r in sorted(rows, key=lambda r: (-r["count"], r["c_mktsegment"])) for _ in range(2)]
    return rounded(spark.createDataFrame([(x["names"][0], x["score"]) for x in insights.rank(found)], "names string, score double"))


# ---------------------------------------------------------------- what displays read


@query("SELECT o_orderpriority AS name, round(count(*) / sum(count(*)) OVER (), 9) + 0.0 AS weight FROM orders GROUP BY 1")
def masses_of_levels(spark, d):
    o = table(spark, d, "orders")
    return rounded(views.main_cloud(factor.ca(o, "o_orderpriority", "o_orderstatus"), o).select("name", "weight"), 9)


@query(f"WITH {_Z2} SELECT l_orderkey, l_linenumber, round(pow(a + g * b, 2) / 2 / greatest(a * a + b * b, 1e-12), 6) + 0.0 AS cos2, round(100 * pow(a + g * b, 2) / 2 / (n * (1 + abs(r))), 6) + 0.0 AS ctr, round((n - 1.0) / n * (a * a + b * b - 2 * r * a * b) / (1 - r * r), 5) + 0.0 AS t2 FROM z")
def encodings_of_rows(spark, d):
    t, a = pair_pca(spark, d)
    return t.select("l_orderkey", "l_linenumber", *((F.round(views.encoding(a, k, n), 5 if k == "t2" else 6) + 0.0).alias(k) for k, n in (("cos2", 1), ("ctr", 1), ("t2", 2))))


@query(f"WITH {LINES}, r AS (SELECT unnest(['qty', 'price', 'disc', 'tax']) AS name, unnest([min(qty), min(price), min(disc), min(tax)]) AS low, unnest([max(qty), max(price), max(disc), max(tax)]) AS high FROM li) SELECT name, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high FROM r")
def parallel_ranges(spark, d):
    li = lines(spark, d)
    _, axes = views.parallel_model(factor.pca(li, MEASURES, 2), li)
    return rounded(spark.createDataFrame([(x["name"], float(x["low"]), float(x["high"])) for x in axes], "name string, low double, high double"))


@query(f"WITH {_Z2} SELECT round(sqrt((1 - abs(max(r))) / 2), 6) + 0.0 AS error, round((1 + abs(max(r))) / 2, 6) + 0.0 AS held, round(max(n) * 0.05, 6) + 0.0 AS one, round(max(n) * 0.0975, 6) + 0.0 AS either, round((1 + abs(max(r))) / 2, 6) + 0.0 AS shown FROM z")
def reading_errors(spark, d):
    _, a = pair_pca(spark, d)
    one, either = views.false_alarms(a.n)
    return rounded(scalar_frame(spark, {"error": views.cell_error(a, 1), "held": views.cumulated_cos2(a, 1)[0], "one": one, "either": either, "shown": views.shown_inertia(a, np.array([[1.0, 0.0], [0.0, 0.0]]))}))


@query("""WITH n AS (SELECT o_totalprice > 200000 AS a, o_orderpriority AS b, count(*) AS k FROM orders GROUP BY 1, 2), m AS (SELECT *, sum(k) OVER (PARTITION BY a) AS ra, sum(k) OVER (PARTITION BY b) AS cb, sum(k) OVER () AS t FROM n), d AS (SELECT *, pow(k / t - (ra / t) * (cb / t), 2) / ((ra / t) * (cb / t)) AS x FROM m), s AS (SELECT sum(x) AS phi, count(DISTINCT a) AS i, count(DISTINCT b) AS j FROM d)
SELECT CAST(a AS VARCHAR) AS name, round(100 * sum(x) / max(phi), 4) + 0.0 AS ctr FROM d, s GROUP BY a UNION ALL SELECT b || ' (col.)', round(100 * sum(x) / max(phi) * max(i) / max(j), 4) + 0.0 FROM d, s GROUP BY b""")
def contributions_together(spark, d):
    """With two rows there is one axis, and an element's contribution is its share of the inertia."""
    r = factor.ca(table(spark, d, "orders").withColumn("big", F.col("o_totalprice") > 200000), "big", "o_orderpriority")
    return rounded(spark.createDataFrame([(x, c) for x, c, _ in views.contributions(r, 0)], "name string, ctr double"), 4)


@query("WITH s AS (SELECT s_acctbal AS x FROM supplier ORDER BY s_suppkey LIMIT 1200) SELECT round(var_pop(x), 3) + 0.0 AS one FROM s")
def inertia_within_one_class(spark, d):
    x = table(spark, d, "supplier").orderBy("s_suppkey").limit(1_200).select("s_acctbal").toPandas().to_numpy(float)
    gains = sorted((h for _, _, h, _ in cluster.ward(x)), reverse=True)
    return scalar_frame(spark, {"one": round(views.within_inertia(gains)[0], 3) + 0.0})


@query("WITH m AS (SELECT o_orderpriority AS p, avg(o_totalprice - 150000) AS x, count(*) AS n FROM orders GROUP BY 1) SELECT p, CASE WHEN x < 0 THEN '−' ELSE '' END || replace(printf('%.2f', abs(x)), '.', ',') AS shown, replace(printf('%.1f', n / 10.0), '.', ',') || ' %' AS share, n || CASE WHEN n <= 1 THEN ' commande' ELSE ' commandes' END AS counted FROM m")
def numbers_as_text(spark, d):
    rows = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg(F.col("o_totalprice") - 150000).alias("x"), F.count(F.lit(1)).alias("n")).collect()
    return spark.createDataFrame([(r[0], text.number(r["x"]), text.percent(r["n"] / 10), text.counted(r["n"], "commande")) for r in rows], "p string, shown string, share string, counted string")
