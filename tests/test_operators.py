"""Identities and small cases of the analytics operators."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrille.operators import cluster, density, embed, factor, filters, groups, insights, prep, shape, stats, target, typing
from quadrille.plans import registry
from quadrille.plans.api import Engine
from quadrille.plans.spec import AnalysisSpec, History
from quadrille.sources import readers, writers


@pytest.fixture(scope="module")
def lines(spark, sf):
    return registry.key_of(registry.lines(spark, sf)).cache()


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(x), float(x * 0.8 + y), "abc"[int(k)], "uv"[int(x > 0)]) for i, (x, y, k) in enumerate(zip(rng.normal(size=300), rng.normal(size=300), rng.integers(0, 3, 300)))]
    return spark.createDataFrame(rows, "id long, x double, y double, g string, h string").cache()


def test_pca_identities(lines):
    a = factor.pca(lines, registry.MEASURES, 2)
    assert abs(a.vals.sum() - 4) < 1e-9
    assert np.allclose(a.cos2.sum(1), 1) and np.allclose(a.ctr.sum(0), 100)
    assert np.allclose(a.inertia_flows().sum(0), a.vals)
    n = a.n
    r = a.diagnose(a.scores(lines), 2).agg(F.avg("T2"), F.avg("Q"), *(F.var_pop(f"F{k + 1}") for k in range(a.q))).first()
    assert abs(r[0] - 2 * (n - 1) / n) < 1e-6 and abs(r[1] - a.vals[2:].sum()) < 1e-6
    assert np.allclose(r[2:], a.vals)
    z = a.reconstruct(lines, a.q).select((F.col("z_qty") - a.z()[0]).alias("d")).agg(F.max(F.abs("d"))).first()[0]
    assert z < 1e-9


def test_pca_wide_matches_narrow(lines, monkeypatch):
    narrow = factor.pca(lines, registry.MEASURES)
    monkeypatch.setattr(factor, "EXPRESSION_COLUMNS", 1)
    assert np.allclose(factor.pca(lines, registry.MEASURES).vals, narrow.vals)


@pytest.mark.parametrize("scale", [1e200, 1e-200])
def test_pca_extreme_values(mixed, scale):
    a = factor.pca(mixed.select((F.col("x") * scale).alias("x"), "y"), ["x", "y"])
    assert np.allclose(a.vals, factor.pca(mixed, ["x", "y"]).vals)


def test_pca_refuses(spark, mixed):
    with pytest.raises(ValueError):
        factor.pca(mixed, ["x"])
    with pytest.raises(ValueError):
        factor.pca(mixed.withColumn("c", F.lit(1.0)), ["x", "c"])
    with pytest.raises(ValueError):
        factor.pca(mixed.limit(2), ["x", "y"])


def test_mca_and_famd(mixed):
    m = factor.mca(mixed, ["g", "h"])
    assert abs(m.vals.sum() - (5 / 2 - 1)) < 1e-9
    f = m.scores(mixed).agg(*(F.var_pop(f"F{k + 1}") for k in range(m.q))).first()
    assert np.allclose(f, m.vals)
    a = factor.famd(mixed, ["x", "y"], ["g", "h"])
    assert abs(a.vals.sum() - (2 + 5 - 2)) < 1e-9
    assert np.allclose(a.extra["link"].sum(0), a.vals)
    assert np.allclose(a.scores(mixed).agg(*(F.var_pop(f"F{k + 1}") for k in range(a.q))).first(), a.vals)
    d = a.scores(mixed).select((a.distance2() - sum(F.col(f"F{k + 1}") ** 2 for k in range(a.q))).alias("d")).agg(F.max(F.abs("d"))).first()[0]
    assert d < 1e-9


def test_ca(mixed):
    r = factor.ca(mixed, "g", "h")
    assert abs(r["vals"].sum() * r["n"] - r["chi2"]) < 1e-9
    assert np.allclose(factor.project_profile(r, r["table"][0])[: r["q"]], r["F"][0])
    with pytest.raises(ValueError):
        factor.ca_matrix(np.array([[1.0, -1.0], [2.0, 3.0]]))


def test_supplementary_and_interpretation(mixed):
    a = factor.pca(mixed, ["x", "y"])
    s = factor.supplementary(a, mixed, ["x"], ["g"])
    assert np.allclose(s["numeric"]["x"], a.coord[0, :2])
    i = factor.interpret(a, mixed, 0, 10)
    assert i["high"].count() <= 10 and i["pct"] > 50
    assert len(factor.brief(a)) >= 4 and factor.variable_order(a)


def test_describe(spark):
    r = stats.describe(spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 3, 3, 4, 4, 5, 40]], "v double"), ["v"]).first()
    assert r["out"] == 1 and r["uniq"] == 6


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, float("nan"))], "a double, b double")
    assert stats.pearson(df, "a", "b").first()["r"] == 0.0
    r = {x["variable"]: x for x in stats.describe(df, ["a", "b"]).collect()}
    assert r["a"]["skew"] == 0 and r["b"]["miss"] == 1


def test_test_value(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("x"))
    assert abs(stats.test_value(df, "x", F.col("x") >= 8).first()["v"] - 3.5 / np.sqrt(8.25 / 3 * 7 / 9)) < 1e-12


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=3, max_size=8, unique=True))
def test_lasso(spark, points):
    grid = spark.range(0, 441).select((F.col("id") % 21 + 0.5).alias("x"), (F.floor(F.col("id") / 21) + 0.5).alias("y"))
    got = {(r["x"], r["y"]) for r in grid.where(filters.polygon(F.col("x"), F.col("y"), points)).collect()}

    def inside(x, y):
        out = False
        for (a, b), (c, d) in zip(points, points[1:] + points[:1]):
            if (b > y) != (d > y) and x < (c - a) * (y - b) / (d - b) + a:
                out = not out
        return out

    assert got == {(i + 0.5, j + 0.5) for i in range(21) for j in range(21) if inside(i + 0.5, j + 0.5)}


def test_filter_stack(spark):
    s = filters.FilterStack()
    s.put({"type": "range", "col": "id", "lo": 2, "hi": 5})
    s.put({"type": "range", "col": "id", "lo": 3, "hi": 9})
    assert len(s.filters) == 1 and spark.range(20).where(s.predicate()).count() == 7
    s.undo()
    assert spark.range(20).where(s.predicate()).count() == 4
    s.redo()
    assert s.filters[0]["hi"] == 9
    assert filters.ranges_text([3, 4, 5, 9]) == "3-5,9" and spark.range(20).where(filters.in_ranges(F.col("id"), "3-5,9")).count() == 4


def test_ward_and_classes(lines):
    x = np.random.default_rng(1).normal(size=(60, 2))
    tree = cluster.ward(x)
    assert abs(sum(h for *_, h, _ in tree) - x.var(0).sum()) < 1e-9
    assert (np.diff([h for *_, h, _ in tree]) >= -1e-12).all() and len(set(cluster.cut_tree(tree, 60, 4))) == 4
    assert sorted(cluster.leaf_order(tree, 60)) == list(range(60))
    rows = factor.pca(lines, registry.MEASURES, 2).scores(lines, 2)
    c = cluster.hcpc(rows, ["F1", "F2"], "id")
    assert 2 <= c.k <= 10 and 0 < c.r2 < 1 and sum(c.sizes) == lines.count()
    near, far = cluster.paragons(rows, c, 3, "id")
    assert near.groupBy("class").count().agg(F.max("count")).first()[0] <= 3 and far.count()


def test_imputation():
    rng = np.random.default_rng(2)
    full = rng.normal(size=(120, 1)) @ rng.normal(size=(1, 5)) + 0.05 * rng.normal(size=(120, 5))
    holed = full.copy()
    holed[rng.random(full.shape) < 0.1] = np.nan
    at = np.isnan(holed)
    got = prep.impute_pca_matrix(holed)
    mean = np.where(at, np.nanmean(holed, 0), holed)
    assert ((got - full)[at] ** 2).sum() < 0.2 * ((mean - full)[at] ** 2).sum()
    whole, holes = holed[~at.any(1)], holed[at.any(1)]
    same = prep.impute_pca_matrix(holes, moments=(len(whole), whole.sum(0), whole.T @ whole))
    assert np.allclose(same, got[at.any(1)], atol=1e-3)


def test_imputation_on_rows(spark):
    rows = [(i, float(i), 2.0 * i if i % 5 else None, 3.0 * i, -1.0 * i, 5.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double")
    out = prep.impute_pca(df, ["a", "b", "c", "d", "e"], "id", axes=1)
    assert out.count() == 60 and out.where("b is null").count() == 0
    assert out.where("id % 5 = 0").agg(F.max(F.abs(F.col("b") - 2 * F.col("a")))).first()[0] < 3


def test_shapes():
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = x**2 + 0.05 * rng.normal(size=300)
    assert abs(shape.pearson(x, y)) < 0.35 and shape.dcor(x, y) > 0.45 and shape.dcor(x, rng.normal(size=300)) < 0.2
    assert abs(shape.dcor(x, 3 * x + 1) - 1) < 1e-9
    assert shape.scagnostics(x, 2 * x)["monotonic"] > 0.98
    blobs = np.concatenate([rng.normal(0, 0.1, 150), rng.normal(5, 0.1, 150)])
    assert shape.scagnostics(blobs, np.concatenate([rng.normal(0, 0.1, 150), rng.normal(5, 0.1, 150)]))["clumpy"] > 0.7
    assert shape.scagnostics(rng.random(300), rng.random(300))["clumpy"] < 0.7
    far = np.append(rng.normal(size=200), 60.0)
    assert shape.scagnostics(far, np.append(rng.normal(size=200), 60.0))["outlying"] > 0


def test_supervised(spark):
    rng = np.random.default_rng(4)
    n = 3000
    x, c, z = rng.normal(size=n), rng.integers(0, 3, n), rng.normal(size=n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(2.2 * x + 1.2 * (c == 0) - 1.5)))).astype(int)
    rows = list(zip(x.tolist(), ["ABC"[k] for k in c], z.tolist(), (y + 0.01 * rng.normal(size=n)).tolist(), y.tolist()))
    df = spark.createDataFrame(rows, "x double, c string, z double, fuite double, y int")
    out = target.supervised(df, "y")
    assert [r["column"] for r in out["importance"]][:2] == ["fuite", "x"] and out["leaks"] == ["fuite"]
    tree = out["tree"]
    assert tree.column == "x" and out["quality"] > 0.75
    assert sum(leaf.n for leaf in tree.leaves()) == n
    assert {r["leaf"]: r["n"] for r in target.leaf_table(df, out["target"], tree).collect()} == {leaf.leaf: leaf.n for leaf in tree.leaves()}
    assert tree.as_dict()["column"] == "x" and tree.rules()[0][2] >= tree.rules()[-1][2]


def test_groups(mixed):
    found = groups.describe_subset(mixed, F.col("x") > 0.5)
    assert found[0]["column"] in ("x", "h") and all(np.isfinite(f["v"]) for f in found)
    assert groups.describe_subset(mixed, F.lit(True)) == []
    c = groups.compare_groups(mixed, F.col("h") == "v")
    assert c[0]["column"] in ("h", "x")
    assert groups.typical_rows(mixed, F.col("x") > 0, ["x", "y"], 5).count() == 5


def test_density(mixed):
    lo, hi = density.extent(mixed, F.col("x"))
    grid = density.density(mixed, F.col("x"), F.col("y"), (lo, hi, -10, 10), (10, 10))
    assert grid.agg(F.sum("n")).first()[0] <= 300
    assert abs(density.relief(np.ones((20, 20))) - 1).max() < 1e-9


def test_projections(mixed):
    x = np.random.default_rng(5).normal(size=(80, 4))
    q = embed.neighbourhood_quality(x, x)
    assert q["trust"] == 1 and q["overlap"] == 1
    blobs = np.concatenate([x[:40], x[40:] + 12])
    y = embed.tsne(blobs, 10, 300)
    assert embed.neighbourhood_quality(blobs, y)["trust"] > 0.8 and embed.umap(blobs, 10, rounds=80).shape == (80, 2)
    a = factor.pca(mixed, ["x", "y"])
    s = embed.shepard(a.scores(mixed), ["F1", "F2"], ["F1"], "id").first()
    assert abs(100 * s["kept"] - a.pct[0]) < 0.5


def test_quality(spark):
    rows = [(f"L{i % 2990}", float(i % 50), 1.0 + i % 2, f"2021-{i % 12 + 1:02d}-15", "n/a?" if i % 7 == 0 else str(i % 9)) for i in range(3000)]
    df = spark.createDataFrame(rows + rows[:3], "id string, x double, y double, d string, m string")
    q = typing.quality_report(df)
    kinds = {(i["kind"], i.get("column")) for i in q["issues"]}
    assert ("repeated_id", "id") in kinds and ("date", "d") in kinds and ("mixed", "m") in kinds and q["score"] < 100


def test_insights_are_ranked(lines):
    a = factor.pca(lines, registry.MEASURES, 2)
    found = insights.build(a, lines, key="id")
    assert found == sorted(found, key=lambda x: -x["score"]) and any(x["kind"] == "corr" for x in found)


ADVERSARIAL = {
    "two rows": [["a", "b"], ["1", "2"], ["2", "3"]],
    "constant": [["a", "b"], ["1", "5"], ["2", "5"], ["3", "5"], ["4", "5"]],
    "names": [["x", "x", "", "__proto__"], ["1", "2", "3", "4"], ["2", "3", "4", "6"], ["3", "1", "4", "1"], ["7", "5", "1", "2"]],
    "formats": [["p", "q"], ["1 000 €", "4,5 %"], ["2 000 €", "3,5 %"], ["1 234,50", "1 %"], ["12", "NA"]],
    "texts": [["a", "b"], ["x", "y"], ["x", "z"], ["w", "z"], ["w", "y"]],
    "empty column": [["a", "b", "c"], ["1", "", "2"], ["2", "", "1"], ["3", "", "3"], ["5", "", "2"]],
}


@pytest.mark.parametrize("name", ADVERSARIAL)
def test_adversarial(spark, name):
    df = readers.from_matrix(spark, ADVERSARIAL[name])
    spec = typing.detect(df)
    typing.quality_report(df, spec)
    try:
        got = Engine(spark).load_frame(df).results()
    except ValueError:
        return
    assert all(v is None or np.isfinite(v) for v in got.get("eigenvalues", got.get("vals", [])))


def test_readers(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_bytes("﻿id;prix;cat\r\n1;12,5;A\r\n2;7;\"B;\"\"x\"\"\"\r\n\r\n3;-3,25e1;A\r\n4;\"1 234,5\";NA\r\n".encode())
    df = readers.read(spark, str(p))
    assert [r["prix"] for r in df.orderBy("id").collect()] == [12.5, 7.0, -32.5, 1234.5]
    assert {r["cat"] for r in df.collect()} == {"A", 'B;"x"', None}
    j = tmp_path / "t.json"
    j.write_text('{"data": [{"a": 1, "b": {"c": 2}}, {"a": 2.5, "b": null}]}')
    assert sorted(r["a"] for r in readers.read(spark, str(j)).collect()) == [1.0, 2.5]
    assert readers.sniff_encoding("é".encode("cp1252") * 9) == "windows-1252"
    with pytest.raises(ValueError):
        readers.from_matrix(spark, [["a"]])


def test_excel(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    p = tmp_path / "t.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>day</t></si><si><t>v</t></si><si><t>x</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c></row><row><c r="A2" t="s"><v>3</v></c><c r="B2" s="1"><v>45366</v></c><c r="C2"><v>1.5</v></c></row><row><c r="C3"><v>2</v></c></row></sheetData></worksheet>')
    rows = readers.read(spark, str(p)).orderBy("v").collect()
    assert rows[0].asDict() == {"name": "x", "day": "2024-03-15", "v": 1.5} and rows[1]["name"] is None


def test_writers(spark, mixed, tmp_path):
    a = factor.pca(mixed, ["x", "y"])
    writers.write_results(a, str(tmp_path / "r.json"))
    writers.export_coordinates(a, mixed, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), sep=";", header=True).count() == 300
    assert "<h1>PCA</h1>" in writers.report_html(writers.report(a))
    assert writers.sample(mixed, "id", 20).count() == 20


def test_spec():
    s = AnalysisSpec(method="PCA", vars=("a", "b")).with_role("c", "active").with_role("a", "colour")
    assert AnalysisSpec.from_json(s.to_json()) == s == AnalysisSpec.from_link(s.to_link())
    h = History(s)
    h.put(s.pruned(["b"]))
    assert h.now.vars == ("b",) and h.undo() == s and h.redo().vars == ("b",)


def test_engine(spark, mixed):
    seen = []
    e = Engine(spark)
    e.on("result", seen.append)
    e.load_frame(mixed)
    assert e.run() is seen[0] and e.spec.method == "FAMD"
    e.set_method("PCA").select(F.col("x") > 0)
    assert e.results()["method"] == "PCA" and e.describe_selection()
    assert e.insights() and e.quality()["score"] <= 100


def test_exact_quantiles(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(5_000) < 0.4, 3.0, rng.lognormal(size=5_000))
    df = spark.createDataFrame([(float(v) if i % 9 else None, float(i), 7.0) for i, v in enumerate(x)], "a double, b double, c double")
    shares = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    for sketch, rows in ((10_000, 20_000), (200, 60)):
        monkeypatch.setattr(stats, "SKETCH", sketch)
        monkeypatch.setattr(stats, "BRACKET_ROWS", rows)
        got = stats.exact_quantiles(df, {c: F.col(c) for c in "abc"}, shares)
        for c in "abc":
            assert np.allclose(got[c], np.quantile(np.array([r[c] for r in df.select(c).dropna().collect()]), shares), atol=1e-12)
    assert stats.exact_quantiles(df.limit(0), {"a": F.col("a")}, [0.5]) == {"a": [None]}


def test_impute_on_executors(spark, monkeypatch):
    """Beyond HOLES the rounds run on the executors and end at the driver's fixed point."""
    rng = np.random.default_rng(2)
    f = rng.normal(size=(300, 2))
    x = f @ rng.normal(size=(2, 5)) + 0.1 * rng.normal(size=(300, 5)) + 10
    rows = [(i, *(None if rng.random() < 0.1 else float(v) for v in r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double")
    names = ["a", "b", "c", "d", "e"]
    one = prep.impute_pca(df, names, "id").orderBy("id").toPandas()[names].to_numpy()
    monkeypatch.setattr(prep, "HOLES", 20)
    two = prep.impute_pca(df, names, "id").orderBy("id").toPandas()[names].to_numpy()
    assert not np.isnan(two).any()
    assert np.abs(one - two).max() < 0.01, np.abs(one - two).max()  # the driver stops at a relative change of squares


def test_views(spark):
    from quadrille.functions import text
    from quadrille.operators import views

    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) @ np.array([[1, 0.9, 0, 0], [0, 0.4, 0, 0], [0, 0, 1, -0.8], [0, 0, 0, 0.6]])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double, d double")
    a = factor.pca(df, ["a", "b", "c", "d"])
    assert len(set(views.dominant_axes(a)[:2])) == 1 and views.threshold(a) == 25
    words = views.axis_words(a, 0)
    assert " ↔ " in words and views.axis_words(a, 9) == "—"
    assert sum(c for _, c, _ in views.contributions(a, 0)) == pytest.approx(100)
    assert views.axis_presence(np.eye(4)[:, :3]).tolist() == [1, 1, 1, 0] and views.cell_error(a, 4) == 0
    assert views.encoding(a, "var:a") is not None and views.encoding(a, "mass") is None
    rows, axes = views.parallel_model(a, df)
    assert sorted(rows.columns) == ["a", "b", "c", "d"] and len(axes) == 4
    assert views.within_inertia([3, 2, 1]) == [6, 3, 1]
    cloud = views.main_cloud(a, df, 2)
    assert cloud.agg({"weight": "sum"}).first()[0] == pytest.approx(1)
    assert (text.number(-1234.567), text.number(-0.001), text.number(float("nan")), text.signed(0.5, 1), text.scientific(-0.00123)) == ("−1234,57", "0,00", "—", "+0,5", "−1,2·10⁻³")
    assert (text.listed([]), text.listed(["a", "b", "c"]), text.listed(["a", "b", "c"], 2), text.counted(2, "ligne")) == ("aucune", "a, b et c", "a, b et 1 autre", "2 lignes")


def test_examples_and_start(spark):
    e = Engine(spark).start("?ex=shop&method=PCA")
    assert e.summary()["rows"] == 600 and len(e.types.of("quanti")) == 10 and e.types.of("ident") == ["Client"]
    full = e.table.dropna().count()
    assert 541 <= full <= 599
    kinds = {x["kind"] for x in e.insights()}
    assert {"nonlin", "clusters", "skew"} <= kinds
    s = Engine(spark).start("ex=survey")
    assert s.spec.method == "MCA" and s.summary()["rows"] == 90
    same = Engine(spark).load_example("shop", n=50).table
    assert same.exceptAll(Engine(spark).load_example("shop", n=600).table.limit(600)).count() == 0
    with pytest.raises(ValueError):
        Engine(spark).start("tab=1")


def test_more_readers(spark, tmp_path):
    import zipfile

    (tmp_path / "plain.csv").write_text("a;b\n1,5;x\n2,5;y\n")
    (tmp_path / "broken.csv").write_text('a;b\n1;"x\ny"\n2;"z ""q"""\n')
    assert not readers.cells_span_lines(spark, str(tmp_path / "plain.csv")) and readers.cells_span_lines(spark, str(tmp_path / "broken.csv"))
    assert sorted(map(tuple, readers.read(spark, str(tmp_path / "plain.csv")).collect())) == [(1.5, "x"), (2.5, "y")]
    assert sorted(map(tuple, readers.read(spark, str(tmp_path / "broken.csv")).collect())) == [(1.0, "x\ny"), (2.0, 'z "q"')]
    (tmp_path / "old.xls").write_bytes(b"\xd0\xcf\x11\xe0")
    with pytest.raises(ValueError):
        readers.read(spark, str(tmp_path / "old.xls"))
    names = {"table": "urn:oasis:names:tc:opendocument:xmlns:table:1.0", "office": "urn:oasis:names:tc:opendocument:xmlns:office:1.0", "text": "urn:oasis:names:tc:opendocument:xmlns:text:1.0"}
    cell = lambda v: f'<table:table-cell office:value-type="float" office:value="{v}"><text:p>{v} EUR</text:p></table:table-cell>' if isinstance(v, (int, float)) else f"<table:table-cell><text:p>{v}</text:p></table:table-cell>"
    row = lambda *v, more="": f"<table:table-row{more}>{''.join(map(cell, v))}<table:table-cell table:number-columns-repeated=\"1000\"/></table:table-row>"
    body = row("n", "name") + row(1.5, "a") + row(2, "b", more=' table:number-rows-repeated="2"') + '<table:table-row table:number-rows-repeated="1000000"><table:table-cell/></table:table-row>'
    xml = "<office:document " + " ".join(f'xmlns:{k}="{v}"' for k, v in names.items()) + f"><table:table>{body}</table:table></office:document>"
    with zipfile.ZipFile(tmp_path / "t.ods", "w") as z:
        z.writestr("content.xml", xml)
    assert sorted(map(tuple, readers.read(spark, str(tmp_path / "t.ods")).collect())) == [(1.5, "a"), (2.0, "b"), (2.0, "b")]
    many = [{"a": 1}] * 6_000 + [{"late": 2}]
    assert readers.from_objects(spark, many).columns == ["a", "late"]
    dots = spark.createDataFrame([("2024.03.15",), ("2024/03/15",)], "t string")
    from quadrille.functions.scalars import parse_date

    assert {str(r[0])[:10] for r in dots.select(parse_date(F.col("t"))).collect()} == {"2024-03-15"}


def test_bootstraps_of_other_analyses(spark):
    rng = np.random.default_rng(1)
    kind = rng.integers(0, 3, 1_500)
    rows = [(i, float(kind[i] + rng.normal()), "abc"[kind[i]], "xyz"[(kind[i] + (rng.random() < 0.3)) % 3], "uv"[rng.integers(2)]) for i in range(1_500)]
    df = spark.createDataFrame(rows, "id long, n double, a string, b string, c string")
    for a in (factor.mca(df, ["a", "b", "c"]), factor.famd(df, ["n"], ["a", "b"])):
        b = factor.bootstrap_eigenvalues(a, df, "id", 60)
        assert (b["low"][:2] < a.vals[:2]).all() and (b["high"][:2] > a.vals[:2]).all() and (b["high"] - b["low"] < 0.5).all()
        full = factor._spectrum(df.select(*a.numeric).toPandas().to_numpy(float), np.stack([[float(r[f"{v}"] == x) for r in df.collect()] for v, x in a.levels], 1), a.q, 3.0 if a.method == "MCA" else 1.0)
        assert np.allclose(full, a.vals, atol=1e-9)
    r = factor.ca(df, "a", "b")
    t = factor.bootstrap_table(r, 60)
    assert (t["low"] < r["vals"]).all() and (t["high"] > r["vals"]).all()
