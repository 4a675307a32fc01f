"""The engine behind one object: load a table, analyse it, select, describe, export."""

from __future__ import annotations

import urllib.parse
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cluster, factor, groups, insights, prep, shape, target, typing
from ..sources import examples, readers, writers
from .spec import AnalysisSpec, History


class Engine:
    """Verbs of the host interface: load, set_method, select, summary, results, export."""

    def __init__(self, spark: SparkSession):
        self.spark, self._listeners = spark, {}
        self.table: DataFrame | None = None
        self.types: typing.TableSpec | None = None
        self.analysis = None
        self.selection: Column | None = None
        self.history = History(AnalysisSpec())

    # events
    def on(self, event: str, f: Callable) -> None:
        self._listeners.setdefault(event, []).append(f)

    def emit(self, event: str, what=None) -> None:
        for f in self._listeners.get(event, []):
            f(what)

    # loading
    def load(self, path: str) -> Engine:
        return self.load_frame(readers.read(self.spark, path))

    def load_rows(self, rows: list[dict]) -> Engine:
        return self.load_frame(readers.from_objects(self.spark, rows))

    def load_example(self, name: str, **size) -> Engine:
        return self.load_frame(examples.EXAMPLES[name](self.spark, **size))

    def start(self, arguments: str) -> Engine:
        """From arguments as in a link's query: ``data`` (a path or URL) or ``ex`` (an example), then ``method`` and ``spec``
        (stored settings)."""
        given = dict(urllib.parse.parse_qsl(arguments.lstrip("?")))
        if given.get("ex") in examples.EXAMPLES:
            self.load_example(given["ex"])
        elif "data" in given:
            self.load(given["data"])
        else:
            raise ValueError("neither data nor a known example is given")
        if "spec" in given:
            self.history.put(AnalysisSpec.from_link(given["spec"]).pruned(self.table.columns))
        return self.set_method(given["method"]) if "method" in given else self

    def load_frame(self, df: DataFrame, types: dict[str, str] | None = None) -> Engine:
        self.table = df
        self.types = typing.detect(df)
        for c, r in (types or {}).items():
            self.types = self.types.override(c, r)
        method = typing.suggest(df, self.types)
        d = typing.default_variables(self.types, method)
        self.history = History(AnalysisSpec(method=method, vars=tuple(d["vars"]), color=d["color"], ident=d["ident"]))
        self.analysis, self.selection = None, None
        self.emit("load", self.summary())
        return self

    @property
    def spec(self) -> AnalysisSpec:
        return self.history.now

    def change(self, **settings) -> Engine:
        self.history.put(replace(self.spec, **settings))
        self.analysis = None
        return self

    def set_method(self, method: str) -> Engine:
        d = typing.default_variables(self.types, method, self.spec.target)
        return self.change(method=method, vars=tuple(d["vars"]))

    # work
    def working_table(self) -> DataFrame:
        df = prep.transform(self.table, self.spec.transforms) if self.spec.transforms else self.table
        kinds = dict(df.dtypes)
        numbers = [c for c in self.spec.vars if typing.is_numeric(kinds[c])]
        levels = [c for c in self.spec.vars if c not in numbers]
        return prep.apply_missing(df, self.spec.missing, numbers, levels, self.spec.ident)

    def run(self):
        df, v = self.working_table(), list(self.spec.vars)
        kinds = dict(df.dtypes)
        numbers = [c for c in v if typing.is_numeric(kinds[c])]
        levels = [c for c in v if c not in numbers]
        match self.spec.method:
            case "PCA":
                self.analysis = factor.pca(df, numbers, self.spec.axes)
            case "MCA":
                self.analysis = factor.mca(df, levels, self.spec.axes)
            case "FAMD":
                self.analysis = factor.famd(df, numbers, levels, self.spec.axes)
            case "CA":
                self.analysis = factor.ca(df, levels[0], levels[1]) if len(levels) >= 2 else factor.ca_table(df, self.spec.ident, numbers)
            case other:
                raise ValueError(f"unknown method {other}")
        self.emit("result", self.analysis)
        return self.analysis

    def scores(self) -> DataFrame:
        a = self.analysis or self.run()
        return a.scores(self.working_table())

    def classes(self, k: int | None = None, key: str | None = None) -> tuple[cluster.Classes, DataFrame]:
        a = self.analysis or self.run()
        rows = self.scores()
        c = cluster.hcpc(rows, [f"F{i + 1}" for i in range(a.axes)], key or self.spec.ident, k)
        return c, c.assign(rows)

    def select(self, inside: Column | None, mode: str = "replace") -> Engine:
        if mode == "add" and self.selection is not None:
            inside = self.selection | inside
        elif mode == "toggle" and self.selection is not None:
            inside = self.selection != inside
        self.selection = inside
        self.emit("select", inside)
        return self

    def describe_selection(self) -> list[dict]:
        return groups.explain_selection(self.table, self.selection)

    def compare(self, a: Column, b: Column | None = None) -> list[dict]:
        return groups.compare_groups(self.table, a, b)

    def set_target(self, column: str, positive: str | None = None, depth: int = 3) -> dict:
        spec = replace(self.spec, target=column, vars=tuple(v for v in self.spec.vars if v != column), supplementary=tuple(dict.fromkeys((*self.spec.supplementary, column))))
        self.history.put(spec)
        return target.supervised(self.table, column, [c for c in self.types.of("quanti") + self.types.of("quali") if c != column], positive, depth)

    def insights(self) -> list[dict]:
        """With shapes of the numeric pairs and classes of the rows, where the analysis has an identifier to draw them by."""
        a, df, key = self.analysis or self.run(), self.working_table(), self.spec.ident
        if isinstance(a, dict):
            raise ValueError("insights need an analysis of rows")
        shapes = shape.scan_pairs(df, a.numeric, key) if key and len(a.numeric) > 1 else []
        classes = self.classes()[0] if key else None
        return insights.build(a, df, classes, shapes, key=key, colour=self.spec.color, texts=self.types.of("quali"))

    def quality(self) -> dict:
        return typing.quality_report(self.table, self.types)

    # output
    def summary(self) -> dict:
        return {"rows": self.types.n, "columns": self.table.columns, "roles": self.types.roles, "method": self.spec.method, "vars": list(self.spec.vars)}

    def results(self) -> dict:
        a = self.analysis or self.run()
        return writers.rounded(a) if isinstance(a, dict) else writers.results(a)

    def export(self, path: str) -> None:
        writers.export_coordinates(self.analysis or self.run(), self.working_table(), path)

    def export_selection(self, path: str) -> None:
        writers.export_rows(self.table, path, self.selection if self.selection is not None else F.lit(True))
