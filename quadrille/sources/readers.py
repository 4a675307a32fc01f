"""Tables from CSV, JSON, Parquet and Excel files, URLs and Python objects, and their typing.

CSV is always read as text; one aggregation over all rows decides which columns are numbers. Files are opened by Spark
itself, so any store that Spark reads will do; only a file's first megabytes are looked at on the driver.
"""

from __future__ import annotations

import io
import itertools
import json
import re
import urllib.request
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import finite, is_missing, parse_num
from ..operators.typing import NUMERIC_SHARE, is_numeric

HEAD_BYTES = 2 << 20
DELIMITERS = [",", ";", "\t", "|"]
#: Names that a column may not bear as they are.
RESERVED = {"__proto__", "constructor", "prototype"}
WRAPPERS = ("data", "rows", "records")


# ---------------------------------------------------------------- sniffing


def head_of(spark: SparkSession, path: str, n: int = HEAD_BYTES) -> bytes:
    """A file's first bytes, through Spark's own file systems."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        p = next(s.getPath() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", ".")))
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
    finally:
        stream.close()


def sniff_encoding(head: bytes) -> str:
    """UTF-8, or windows-1252 if the bytes aren't."""
    for cut in range(4):
        try:
            head[: len(head) - cut].decode("utf-8")
            return "UTF-8"
        except UnicodeDecodeError as e:
            if e.start < len(head) - 4:
                return "windows-1252"
    return "windows-1252"


def fields_of(line: str, delimiter: str) -> list[str]:
    """Fields of one line; quotes enclose delimiters and double themselves."""
    out, cell, quoted, i = [], "", False, 0
    while i < len(line):
        c = line[i]
        if quoted:
            if c == '"' and line[i + 1 : i + 2] == '"':
                cell, i = cell + '"', i + 1
            elif c == '"':
                quoted = False
            else:
                cell += c
        elif c == '"' and not cell:
            quoted = True
        elif c == delimiter:
            out.append(cell)
            cell = ""
        else:
            cell += c
        i += 1
    return [*out, cell]


def sniff_delimiter(text: str) -> str:
    """Of at least two header fields, the one with which most lines have as many; ties go to more fields."""
    lines = [x for x in text.splitlines() if x.strip()][:40]
    if not lines:
        return ","

    def rate(d: str) -> tuple[float, int]:
        n = len(fields_of(lines[0], d))
        return (sum(len(fields_of(x, d)) == n for x in lines) / len(lines), n) if n >= 2 else (0.0, 0)

    best = max(DELIMITERS, key=rate)
    return best if rate(best)[1] else ","


def decimal_comma(text: str, delimiter: str) -> bool:
    """More 12,5 than 12.5 in the first lines, with another delimiter than the comma."""
    if delimiter == ",":
        return False
    cells = [c.strip() for x in text.splitlines()[:2000] for c in fields_of(x, delimiter)]
    return sum(bool(re.fullmatch(r"-?\d+,\d+", c)) for c in cells) > sum(bool(re.fullmatch(r"-?\d+\.\d+", c)) for c in cells)


def sniff(head: bytes) -> dict:
    encoding = sniff_encoding(head)
    text = head.decode(encoding, "replace").removeprefix("﻿")
    delimiter = sniff_delimiter(text)
    return {"encoding": encoding, "delimiter": delimiter, "decimal_comma": decimal_comma(text, delimiter)}


def clean_names(names: list[str | None]) -> list[str]:
    """Trimmed; empty ones numbered, repeated ones counted, reserved ones kept apart."""
    out: list[str] = []
    for i, name in enumerate(names):
        base = (name or "").strip().removeprefix("﻿") or f"Colonne {i + 1}"
        base = f"{base} " if base in RESERVED else base
        name, k = base, 2
        while name.lower() in {x.lower() for x in out}:
            name, k = f"{base} ({k})", k + 1
        out.append(name)
    return out


# ---------------------------------------------------------------- typing


def typed(df: DataFrame) -> DataFrame:
    """Missing markers become null, columns of 90 % numbers become doubles, columns without any value go."""
    texts = [c for c, k in df.dtypes if k == "string"]
    if not texts:
        return df
    aggs = []
    for i, c in enumerate(texts):
        s = F.when(~is_missing(F.col(f"`{c}`")), F.col(f"`{c}`"))
        aggs += [F.count(s).alias(f"p{i}"), F.count(parse_num(s)).alias(f"m{i}")]
    r = df.agg(*aggs).first()
    out = []
    for c in df.columns:
        if c not in texts:
            out.append(F.col(f"`{c}`"))
            continue
        i = texts.index(c)
        s = F.when(~is_missing(F.col(f"`{c}`")), F.col(f"`{c}`"))
        if r[f"p{i}"]:
            out.append((parse_num(s) if r[f"m{i}"] >= NUMERIC_SHARE * r[f"p{i}"] else s).alias(c))
    return df.select(*out)


def plain(df: DataFrame) -> DataFrame:
    """Nested cells as JSON text, dates as ISO text, every number as double."""
    out = []
    for c, k in df.dtypes:
        x = F.col(f"`{c}`")
        if k.startswith(("array", "map", "struct")):
            x = F.to_json(x)
        elif k == "date":
            x = F.date_format(x, "yyyy-MM-dd")
        elif k.startswith("timestamp"):
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        elif k == "boolean":
            x = x.cast("string")
        elif is_numeric(k):
            x = finite(x)
        out.append(x.alias(c))
    return df.select(*out)


def flat(df: DataFrame) -> DataFrame:
    """Only columns without structure, as wide tables are read in bulk."""
    return df.select(*(F.col(f"`{c}`") for c, k in df.dtypes if not k.startswith(("array", "map", "struct", "binary"))))


# ---------------------------------------------------------------- readers


def cells_span_lines(spark: SparkSession, path: str) -> bool:
    """Whether some line has an odd number of quotes, as it has if a cell goes on in the next line: one parallel scan."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return spark.read.text(path).where(quotes % 2 == 1).limit(1).count() > 0


def read_csv(spark: SparkSession, path: str, options: dict | None = None, multiline: bool | None = None) -> DataFrame:
    """Text, TSV or CSV with a sniffed encoding and delimiter; short rows are filled up, blank ones skipped. Large files are
    split among tasks unless a cell holds line breaks, which a scan finds out (or ``multiline`` tells)."""
    if multiline is None:
        multiline = cells_span_lines(spark, path)
    o = sniff(head_of(spark, path)) | (options or {})
    raw = spark.read.csv(path, sep=o["delimiter"], header=True, inferSchema=False, quote='"', escape='"', multiLine=multiline, encoding=o["encoding"], mode="PERMISSIVE", enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    # Spark numbers repeated names by their place; the header is read again to name them by their count
    header = fields_of((head_of(spark, path, 1 << 16).decode(o["encoding"], "replace").removeprefix("﻿").splitlines() or [""])[0], o["delimiter"])
    names = clean_names(header if len(header) == len(raw.columns) else raw.columns)
    return typed(raw.toDF(*names).dropna("all"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, or an object that wraps one in data, rows or records."""
    df = spark.read.json(path, multiLine=True)
    for w in WRAPPERS:
        if w in df.columns and dict(df.dtypes)[w].startswith("array<struct"):
            df = df.select(F.explode(w).alias("__r")).select("__r.*")
            break
    return typed(plain(df))


def read_parquet(spark: SparkSession, path: str, bulk: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    return flat(df) if bulk else typed(plain(df))


def from_objects(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Records with any keys; the columns are the union of all records' keys."""
    names = list(dict.fromkeys(k for r in rows for k in r))

    def cell(v):
        if v is None or isinstance(v, float) and not abs(v) < float("inf"):
            return None
        if isinstance(v, datetime):
            return v.strftime("%Y-%m-%d")
        return json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in clean_names(names)])
    return typed(spark.createDataFrame([[cell(r.get(n)) for n in names] for r in rows], schema))


def from_matrix(spark: SparkSession, matrix: list[list]) -> DataFrame:
    """A header row and data rows; blank rows are dropped."""
    rows = [r for r in matrix if any(str(c).strip() for c in r if c is not None)]
    if len(rows) < 2:
        raise ValueError("a header and at least one row are needed")
    names = clean_names([None if c is None else str(c) for c in rows[0]])
    cells = [[None if c is None else str(c) for c in (list(r) + [None] * len(names))[: len(names)]] for r in rows[1:]]
    return typed(spark.createDataFrame(cells, T.StructType([T.StructField(n, T.StringType()) for n in names])))


def read_url(spark: SparkSession, url: str, name: str | None = None) -> DataFrame:
    """A small file over the network, by its content type or name."""
    with urllib.request.urlopen(url) as r:  # noqa: S310
        data, kind = r.read(), r.headers.get_content_type()
    name = name or url.split("?")[0].rsplit("/", 1)[-1]
    if kind.endswith("json") or name.endswith(".json"):
        got = json.loads(data)
        return from_objects(spark, got if isinstance(got, list) else next(got[w] for w in WRAPPERS if w in got))
    if name.endswith((".xlsx", ".xlsm", ".ods")):
        return from_matrix(spark, list(sheet_rows(data)))
    o = sniff(data[:HEAD_BYTES])
    import csv

    return from_matrix(spark, list(csv.reader(io.StringIO(data.decode(o["encoding"], "replace").removeprefix("﻿")), delimiter=o["delimiter"])))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Any of the formats, by the name's ending or the first sign."""
    low = path.lower()
    if low.startswith(("http://", "https://")):
        return read_url(spark, path)
    if low.endswith((".xlsx", ".xlsm", ".ods")):
        return read_excel(spark, path)
    if low.endswith(".xls"):
        raise ValueError("the binary workbooks of before 2007 (.xls) aren't read: save as .xlsx, .ods or .csv")
    if low.rstrip("/").endswith(".parquet"):
        return read_parquet(spark, path)
    if low.endswith(".json") or head_of(spark, path, 64).lstrip()[:1] in (b"[", b"{"):
        return read_json(spark, path)
    return read_csv(spark, path)


# ---------------------------------------------------------------- Excel

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: Built-in number formats that are dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def _date_text(serial: float) -> str:
    if serial < 1:
        return (datetime(1900, 1, 1) + timedelta(seconds=round(serial * 86_400))).strftime("%H:%M:%S")
    d = datetime(1899, 12, 30) + timedelta(seconds=round(serial * 86_400))
    return d.strftime("%Y-%m-%d" if d.time() == datetime.min.time() else "%Y-%m-%d %H:%M:%S")


#: Name spaces of OpenDocument tables.
_TABLE, _OFFICE, _TEXT = (f"{{urn:oasis:names:tc:opendocument:xmlns:{x}:1.0}}" for x in ("table", "office", "text"))
#: Repeated empty cells and rows up to which they are kept; sheets are filled up with far more.
PADDING = 1_000


def _open_rows(data: bytes):
    """Rows of the first table of an OpenDocument sheet: values rather than what is shown, repeats spelled out."""
    depth = 0
    for event, x in ElementTree.iterparse(io.BytesIO(data), ("start", "end")):
        if x.tag == f"{_TABLE}table":
            depth += 1 if event == "start" else -1
            if event == "end" and not depth:
                return
        if event == "start" or x.tag != f"{_TABLE}table-row":
            continue
        out: list[str | None] = []
        for c in x:
            if c.tag not in (f"{_TABLE}table-cell", f"{_TABLE}covered-table-cell"):
                continue
            kind = c.get(f"{_OFFICE}value-type")
            shown = "\n".join("".join(p.itertext()) for p in c.iter(f"{_TEXT}p")) or None
            value = {"float": c.get(f"{_OFFICE}value"), "currency": c.get(f"{_OFFICE}value"), "percentage": c.get(f"{_OFFICE}value"), "date": (c.get(f"{_OFFICE}date-value") or "").replace("T", " "), "boolean": c.get(f"{_OFFICE}boolean-value")}.get(kind) or shown
            times = int(c.get(f"{_TABLE}number-columns-repeated", 1))
            out += [value] * (times if value is not None else min(times, PADDING))
        while out and out[-1] is None:
            out.pop()
        for _ in range(int(x.get(f"{_TABLE}number-rows-repeated", 1)) if out else 1):
            yield list(out)
        x.clear()


def sheet_rows(data: bytes):
    """Rows of a workbook's first sheet as texts; dates as ISO, without shifts of zone."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        if "content.xml" in names:
            yield from _open_rows(z.read("content.xml"))
            return
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        dates: set[int] = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_NS}numFmt")}
            bare = lambda f: re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f)
            is_date = lambda k: k in DATE_FORMATS or bool(re.search("[dmyhs]", bare(own.get(k, "")), re.I)) and "general" not in own.get(k, "").lower()
            cells = styles.find(f"{_NS}cellXfs")
            dates = {i for i, x in enumerate(cells if cells is not None else []) if is_date(int(x.get("numFmtId", 0)))}
        sheet = "xl/worksheets/sheet1.xml" if "xl/worksheets/sheet1.xml" in names else sorted(n for n in names if n.startswith("xl/worksheets/"))[0]
        with z.open(sheet) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_NS}row":
                    continue
                out: list[str | None] = []
                for c in row.iter(f"{_NS}c"):
                    letters = re.match("[A-Z]*", c.get("r", ""))[0]
                    at = len(out)
                    if letters:
                        at = 0
                        for x in letters:
                            at = at * 26 + ord(x) - 64
                        at -= 1
                    out += [None] * (at + 1 - len(out))
                    v, kind = c.find(f"{_NS}v"), c.get("t")
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif v is not None and v.text is not None:
                        if kind == "s":
                            out[at] = shared[int(v.text)]
                        elif kind == "b":
                            out[at] = "true" if v.text == "1" else "false"
                        elif kind in ("str", "e") or int(c.get("s", 0)) not in dates:
                            out[at] = v.text
                        else:
                            out[at] = _date_text(float(v.text))
                yield out
                row.clear()


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet, opened by Spark, so from any store; a workbook is parsed in one task, in batches of rows."""
    header = next((r for r in sheet_rows(head_of(spark, path, 1 << 30)) if any(r)), None)
    if header is None:
        raise ValueError("empty sheet")
    names = clean_names(header)
    width = len(names)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for data in b.column(0).to_pylist():
                rows = (r for r in sheet_rows(data) if any(r))
                next(rows, None)
                while part := list(itertools.islice(rows, 10_000)):
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in part], pa.string()) for i in range(width)], names)

    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return typed(spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema))
