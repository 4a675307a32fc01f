"""WARC archives with a Merkle fixity audit.

Pages become WARC records, dealt to files by ranges of their ids and ordered in them; each record's digest and byte range
come from one narrow pass, so only digests are shuffled. A file's digests and lengths form a tree of fan-out ``FAN`` over
fixed ranges of ids: slots of one id, ranges of slots, ranges of ranges, one root. A node's digest covers its level, its
range, and its children in order: number, offset from where the range begins, length and digest of each. A lost or added
record so changes the ranges that hold it only, though all records behind it move. Two replicas compare roots
first and go down only where ranges differ; the records of the slots at the bottom are matched by their identity (the id;
the url where the id is null), which finds those that are damaged, missing or added.

Defined results: a null url or html is empty; records of a null id go to files of their own below zero, by url; equal ids
are ordered by url and digest; repeated rows are records of their own; an empty table gives no rows; long pages are hashed
whole; further columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored

FAN = 16
#: Ranges above the slots: slots / FAN, slots / FAN**2.
LEVELS = 2
FILE_RECORDS = 4_096

#: The header lines of a record.
HEAD = "WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{id}>\r\nWARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {length}\r\n\r\n"


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A record as text: header, body, two line ends."""
    before, rest = HEAD.split("{id}")
    middle, rest = rest.split("{url}")
    tail, end = rest.split("{length}")
    return F.concat(F.lit(before), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(middle), F.coalesce(url, F.lit("")), F.lit(tail), F.octet_length(F.coalesce(html, F.lit(""))).cast("string"), F.lit(end), F.coalesce(html, F.lit("")), F.lit("\r\n\r\n"))


def write_warc(pages: DataFrame, path: str) -> None:
    """Records as text files, a file per partition in id order. The two line ends that close a record separate the rows."""
    record = record_text(F.col("page_id"), F.col("url").cast("string"), F.col("html").cast("string"))
    pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").repartitionByRange("page_id").sortWithinPartitions("page_id", "url").withColumn("record", record).select(F.expr("left(record, char_length(record) - 4)").alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, url, html of the records in WARC files; each file is cut at record heads by their content lengths."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, urls, bodies = [], [], []
            for data in b.column(0).to_pylist():
                at = 0
                while (end := data.find(b"\r\n\r\n", at)) >= 0:
                    fields = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:])
                    n = int(fields[b"Content-Length"])
                    name = fields.get(b"WARC-Record-ID", b"")[len(b"<urn:page:") : -1]
                    ids.append(int(name) if name else None)
                    urls.append(fields.get(b"WARC-Target-URI", b"").decode())
                    bodies.append(data[end + 4 : end + 4 + n].decode())
                    at = end + 4 + n + 4
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(bodies, pa.string())], ["page_id", "url", "html"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id long, url string, html string")


def manifest(pages: DataFrame) -> DataFrame:
    """A row per record: page_id, url, file_no, record_no, record_offset, record_length, record_sha256."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    text = record_text(F.col("page_id"), url, F.col("html").cast("string"))
    file_no = F.when(F.col("page_id").isNull(), -1 - F.crc32(url.cast("binary")) % 1024).otherwise(F.floor(F.col("page_id") / FILE_RECORDS)).cast("long")
    flat = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").select("page_id", url.alias("url"), file_no.alias("file_no"), F.octet_length(text).cast("long").alias("record_length"), F.sha2(text, 256).alias("record_sha256"))
    order = Window.partitionBy("file_no").orderBy("page_id", "url", "record_sha256")
    return flat.withColumn("record_no", F.row_number().over(order).cast("long") - 1).withColumn("record_offset", F.sum("record_length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("record_length"))


def placed(records: DataFrame) -> DataFrame:
    """``records`` with the identity of each, and its slot in the file, which other records don't move."""
    null = F.col("page_id").isNull()
    slot = F.when(null, F.floor(F.crc32(F.col("url").cast("binary")) / 1024) % FILE_RECORDS).otherwise(F.pmod(F.col("page_id"), F.lit(FILE_RECORDS)))
    return records.withColumn("identity", F.when(null, F.concat(F.lit("url:"), "url")).otherwise(F.col("page_id").cast("string"))).withColumn("slot", slot.cast("long"))


def tree(records: DataFrame) -> list[DataFrame]:
    """The tree's levels, slots first, each (file_no, no, length, digest); the last is the files' roots, with no = 0."""
    counted = records.groupBy("file_no", F.col("slot").alias("no"), "identity", "record_sha256", "record_length").agg(F.count(F.lit(1)).alias("rows"))
    leaf = F.concat_ws(" ", "identity", "record_sha256", "record_length", "rows")
    named = lambda level, text: F.sha2(F.concat(F.concat_ws(" ", F.lit(level), "file_no", "no"), F.lit("\n"), text), 256)
    slots = counted.groupBy("file_no", "no").agg(F.sum(F.col("record_length") * F.col("rows")).alias("length"), F.array_join(F.sort_array(F.collect_list(leaf)), "\n").alias("text"))
    levels = [slots.select("file_no", "no", "length", named(0, F.col("text")).alias("digest"))]
    for k in range(LEVELS + 1):
        up = F.floor(F.col("no") / FAN) if k < LEVELS else F.lit(0)
        children = levels[-1].groupBy("file_no", up.cast("long").alias("up")).agg(F.sort_array(F.collect_list(F.struct("no", "length", "digest"))).alias("children"))
        begun = F.aggregate("children", F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")), lambda t, c: F.struct(F.concat(t["text"], F.concat_ws(" ", c["no"], t["at"], c["length"], c["digest"]), F.lit("\n")).alias("text"), (t["at"] + c["length"]).alias("at")))
        folded = children.select("file_no", F.col("up").alias("no"), begun.alias("all"))
        levels.append(folded.select("file_no", "no", F.col("all.at").alias("length"), named(k + 1, F.col("all.text")).alias("digest")))
    return levels


def differing(a: list[DataFrame], b: list[DataFrame]) -> list[DataFrame]:
    """Per level, roots first, the ranges (file_no, no) on which the replicas differ; below, only their children are compared."""
    found: list[DataFrame] = []
    for depth, (x, y) in enumerate(zip(reversed(a), reversed(b), strict=True)):
        if depth:
            up = F.floor(F.col("no") / FAN) if depth > 1 else F.lit(0)
            parents = found[-1].select("file_no", F.col("no").alias("up"))
            x, y = (t.withColumn("up", up.cast("long")).join(parents, ["file_no", "up"], "left_semi").drop("up") for t in (x, y))
        both = x.select("file_no", "no", F.col("digest").alias("x")).join(y.select("file_no", "no", F.col("digest").alias("y")), ["file_no", "no"], "full_outer")
        found.append(stored(both.where(~F.col("x").eqNullSafe(F.col("y"))).select("file_no", "no")))
    return found


def unmatched(a: DataFrame, b: DataFrame, slots: DataFrame) -> DataFrame:
    """The records of differing slots without an equal one on the other side: ``a``'s and ``b``'s columns as structs x and y,
    paired in order where both have records of an identity left. y alone is added, x alone is missing, both is damaged."""
    equal = ["file_no", "slot", "identity", "record_sha256", "record_length"]
    where = slots.select("file_no", F.col("no").alias("slot"))
    sides = [t.join(where, ["file_no", "slot"], "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy(*equal).orderBy("record_no"))) for t in (a, b)]
    left = []
    for mine, other, name in ((*sides, "x"), (*reversed(sides), "y")):
        alone = mine.join(other.select(*equal, "nth"), [*equal, "nth"], "left_anti")
        order = F.row_number().over(Window.partitionBy("file_no", "slot", "identity").orderBy("record_no"))
        left.append(alone.withColumn("nth", order).select("file_no", "slot", "identity", "nth", F.struct(*a.columns).alias(name)))
    return left[0].join(left[1], ["file_no", "slot", "identity", "nth"], "full_outer").select("x", "y")


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """The primary's records with their range, digest, their file's root, how deep the comparison went for them (0: the roots
    agree), whether the replica has them intact, and the state (intact, damaged, missing); then the records that only the
    replica has, with their ranges there, as not intact and added. The root is the primary's, null for a file it hasn't."""
    a, b = stored(placed(manifest(primary))), stored(placed(manifest(replica)))
    mine = tree(a)
    found = differing(mine, tree(b))
    bad = stored(unmatched(a, b, found[-1]))
    out = a
    flags = []
    for depth, ranges in enumerate(found[:-1]):
        no = F.lit(0) if depth == 0 else F.floor(F.col("slot") / FAN ** (len(found) - 1 - depth))
        flag = f"differs_{depth}"
        flags.append(flag)
        out = out.withColumn("no", no.cast("long")).join(ranges.withColumn(flag, F.lit(1)), ["file_no", "no"], "left").drop("no")
    depth = reduce(lambda x, y: x + y, (F.coalesce(F.col(f), F.lit(0)) for f in flags))
    wrong = bad.where("x is not null").select("x.file_no", "x.record_no", F.when(F.col("y").isNull(), "missing").otherwise("damaged").alias("wrong"))
    record = ["page_id", "file_no", "record_no", "record_offset", "record_length", "record_sha256"]
    kept = out.join(wrong, ["file_no", "record_no"], "left").select(*record, depth.cast("int").alias("depth"), F.col("wrong").isNull().alias("intact"), F.coalesce("wrong", F.lit("intact")).alias("state"))
    added = bad.where("x is null").select(*(f"y.{c}" for c in record), F.lit(len(flags)).alias("depth"), F.lit(False).alias("intact"), F.lit("added").alias("state"))
    return kept.unionByName(added).join(mine[-1].select("file_no", F.col("digest").alias("root_sha256")), "file_no", "left")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with decayed records, for the query: a changed first sign in every 997th page, a lost half in every 1999th,
    every 1499th missing, and a second record of every 1777th id."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rot = F.concat(F.lit("#"), F.substring(body, 2, 2**31 - 1))
    cut = F.expr("left(coalesce(html, ''), cast(char_length(coalesce(html, '')) div 2 as int))")
    kept = pages.where(F.coalesce(F.col("page_id") % 1499 != 7, F.lit(True))).select("page_id", "url", F.when(F.col("page_id") % 997 == 13, rot).when(F.col("page_id") % 1999 == 5, cut).otherwise(body).alias("html"))
    return kept.unionByName(pages.where(F.col("page_id") % 1777 == 11).select("page_id", F.concat(F.coalesce("url", F.lit("")), F.lit("#2")).alias("url"), F.lit("second").alias("html")))


def op10_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return audit(pages, damaged(pages))


def _oracle() -> str:
    """The same by DuckDB: manifests of both replicas, records matched one by one, the primary's tree."""
    head = HEAD.replace("\r\n", "' || chr(13) || chr(10) || '")
    text = "'" + head.replace("{id}", "' || coalesce(CAST(page_id AS VARCHAR), '') || '").replace("{url}", "' || coalesce(url, '') || '").replace("{length}", "' || CAST(strlen(body) AS VARCHAR) || '") + "' || body || chr(13) || chr(10) || chr(13) || chr(10)"

    def side(name: str, rows: str) -> str:
        return f"""{name}0 AS ({rows}),
{name}1 AS (SELECT page_id, coalesce(url, '') AS url, CAST(floor(page_id / {FILE_RECORDS}.0) AS BIGINT) AS file_no, {text} AS rec FROM {name}0),
{name}2 AS (SELECT page_id, url, file_no, CAST(strlen(rec) AS BIGINT) AS record_length, sha256(rec) AS record_sha256 FROM {name}1),
{name}3 AS (SELECT *, row_number() OVER w - 1 AS record_no, CAST(sum(record_length) OVER (w ROWS UNBOUNDED PRECEDING) - record_length AS BIGINT) AS record_offset FROM {name}2 WINDOW w AS (PARTITION BY file_no ORDER BY page_id, url, record_sha256)),
{name} AS (SELECT *, page_id % {FILE_RECORDS} AS slot, row_number() OVER (PARTITION BY page_id, record_sha256 ORDER BY record_no) AS nth FROM {name}3)"""

    rotten = "CASE WHEN page_id % 997 = 13 THEN '#' || substr(coalesce(html, ''), 2) WHEN page_id % 1999 = 5 THEN left(coalesce(html, ''), length(coalesce(html, '')) // 2) ELSE coalesce(html, '') END"
    other = f"SELECT page_id, url, {rotten} AS body FROM pages WHERE page_id % 1499 <> 7 UNION ALL SELECT page_id, coalesce(url, '') || '#2', 'second' FROM pages WHERE page_id % 1777 = 11"
    levels, last = [], "t0"
    for k in range(1, LEVELS + 2):
        up = f"no // {FAN}" if k <= LEVELS else "0"
        levels.append(f"""s{k} AS (SELECT file_no, {up} AS up, no, length, digest, CAST(sum(length) OVER (PARTITION BY file_no, {up} ORDER BY no) - length AS BIGINT) AS begun FROM {last}),
t{k} AS (SELECT file_no, up AS no, CAST(sum(length) AS BIGINT) AS length, sha256('{k} ' || file_no || ' ' || up || chr(10) || string_agg(no || ' ' || begun || ' ' || length || ' ' || digest || chr(10), '' ORDER BY no)) AS digest FROM s{k} GROUP BY file_no, up)""")
        last = f"t{k}"
    record = "page_id, file_no, record_no, record_offset, record_length, record_sha256"
    return f"""
WITH {side("a", "SELECT page_id, url, coalesce(html, '') AS body FROM pages")},
{side("b", other)},
ua AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY record_no) AS k FROM a ANTI JOIN b USING (file_no, page_id, record_sha256, nth)),
ub AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY record_no) AS k FROM b ANTI JOIN a USING (file_no, page_id, record_sha256, nth)),
bad AS (SELECT DISTINCT file_no, slot FROM (SELECT file_no, slot FROM ua UNION ALL SELECT file_no, slot FROM ub)),
mine AS (SELECT ua.file_no, ua.record_no, CASE WHEN ub.k IS NULL THEN 'missing' ELSE 'damaged' END AS state FROM ua LEFT JOIN ub USING (file_no, page_id, k)),
out0 AS (SELECT {record}, CAST((CASE WHEN a.file_no IN (SELECT file_no FROM bad) THEN 1 ELSE 0 END) + (CASE WHEN (a.file_no, slot // {FAN * FAN}) IN (SELECT (file_no, slot // {FAN * FAN}) FROM bad) THEN 1 ELSE 0 END) + (CASE WHEN (a.file_no, slot // {FAN}) IN (SELECT (file_no, slot // {FAN}) FROM bad) THEN 1 ELSE 0 END) AS INTEGER) AS depth, coalesce(state, 'intact') = 'intact' AS intact, coalesce(state, 'intact') AS state FROM a LEFT JOIN mine USING (file_no, record_no)
UNION ALL SELECT {record}, {LEVELS + 1}, false, 'added' FROM ub ANTI JOIN ua USING (file_no, page_id, k)),
g AS (SELECT file_no, slot AS no, page_id, record_sha256, record_length, count(*) AS n FROM a GROUP BY ALL),
t0 AS (SELECT file_no, no, CAST(sum(record_length * n) AS BIGINT) AS length, sha256('0 ' || file_no || ' ' || no || chr(10) || string_agg(page_id || ' ' || record_sha256 || ' ' || record_length || ' ' || n, chr(10) ORDER BY page_id || ' ' || record_sha256 || ' ' || record_length || ' ' || n)) AS digest FROM g GROUP BY file_no, no),
{", ".join(levels)}
SELECT out0.*, {last}.digest AS root_sha256 FROM out0 LEFT JOIN {last} USING (file_no)"""


ORACLE_SQL = {"op10_merkle_audit": _oracle()}
