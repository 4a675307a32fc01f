"""Embedding near-dedup by product quantisation.

A coarse codebook deals unit vectors to inverted lists; a vector's residual is coded in subspaces, and the code's error is
kept with it. A query visits its own list and the lists that can hold a partner: with chord d = sqrt(2 - 2 t) at
similarity t, a partner in another list lies beyond the plane between both centroids, so the plane is nearer than d. The
part of a difference of length d that stands on a plane is about d / sqrt(dimensions), so lists whose plane is farther than
``REACH`` times that aren't visited (with 16 dimensions or less that leaves out none). There, table look-ups give the
distance to each coded vector; a partner's can't exceed d plus the stored error, so nothing visited is lost; what passes is
reranked by the exact cosine. Codebooks are fitted on a bounded sample; every vector is indexed. Recall is measured against
brute force in the tests.

Equal vectors of a label are one entry with a weight. A list is cut into parts of bounded size; a group holds two of them (or
one part and guests, in parts as well), each pair of parts meets once, and what a group returns is a count and a local root
per vector, never its pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those of a null label,
link with nothing; vectors of different lengths don't link; repeated ids count as vectors of their own with one id; an empty
table gives no rows; further columns don't matter. Vectors are scaled by their largest component first, so that no finite
one overflows or vanishes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored
from .components import components

SIMILARITY = 0.98
#: Vectors on which the codebooks are fitted, taken by hash order.
SAMPLE = 16_384
MAX_LISTS = 1_024
PARTS = 8
CODES = 64
#: Vectors of a list that stand in one part.
LIST_ROWS = 2_048
#: Standard deviations of a difference's part on a plane up to which lists are visited.
REACH = 4.0


@dataclass
class Codebooks:
    coarse: np.ndarray
    parts: list[np.ndarray]
    cuts: list[np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes and the code's error of unit vectors."""
        cell = np.concatenate([np.argmax(x[i : i + 8192] @ self.coarse.T - 0.5 * (self.coarse**2).sum(1), 1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)
        rest = x - self.coarse[cell]
        codes = np.stack([_nearest(rest[:, c], book) for c, book in zip(self.cuts, self.parts, strict=True)], 1).astype(np.uint8)
        for m, (c, book) in enumerate(zip(self.cuts, self.parts, strict=True)):
            rest[:, c] -= book[codes[:, m]]
        return cell, codes, np.sqrt((rest**2).sum(1))

    def visits(self, x: np.ndarray, cell: np.ndarray, chord: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the further lists to visit. Of two lists only the pair's lower one visits the other."""
        rows, lists = [], []
        norms = (self.coarse**2).sum(1)
        for i in range(0, len(x), 4096):
            own = cell[i : i + 4096]
            score = x[i : i + 4096] @ self.coarse.T - 0.5 * norms
            gap = np.sqrt(np.maximum(norms[own][:, None] + norms[None, :] - 2 * self.coarse[own] @ self.coarse.T, 0))
            near = score[np.arange(len(own)), own][:, None] - score <= chord * gap + 1e-9
            near &= np.arange(len(self.coarse))[None, :] > own[:, None]
            r, c = np.nonzero(near)
            rows.append(r + i)
            lists.append(c)
        return (np.concatenate(rows), np.concatenate(lists)) if rows else (np.zeros(0, np.int64),) * 2

    def distances(self, x: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """From each query to each coded vector of a list, by table look-up."""
        rest = x - self.coarse[cell]
        out = np.zeros((len(x), len(codes)))
        for m, (c, book) in enumerate(zip(self.cuts, self.parts, strict=True)):
            table = ((rest[:, c][:, None, :] - book[None, :, :]) ** 2).sum(2)
            out += table[:, codes[:, m]]
        return np.sqrt(out)


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmax(x @ book.T - 0.5 * (book**2).sum(1), 1)


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    book = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([_nearest(x[i : i + 8192], book) for i in range(0, len(x), 8192)])
        total = np.zeros_like(book)
        np.add.at(total, own, x)
        many = np.bincount(own, minlength=k)
        book[many > 0] = total[many > 0] / many[many > 0][:, None]
    return book


def fit(x: np.ndarray, lists: int) -> Codebooks:
    coarse = _kmeans(x, lists)
    cuts = [c for c in np.array_split(np.arange(x.shape[1]), PARTS) if len(c)]
    rest = x - coarse[_nearest(x, coarse)]
    return Codebooks(coarse, [_kmeans(rest[:, c], CODES) for c in cuts], cuts)


def _unit(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, padded to one width, and their directions."""
    raw = np.zeros((len(rows), width))
    for i, v in enumerate(rows):
        raw[i, : len(v)] = v
    raw /= np.abs(raw).max(1, keepdims=True)
    return raw, raw / np.sqrt((raw**2).sum(1))[:, None]


def _index(books: Codebooks, width: int, chord: float):
    """A row for each list that a vector stands in or visits."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            _, x = _unit(b.column(4).to_pylist(), width)
            cell, codes, error = books.encode(x)
            row, visit = books.visits(x, cell, chord * min(1.0, REACH / np.sqrt(width)))
            every = np.concatenate([np.arange(len(x)), row])
            home = np.concatenate([np.ones(len(x), bool), np.zeros(len(row), bool)])
            taken = [c.take(pa.array(every)) for c in b.columns]
            yield pa.RecordBatch.from_arrays(
                [*taken, pa.array(np.concatenate([cell, visit]).astype(np.int32)), pa.array(home), pa.array([codes[i].tobytes() if h else None for i, h in zip(every, home, strict=True)], pa.binary()), pa.array(np.where(home, error[every], 0.0))],
                ["node", "label", "width", "weight", "vector", "cell", "home", "codes", "error"],
            )

    return run


def _match(books: Codebooks, width: int, similarity: float, chord: float):
    """A group's vectors with the weight of their partners in it, and their root among its links."""

    def run(table):
        import pyarrow as pa

        cell = table.column("cell")[0].as_py()
        node = table.column("node").to_numpy()
        weight = table.column("weight").to_numpy()
        raw, x = _unit(table.column("vector").to_pylist(), width)
        asks, stands = (table.column(c).to_numpy(zero_copy_only=False) for c in ("asks", "stands"))
        at, queries = np.flatnonzero(stands), np.flatnonzero(asks)
        codes = np.frombuffer(b"".join(table.column("codes").filter(pa.array(stands)).to_pylist()), np.uint8).reshape(len(at), -1)
        error = table.column("error").to_numpy()[at]
        size = np.sqrt((raw**2).sum(1))
        links = np.zeros(len(node), np.int64)
        root = np.arange(len(node))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(0, len(queries) if len(at) else 0, 256):
            mine = queries[i : i + 256]
            near = books.distances(x[mine], cell, codes) <= chord + error[None, :] + 1e-9
            # within a part each pair is met once, by its smaller node
            near &= ~stands[mine][:, None] | (node[mine][:, None] < node[at][None, :])
            q, k = np.nonzero(near)
            q, k = mine[q], at[k]
            for j in range(0, len(q), 65_536):
                a, b = q[j : j + 65_536], k[j : j + 65_536]
                hit = (raw[a] * raw[b]).sum(1) / (size[a] * size[b]) >= similarity
                a, b = a[hit], b[hit]
                np.add.at(links, a, weight[b])
                np.add.at(links, b, weight[a])
                for u, v in zip(a.tolist(), b.tolist(), strict=True):
                    u, v = find(u), find(v)
                    if u != v:
                        root[max(u, v)] = min(u, v)
        linked = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[linked]), "links": pa.array(links[linked]), "root": pa.array(np.array([node[find(i)] for i in linked.tolist()], np.int64))})

    return run


def near_vectors(table: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """vec_id, n_links, component_id, kept of a table with vec_id, embedding, label."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    sane = F.col("label").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("sane", F.coalesce(sane, F.lit(False))).withColumn("key", F.when(F.col("sane"), F.sha2(F.concat(F.to_binary(F.hex("label")), F.lit(b"\0"), F.to_binary(F.hex(F.array_join(F.transform("vector", lambda v: F.hex((v + F.lit(0.0)).cast("string"))), ",")))), 256)))
    # equal vectors of a label are one entry, named by its smallest id; a key is the digest of label and components
    entries = stored(rows.where("sane").groupBy("key").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.min("label").alias("label"), F.min("vector").alias("vector")).select(F.xxhash64("key").alias("node"), "key", "least", "weight", "label", "vector", F.size("vector").alias("width")))
    number, width = entries.agg(F.count(F.lit(1)), F.max("width")).first()
    if number:
        sample = entries.select("node", "vector").orderBy("node").limit(SAMPLE).collect()
        books = fit(_unit([r["vector"] for r in sample], width)[1], int(min(MAX_LISTS, max(1, round(number**0.5)))))
        chord = float(np.sqrt(max(0.0, 2 - 2 * similarity)))
        indexed = stored(entries.select("node", "label", "width", "weight", "vector").mapInArrow(_index(books, width, chord), "node long, label string, width int, weight long, vector array<double>, cell int, home boolean, codes binary, error double"))
        parts = indexed.groupBy("label", "width", "cell").agg(F.ceil(F.count_if("home") / LIST_ROWS).alias("salts"), F.ceil(F.count_if(~F.col("home")) / LIST_ROWS).alias("guests")).where("salts > 0")
        number = F.when(F.col("home"), F.col("salts")).otherwise(F.col("guests"))
        dealt = indexed.join(parts, ["label", "width", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), number))
        every = F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)
        # group (ask, stand): part ``ask`` of the list's own vectors, or of its guests (below zero), asks part ``stand``. Own
        # parts meet in one order; a vector stands in the groups of its part
        own = F.transform(F.filter(every, lambda k: k >= F.col("part")), lambda k: F.struct(F.col("part").alias("ask"), k.alias("stand"), F.lit(True).alias("asks"), (k == F.col("part")).alias("stands")))
        stood = F.transform(F.filter(every, lambda k: k < F.col("part")), lambda k: F.struct(k.alias("ask"), F.col("part").alias("stand"), F.lit(False).alias("asks"), F.lit(True).alias("stands")))
        hosts = F.transform(F.when(F.col("guests") > 0, F.sequence(F.lit(1).cast("long"), F.col("guests"))).otherwise(F.array().cast("array<long>")), lambda g: F.struct((-g).alias("ask"), F.col("part").alias("stand"), F.lit(False).alias("asks"), F.lit(True).alias("stands")))
        asked = F.transform(every, lambda k: F.struct((-F.col("part") - 1).alias("ask"), k.alias("stand"), F.lit(True).alias("asks"), F.lit(False).alias("stands")))
        spread = dealt.withColumn("to", F.explode(F.when(F.col("home"), F.concat(own, stood, hosts)).otherwise(asked))).select("*", "to.ask", "to.stand", "to.asks", "to.stands").drop("to", "salts", "guests", "part")
        met = stored(spread.groupBy("label", "width", "cell", "ask", "stand").applyInArrow(_match(books, width, similarity, chord), "node long, links long, root long"))
        linked = met.groupBy("node").agg(F.sum("links").alias("links"))
        groups = components(met.select(F.col("node").alias("a"), F.col("root").alias("b")))
        named = entries.join(linked, "node", "left").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        found = named.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    else:
        found = entries.select("key", F.lit(0).cast("long").alias("n_links"), F.col("least").alias("component_id"))
    out = rows.select("vec_id", "key").join(found, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
