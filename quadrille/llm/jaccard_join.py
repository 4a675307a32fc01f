"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents are sets of word shingles. All shingles are ordered by the number of documents that have them, rare ones first
(counted over the whole corpus, see blocks). Two sets of similarity t share a shingle among their first
n - ceil(t n) + 1 ones; shingles that only one document has fill most prefixes and are never sent. Sets meet on shared
prefix shingles and pass the length filter, the positional filter (what the places of the shared prefix shingles leave
possible) and the suffix filter (what a split of the rest around a pivot leaves possible) before the whole sets are
compared, once per pair.

Only components are asked for, so copies needn't meet in all pairs. Equal sets are one node from the start. Each node
then meets the hub with which it shares most prefix shingles; hubs' groups, cut to a bounded size, are compared to
leaders, and verified links make clusters. In one round each node visits one of the largest other clusters that it
shares prefix shingles with, and goes over it until a link is found. What is left are pairs between different clusters:
those that share a prefix shingle are paired, and the smaller one's nodes visit the larger one; lone nodes are paired at
their first shared prefix shingle alone, where the smaller set needs to hold it within its shorter index prefix. A pair is
verified once at most: nodes carry which others they were compared with in vain, and which cluster they have visited, and
visits skip these pairs; pairs within a cluster are never compared. Every pair of nodes that passes the filters is either
verified or already known to be in one cluster, so no link between clusters is lost.

Defined results: documents without words (null, empty, blank) have the empty set and link with nothing; fewer words than
a shingle make one shingle of the whole sequence; rows with a null id take part and get their group's smallest id, which
is null if the group has none; repeated rows are equal sets; an empty table gives no rows; very long texts are taken whole;
ties in rarity go by the shingle's hash; further columns don't matter.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U64, Block, blocks_of, count_keys, counted, distinct, expand, expand_sorted, joined_reply, mix, squeeze, squeeze_sorted, with_replies, word_hashes
from .common import read_table, snug, stored
from .components import components

SHINGLE = 5
PERCENT = 75
#: Nodes that stand in one group, and leaders tried for one of them.
GROUP = 512
LEADERS = 24
#: Rows of small tables, and sets, that one task takes.
ROWS, SETS = 100_000, 2_000
#: Words of the bitmap that stands for a set in the bitmap filter.
BITMAP = 8


def shingle_sets(block: Block, size: int = SHINGLE) -> list[np.ndarray]:
    """Each document's distinct shingles as sorted 64-bit hashes."""
    words, of, number = word_hashes(block)
    out: list[np.ndarray] = [np.zeros(0, U64)] * len(block)
    factor = U64(0xD6E8FEB86659FD93)
    ends = np.cumsum(number)
    if len(words) >= size:
        hashes = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            hashes = hashes * factor + words[k : len(words) - size + 1 + k]
        hashes = mix(hashes)
    for i, n in enumerate(number.tolist()):
        if n >= size:
            out[i] = distinct(hashes[ends[i] - n : ends[i] - size + 1])
        elif n:
            h = np.array([n], U64)
            for w in words[ends[i] - n : ends[i]]:
                h = h * factor + w
            out[i] = mix(h ^ U64(0xA0761D6478BD642F))
    return out


def short(hashes: np.ndarray) -> np.ndarray:
    """48 bits of each hash, sorted and distinct: what is counted, shipped and compared. A chance meeting of two shingles
    within a pair of a thousand shingles each has a probability of about 1e-9."""
    return distinct(hashes >> U64(16))


def packed_set(hashes: np.ndarray) -> bytes:
    return squeeze(*squeeze_sorted(hashes))


def unpacked_set(data: bytes) -> np.ndarray:
    return expand_sorted(expand(data)[0])


def parity_bits(hashes: np.ndarray) -> list[int]:
    """A bitmap in which every shingle turns one bit. Where two sets' bitmaps differ, their difference has a shingle."""
    number = np.bincount((mix(hashes ^ U64(0x632BE59BD9B4E019)) % U64(64 * BITMAP)).astype(np.int64), minlength=64 * BITMAP)
    return np.packbits((number & 1).astype(np.uint8), bitorder="little").view(np.int64).tolist()


def set_key(hashes: np.ndarray) -> int:
    """A 63-bit name of a set."""
    return int(mix(np.array([mix(hashes ^ U64(0x8EBC6AF09C88C6E3)).sum(dtype=U64) + U64(len(hashes))], U64))[0] >> U64(1))


def needed(n_x, n_y, percent: int):
    """The overlap from which 100 * overlap >= percent * union."""
    return -(-percent * (n_x + n_y) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 2) -> int:
    """At most how many values two sorted arrays share: split at a pivot, the sides can't share more than the smaller has."""
    if not len(x) or not len(y):
        return 0
    if depth == 0:
        return min(len(x), len(y))
    mid = len(y) // 2
    at = int(np.searchsorted(x, y[mid]))
    hit = int(at < len(x) and x[at] == y[mid])
    return suffix_bound(x[:at], y[:mid], depth - 1) + hit + suffix_bound(x[at + hit :], y[mid + 1 :], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool | None:
    """The exact test over sorted hashes; None if length or suffix filter rule a link out before."""
    need = needed(len(x), len(y), percent)
    if min(len(x), len(y)) < need or suffix_bound(x, y) < need:
        return None
    return int(np.isin(x, y, assume_unique=True, kind="sort").sum()) >= need


def key_bits(n_blocks: int) -> int:
    """Bits of a hash that are counted: as many as leave some 1 in 10,000 shingles to meet another one by chance, at any
    size of the input. Such a meeting makes a shingle look less rare, no more."""
    return min(48, 32 + max(0, n_blocks - 1).bit_length())


def block_keys(size: int, bits: int):
    """Distinct short hashes of a block's sets, cut to ``bits`` bits, and the number of its documents that have them."""

    def keys(block: Block) -> tuple[np.ndarray, np.ndarray]:
        sets = [distinct(short(x) >> U64(48 - bits)) for x in shingle_sets(block, size)]
        return counted(np.concatenate(sets)) if sets else (np.zeros(0, U64), np.zeros(0, np.int64))

    return keys


def _describe(percent: int, size: int, bits: int):
    """Blocks with replies to rows: doc_id, n_shingles, node, and for sets with candidates their prefix and hashes; a set
    that a block holds several times brings them once."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for data, replies in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                block = Block(data)
                sets = shingle_sets(block, size)
                shorts = [short(s) for s in sets]
                asked = distinct(np.concatenate(shorts) >> U64(48 - bits)) if sets else np.zeros(0, U64)
                totals = joined_reply(replies)
                rows, seen = [], set()
                for s, x in zip(sets, shorts, strict=True):
                    node = set_key(s) if len(s) else None
                    rows.append((node, None, None, None, None))
                    if node is None or node in seen:
                        continue
                    seen.add(node)
                    count = totals[np.searchsorted(asked, x >> U64(48 - bits))]
                    # positions are those in the short set; the prefix length is the true set's, so that hashes that
                    # fall together never shorten it
                    alone, length = int((count == 1).sum()), prefix_length(len(s), percent)
                    if alone < length:
                        shared = count > 1
                        # rare first, ties by the hash
                        order = np.lexsort((x[shared], count[shared]))[: length - alone]
                        rows[-1] = (node, alone, x[shared][order].tobytes(), packed_set(x), parity_bits(x))
                node, start, prefix, hashes, bits_ = zip(*rows, strict=True) if rows else ((),) * 5
                yield pa.RecordBatch.from_arrays(
                    [block.id_column(), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(start, pa.int32()), pa.array(prefix, pa.binary()), pa.array(hashes, pa.binary()), pa.array(bits_, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "node", "start", "prefix", "hashes", "bits"],
                )

    return run


def _prefix_rows(batches):
    """(token, node, n, place) of every prefix shingle that is sent."""
    import pyarrow as pa

    for b in batches:
        tokens = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
        if not tokens:
            continue
        sizes = np.array([len(t) for t in tokens])
        node, n, start = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.repeat(node, sizes)), pa.array(np.repeat(n, sizes)), pa.array(place.astype(np.int32))], ["token", "node", "n", "place"])


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits a bitmap differs from each of several."""
    return np.bitwise_count((x ^ y).view(U64)).sum(1, dtype=np.int64)


def _lead(percent: int):
    """Within a hub's group: each node is compared to the leaders so far; without a link it becomes one. (a, b, hit): the
    pairs that were verified."""

    def run(table):
        import pyarrow as pa

        nodes = table.column("node").to_pylist()
        sets = [unpacked_set(x) for x in table.column("hashes").to_pylist()]
        leaders: list[int] = []
        seen: set[tuple[int, int]] = set()
        found: list[tuple[int, int, bool]] = []
        for i in np.argsort([len(s) for s in sets], kind="stable").tolist():
            for k in leaders[:LEADERS]:
                if nodes[k] == nodes[i]:
                    break
                pair = (nodes[k], nodes[i])
                if pair in seen or (hit := linked(sets[k], sets[i], percent)) is None:
                    continue
                seen.add(pair)
                found.append((*pair, hit))
                if hit:
                    # the leader that took a node is tried first for the next
                    leaders.remove(k)
                    leaders.insert(0, k)
                    break
            else:
                leaders.insert(0, i)
        return pa.table({"a": pa.array([x for x, *_ in found], pa.int64()), "b": pa.array([x for _, x, _ in found], pa.int64()), "hit": pa.array([x for *_, x in found], pa.bool_())})

    return run


def _visit(percent: int):
    """A part of a cluster and its visitors: a link for each visitor that has one. Hosts pass the length and the bitmap filter
    and weren't compared with the visitor before; the most alike is verified first, until one links."""

    def run(table):
        import pyarrow as pa

        guest = table.column("guest").to_numpy(zero_copy_only=False)
        nodes = table.column("node").to_numpy()
        was, went, tried = (table.column(c).to_pylist() for c in ("was", "went", "tried"))
        sets = [unpacked_set(x) for x in table.column("hashes").to_pylist()]
        hosts = np.array(sorted(np.flatnonzero(~guest).tolist(), key=lambda i: (len(sets[i]), nodes[i])), np.int64)
        links = []
        if len(hosts):
            sizes = np.array([len(sets[i]) for i in hosts])
            maps = np.array([parity_bits(sets[i]) for i in hosts], np.int64)
            names = nodes[hosts]
            stood = np.array([was[i] for i in hosts], np.int64)
            gone = np.array([went[i] if went[i] is not None else 0 for i in hosts], np.int64)
            travelled = np.array([went[i] is not None for i in hosts])
            refused = {}
            for k, i in enumerate(hosts.tolist()):
                for j in tried[i] or []:
                    refused.setdefault(j, []).append(k)
            for i in np.flatnonzero(guest).tolist():
                x = sets[i]
                n = len(x)
                lo, hi = np.searchsorted(sizes, -(-percent * n // 100), "left"), np.searchsorted(sizes, 100 * n // percent, "right")
                if lo >= hi:
                    continue
                need = needed(n, sizes[lo:hi], percent)
                differ = _differing(maps[lo:hi], np.array(parity_bits(x), np.int64))
                open_ = differ <= n + sizes[lo:hi] - 2 * need
                # compared before: the visitor was at the host's cluster, the host at the visitor's, or both met at a hub
                open_ &= ~(travelled[lo:hi] & (gone[lo:hi] == was[i]))
                if went[i] is not None:
                    open_ &= stood[lo:hi] != went[i]
                if tried[i]:
                    open_ &= ~np.isin(names[lo:hi], np.array(tried[i], np.int64))
                for k in refused.get(int(nodes[i]), []):
                    if lo <= k < hi:
                        open_[k - lo] = False
                at = np.flatnonzero(open_)
                for k in (lo + at[np.argsort(differ[at], kind="stable")]).tolist():
                    if linked(sets[hosts[k]], x, percent):
                        links.append((int(names[k]), int(nodes[i])))
                        break
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def _band(n, percent: int):
    """Sizes that differ by more than 100 / percent can't link: a band holds sizes within that ratio."""
    return F.floor(F.log(n) / F.lit(float(np.log(100 / percent)))).cast("int") if percent < 100 else n


def _meet_hubs(tokens: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found where each node meets the hub with which it shares most prefix shingles."""
    named = tokens.select("token", "node", _band(F.col("n"), percent).alias("band"))
    # stored, so that the join deals its rows anew and can split the partition of a very frequent shingle
    hubs = snug(stored(named.groupBy("token", "band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("nodes")).where("nodes > 1").select("token", "band", "hub")), ROWS)
    met = named.join(hubs, ["token", "band"]).where("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("shared"))
    chosen = met.groupBy("node").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("hub"))
    sizes = chosen.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("salts"))
    members = chosen.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("node"), "salts").alias("salt"), "node")
    # the hub comes to each of its groups
    hub_rows = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("hub").alias("node"))
    return members.unionAll(hub_rows).join(sets.select("node", "hashes"), "node").groupBy("hub", "salt").applyInArrow(_lead(percent), "a long, b long, hit boolean")


def _clusters(sets: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, cluster) of all nodes, and (cluster, size)."""
    of = snug(stored(sets.select("node").join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("cluster"))), ROWS)
    return of, of.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def _open(tokens: DataFrame, of: DataFrame) -> DataFrame:
    """Prefix shingles that nodes of different clusters share, by node."""
    held = tokens.join(of.select("node", "cluster"), "node")
    mixed = snug(stored(held.groupBy("token").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("token")), ROWS)
    return snug(stored(held.join(mixed, "token").select("token", "node", "n", "place")), ROWS)


def _visits(visits: DataFrame, of: DataFrame, sizes: DataFrame, sets: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Links between guests and hosts. visits: (host, node), a node that visits a cluster; the cluster's nodes stand in
    groups of bounded size, and the guest goes to each. marks: (node, was, went, tried), what was compared before."""
    salted = sizes.select(F.col("cluster").alias("host"), F.ceil(F.col("size") / GROUP).alias("salts"))
    guests = visits.join(salted, "host").select("host", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "node", F.lit(True).alias("guest"))
    hosts = visits.select("host").distinct().join(salted, "host").join(of.withColumnRenamed("cluster", "host"), "host").select("host", F.pmod(F.xxhash64("node"), "salts").alias("salt"), "node", F.lit(False).alias("guest"))
    return guests.unionAll(hosts).join(sets.select("node", "hashes"), "node").join(marks, "node").groupBy("host", "salt").applyInArrow(_visit(percent), "a long, b long")


def _largest(tokens: DataFrame, of: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(node, host): for each node one other cluster, of the largest ones at its shingles that with which it shares most."""
    held = tokens.select("token", "node", _band(F.col("n"), percent).alias("band")).join(of, "node").join(sizes, "cluster")
    hosts = snug(stored(held.groupBy("token", "band").agg(F.max(F.struct("size", "cluster")).alias("largest"), F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("token", "band", F.col("largest.cluster").alias("host"))), ROWS)
    met = held.join(hosts, ["token", "band"]).where("cluster != host").groupBy("node", "host").agg(F.count(F.lit(1)).alias("shared"))
    return met.groupBy("node").agg(F.max_by("host", F.struct("shared", -F.col("host"))).alias("host"))


def _lone_pairs(lone: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of lone nodes that share a prefix shingle and pass the length, positional and bitmap filters. A pair is
    met at its first shared shingle alone: each row carries the node's rarer shingles, and a join row needs them to be
    disjoint."""
    lists = lone.groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("all"))
    rows = lists.join(sets.select("node", "bits"), "node").select("node", "n", "bits", "all.token", F.posexplode("all").alias("k", "at")).select("node", "n", "bits", F.col("at.place").alias("place"), F.col("at.token").alias("key"), F.slice("token", F.lit(1), F.col("k")).alias("rarer"))
    x, y = (rows.select("key", *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "bits", "place", "rarer"))) for s in "xy")
    # x is the smaller set: the first shared shingle stands in its index prefix, which is shorter than the other's
    x = x.where(F.col("place_x") <= F.col("n_x") - F.ceil(F.lit(2 * percent) * F.col("n_x") / F.lit(100 + percent)))
    smaller = (F.col("n_x") < F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (F.col("node_x") < F.col("node_y")))
    sizes = smaller & (F.col("n_x") * 100 >= F.col("n_y") * percent)
    left = 1 + F.least(F.col("n_x") - 1 - F.col("place_x"), F.col("n_y") - 1 - F.col("place_y"))
    possible = F.lit(100 + percent) * left >= F.lit(percent) * (F.col("n_x") + F.col("n_y"))
    first = ~F.coalesce(F.arrays_overlap("rarer_x", "rarer_y"), F.lit(False))
    # sets that link differ in n_x + n_y - 2 * overlap shingles at most, and their bitmaps in no more bits
    differ = F.aggregate(F.zip_with("bits_x", "bits_y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, b: a + b)
    most = F.col("n_x") + F.col("n_y") - 2 * F.ceil(F.lit(percent) * (F.col("n_x") + F.col("n_y")) / F.lit(100 + percent))
    return x.join(y, (x.key == y.key) & sizes & possible & (differ <= most) & first).select(F.col("node_x").alias("x"), F.col("node_y").alias("y"))


def _visit_all(tokens: DataFrame, of: DataFrame, sizes: DataFrame, sets: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Links between all clusters that share a prefix shingle and may link by their sizes; the smaller cluster visits."""
    held = tokens.join(of, "node").join(sizes, "cluster")
    mixed = snug(stored(held.groupBy("token").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high").select("token")), ROWS)
    held = snug(stored(held.join(mixed, "token")), ROWS)
    lone = _lone_pairs(held.where("size = 1").select("token", "node", "n", "place"), sets, percent)
    # a larger cluster meets all others at its shingles: a row per shingle and pair of clusters
    many = held.groupBy("token", "cluster", "size").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    x, y = (t.select("token", *(F.col(c).alias(f"{c}_{s}") for c in ("cluster", "size", "least", "most"))) for s, t in (("x", many.where("size > 1")), ("y", many)))
    larger = (F.col("size_x") > F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("cluster_x") < F.col("cluster_y")))
    near = (F.col("most_x") * 100 >= F.col("least_y") * percent) & (F.col("most_y") * 100 >= F.col("least_x") * percent)
    pairs = x.join(y, (x.token == y.token) & larger & near).select(F.col("cluster_x").alias("host"), F.col("cluster_y").alias("cluster")).distinct()
    visits = pairs.join(of, "cluster").select("host", "node").unionAll(lone.select(F.col("x").alias("host"), F.col("y").alias("node")))
    # a lone node is a cluster of its own name
    return _visits(visits, of, sizes, sets, marks, percent)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, node (documents of equal sets have the same)."""
    blocks = blocks_of(docs)
    n_blocks = blocks.count()
    bits = key_bits(n_blocks)
    asked = with_replies(blocks, count_keys(blocks, block_keys(size, bits), n_blocks, bits))
    described = stored(asked.select("g", "data", "replies").mapInArrow(_describe(percent, size, bits), "doc_id long, n_shingles long, node long, start int, prefix binary, hashes binary, bits array<long>"))

    sets = snug(stored(described.where("prefix is not null").groupBy("node").agg(F.min("n_shingles").cast("int").alias("n"), F.min("start").alias("start"), F.min("prefix").alias("prefix"), F.min("hashes").alias("hashes"), F.min("bits").alias("bits"))), SETS)
    # cheap to take apart again, so it isn't stored
    tokens = sets.select("node", "n", "start", "prefix").mapInArrow(_prefix_rows, "token long, node long, n int, place int")

    met = snug(stored(_meet_hubs(tokens, sets, percent)), ROWS)
    links = met.where("hit").select("a", "b")
    of, sizes = _clusters(sets, links)
    tried = met.where("not hit").groupBy(F.col("b").alias("node")).agg(F.collect_list("a").alias("tried"))
    marks = of.join(tried, "node", "left").select("node", F.col("cluster").alias("was"), F.lit(None).cast("long").alias("went"), "tried")
    tokens = _open(tokens, of)
    # one round of visits to large clusters
    went = snug(stored(_largest(tokens, of, sizes, percent)), ROWS)
    links = links.unionAll(snug(stored(_visits(went, of, sizes, sets, marks, percent)), ROWS))
    of, sizes = _clusters(sets, links)
    marks = marks.drop("went").join(went.withColumnRenamed("host", "went"), "node", "left")
    final = components(links.unionAll(_visit_all(tokens, of, sizes, sets, marks, percent)))

    # a component's name is its smallest document
    named = described.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "component").select("node", "component_id")
    out = described.select("doc_id", "n_shingles", "node").join(of_node, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "node")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).drop("node")
