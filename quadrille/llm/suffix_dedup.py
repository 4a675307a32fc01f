"""Suffix-array dedup: exact removal of byte strings that occur more than once.

A string of ``size`` bytes is repeated if it starts at two places. Each start belongs to its anchor: the smallest of the
k-byte hashes inside its ``size`` bytes (the leftmost among equals), which depends on these bytes alone; equal strings
have equal anchors. Neighbouring starts of one anchor are a unit, with the text that their strings cover. Counting all
anchors and units over the corpus (see blocks) settles most: an anchor that occurs once has no repeated start; a unit
whose text occurs twice has only repeated ones. Units left meet the other texts of their anchor in one bucket, where a
suffix array of their texts is built in two stages: starts smaller than their successors are sorted directly, all others
are induced from them by scanning the buckets of first bytes in order. Neighbours in the array whose common prefix
reaches ``size`` are repeated. Anchors with very many different units would fill one bucket: their starts are settled by
counting the strings themselves, spread over all buckets.

Anchors, units and strings are told apart by 64-bit hashes; a unit passes for repeated only if its text and its anchor both
are. Where the suffix array decides, bytes are compared.

Defined results: null is the empty text; texts under ``size`` bytes lose nothing; strings never cross documents; equal
documents of ``size`` bytes or more lose everything, repeated rows included; null ids pass through; an empty table gives no
rows; very long texts are taken whole; further columns don't matter. In ``clean_texts`` a null text stays null, and a row
that loses nothing stays whatever its text is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import _BASE, _INVERSE, _LETTER, U64, Block, blocks_of, bucket_number, count_keys, counted, distinct, exchange_keys, expand, joined_reply, mix, packed_keys, powers, squeeze, with_replies
from .common import read_table, stored

SIZE = 200
GRAM = 32
#: Units of one anchor that meet in a bucket; starts of more frequent anchors are counted.
HOT_UNITS = 4_000

_UNIT_SALT, _STRING_SALT = U64(0x5851F42D4C957F2D), U64(0xC2B2AE3D27D4EB4F)


class Units:
    """The units of a block: first start, number of starts, anchor hash, and the hash of the unit's text."""

    def __init__(self, block: Block, size: int = SIZE, gram: int = GRAM):
        data = block.bytes
        n = len(data)
        self.first = np.zeros(0, np.int64)
        self.number, self.anchor, self.text = self.first, np.zeros(0, U64), np.zeros(0, U64)
        self.total = np.zeros(n + 1, U64)
        if n < size:
            return
        np.cumsum(_LETTER[data] * powers(_BASE, n), out=self.total[1:])
        self.back = powers(_INVERSE, n + 1)
        total, back = self.total, self.back
        grams = total[gram:] - total[:-gram]
        grams *= back[: n - gram + 1]
        grams = mix(grams)
        at = leftmost_least(grams, size - gram + 1)
        # starts whose string ends inside its document
        valid = np.zeros(n + 1, np.int32)
        lengths = np.diff(block.starts)
        long_ = lengths >= size
        np.add.at(valid, block.starts[:-1][long_], 1)
        np.add.at(valid, (block.starts[1:] - size + 1)[long_], -1)
        starts = np.flatnonzero(np.cumsum(valid)[: n - size + 1])
        if not len(starts):
            return
        own = at[starts]
        new = np.concatenate([[True], (np.diff(own) != 0) | (np.diff(starts) != 1)])
        begin = np.flatnonzero(new)
        self.first = starts[begin]
        self.number = np.diff(np.concatenate([begin, [len(starts)]]))
        place = own[begin]
        self.anchor = grams[place]
        end = self.first + self.number + size - 1
        self.text = mix(((total[end] - total[self.first]) * back[self.first]) ^ mix(self.number.astype(U64) ^ _UNIT_SALT))

    def keys(self) -> np.ndarray:
        return np.concatenate([self.anchor, self.text])

    def strings(self, unit: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The starts of some units and their strings' hashes."""
        number = self.number[unit]
        starts = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number) + np.repeat(self.first[unit], number)
        if not len(starts):
            return starts, np.zeros(0, U64)
        return starts, mix(((self.total[starts + size] - self.total[starts]) * self.back[starts]) ^ _STRING_SALT)


def leftmost_least(grams: np.ndarray, width: int, bits: int = 24) -> np.ndarray:
    """The place of each window's smallest hash (by its upper 64 - ``bits`` bits, whatever the block's size; the leftmost of
    equals). The place stands in the lower bits, so a block of more places is taken in overlapping stretches."""
    low, step, out = U64((1 << bits) - 1), (1 << bits) - width + 1, []
    for begin in range(0, len(grams) - width + 1, step):
        part = grams[begin : begin + step + width - 1]
        ranked = part & ~low
        ranked |= np.arange(len(part), dtype=U64)
        least = _sliding_min(ranked, width)
        least &= low
        out.append(least.astype(np.int64) + begin)
    return np.concatenate(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window, from windows of half the width."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


# ---------------------------------------------------------------- the suffix array


def words8(text: np.ndarray) -> np.ndarray:
    """At every place the next eight bytes as one number; bytes after the end are 0."""
    raw = np.concatenate([text, np.zeros(16, np.uint8)]).tobytes()
    out = np.empty(len(text) + 8, U64)
    for k in range(8):
        out[k::8] = np.frombuffer(raw, ">u8", len(out[k::8]), k)
    return out


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, eight bytes at a time; only ties go on."""
    if not len(places):
        return places
    last = len(words) - 1
    key = words[places]
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    group = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
    slots = np.arange(len(places))
    for at in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        slots, group = slots[tied], group[tied]
        if not len(slots):
            break
        key = words[np.minimum(places[slots] + at, last)]
        order = np.lexsort((key, group))
        places[slots] = places[slots][order]
        key = key[order]
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (group[1:] != group[:-1]))])
    return places


def ascending(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one isn't."""
    step = np.sign(np.diff(text.astype(np.int16)))
    place = np.where(step != 0, np.arange(len(step)), len(step))
    decides = np.minimum.accumulate(place[::-1])[::-1]
    return np.concatenate([np.concatenate([step, [-1]])[decides] > 0, [False]])


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places in the order of their suffixes' first ``depth`` bytes. The text ends with the bytes 0, 255."""
    up = ascending(text)
    # a suffix that is induced leans on its successors, up to the next one that is sorted directly
    following = np.minimum.accumulate(np.where(up, np.arange(len(text)), len(text) - 2)[::-1])[::-1]
    cover = np.zeros(len(text) + 1, np.int32)
    lean = np.flatnonzero(wanted & ~up)
    np.add.at(cover, lean, 1)
    np.add.at(cover, following[lean] + 1, -1)
    needed = wanted | (np.cumsum(cover)[:-1] > 0)
    induced = needed & ~up
    sorted_ = sort_directly(np.flatnonzero(needed & up), words8(text), depth)
    cuts = np.searchsorted(text[sorted_], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        # larger ones come first in a bucket; runs of its own byte follow from each other
        bucket = []
        while waiting[c]:
            now = np.concatenate(waiting[c])
            bucket.append(now)
            p = now[now > 0] - 1
            p = p[induced[p]]
            waiting[c] = [q] if len(q := p[text[p] == c]) else []
        here = np.concatenate([*bucket, sorted_[cuts[c] : cuts[c + 1]]])
        if not len(here):
            continue
        out.append(here)
        p = here[here > 0] - 1
        p = p[induced[p]]
        p = p[text[p] > c]
        p = p[np.argsort(text[p], kind="stable")]
        edges = np.searchsorted(text[p], np.arange(c + 1, 257))
        for d in np.flatnonzero(np.diff(edges)).tolist():
            waiting[c + 1 + d].append(p[edges[d] : edges[d + 1]])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[wanted[order]]


def repeated_starts(texts: list[np.ndarray], size: int) -> list[np.ndarray]:
    """Of each text the starts of strings that also start elsewhere in the texts, as flags."""
    lengths = np.array([len(t) for t in texts], np.int64)
    text = np.concatenate([*texts, np.array([0, 255] + [0] * 8, np.uint8)])[: lengths.sum() + 2]
    begin = np.cumsum(lengths) - lengths
    edge = np.zeros(len(text) + 1, np.int32)
    number = np.maximum(lengths - size + 1, 0)
    np.add.at(edge, begin, (number > 0).astype(np.int32))
    np.add.at(edge, begin + number, -(number > 0).astype(np.int32))
    wanted = np.cumsum(edge)[:-1] > 0
    flags = np.zeros(len(text), bool)
    if wanted.any():
        order = two_stage(text, wanted, size)
        same = common_prefix_reaches(order[:-1], order[1:], words8(text), size)
        flags[order[:-1][same]] = True
        flags[order[1:][same]] = True
    return [flags[i : i + n] for i, n in zip(begin.tolist(), number.tolist(), strict=True)]


def common_prefix_reaches(a: np.ndarray, b: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes at a and b share ``depth`` bytes (a multiple of eight)."""
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    for at in range(0, depth, 8):
        left = left[words[a[left] + at] == words[b[left] + at]]
        if not len(left):
            break
    same[:] = False
    same[left] = True
    return same


# ---------------------------------------------------------------- over a corpus


def _wanted(units: Units, replies, hot_units: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a block's units: whose text is repeated, which go to the suffix array, which are counted string by string. A text
    is as frequent as its anchor at most: a text whose hash meets another one's doesn't pass for repeated by that alone."""
    keys = distinct(units.keys())
    totals = joined_reply(replies)
    anchors = totals[np.searchsorted(keys, units.anchor)] if len(keys) else totals
    texts = totals[np.searchsorted(keys, units.text)] if len(keys) else totals
    repeated, open_ = (texts > 1) & (anchors >= texts), (anchors > 1) & (anchors != texts)
    hot = open_ & (anchors > hot_units)
    return repeated, open_ & ~hot, hot


def _unit_keys(size: int):
    return lambda block: counted(Units(block, size).keys())


def _open_units(n: int, size: int, hot_units: int):
    """(bucket, g, data): a block's open units, each text once per bucket, by anchor; and, with no bucket, the strings of its
    hot units with their counts."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for g, data, replies in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = Block(data)
                units = Units(block, size)
                _, open_, hot = _wanted(units, replies, hot_units)
                open_ = np.flatnonzero(open_)
                _, one = np.unique(units.text[open_] ^ mix(units.anchor[open_]), return_index=True)
                open_ = open_[one]
                bucket = (units.anchor[open_] % U64(n)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                open_, bucket = open_[order], bucket[order]
                names, begin = np.unique(bucket, return_index=True)
                names, rows = names.tolist(), []
                for mine in np.split(open_, begin[1:]) if names else []:
                    spans = [block.bytes[i : i + k + size - 1] for i, k in zip(units.first[mine].tolist(), units.number[mine].tolist(), strict=True)]
                    rows.append(squeeze(units.anchor[mine], units.text[mine], np.array([len(x) for x in spans], np.int64), np.concatenate(spans)))
                found, local = counted(units.strings(np.flatnonzero(hot), size)[1])
                if len(found):
                    names.append(None)
                    rows.append(packed_keys(found, local))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.full(len(names), g), pa.int64()), pa.array(rows, pa.binary())], ["bucket", "g", "data"])

    return run


def _array(size: int, most: int = 1 << 20):
    """A bucket's suffix arrays; anchors are put together up to ``most`` bytes for one array."""

    def run(table):
        import pyarrow as pa

        parts = [expand(x) for x in table.column("data").to_pylist()]
        anchor, name = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        spans = [s for p in parts for s in np.split(p[3], np.cumsum(p[2])[:-1])]
        # equal texts of an anchor come from several blocks: one of them is sorted
        order = np.lexsort((name, anchor))
        new = np.concatenate([[True], (np.diff(name[order]) != 0) | (np.diff(anchor[order]) != 0)])
        chosen = order[new]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        flags: list[np.ndarray] = []
        size_of = np.array([len(spans[i]) for i in chosen])
        last_of_anchor = np.concatenate([np.diff(anchor[chosen]) != 0, [True]])
        begin = held = 0
        for i in range(len(chosen)):
            held += size_of[i]
            if last_of_anchor[i] and (held >= most or i + 1 == len(chosen)):
                flags += repeated_starts([spans[k] for k in chosen[begin : i + 1]], size)
                begin, held = i + 1, 0
        told = []
        for k in range(len(parts)):
            mine = np.flatnonzero(source == k)
            found = [flags[of[i]] for i in mine]
            hit = [j for j, f in enumerate(found) if f.any()]
            told.append(squeeze(name[mine[hit]] ^ mix(anchor[mine[hit]]), np.array([len(found[j]) for j in hit], np.int64), np.packbits(np.concatenate([found[j] for j in hit])) if hit else np.zeros(0, np.uint8)))
        return pa.table({"g": table.column("g"), "flags": pa.array(told, pa.binary())})

    return run


def _gone(block: Block, replies, hot_replies, flags, size: int, hot_units: int) -> np.ndarray:
    """Of a block's bytes those that a repeated string covers."""
    units = Units(block, size)
    repeated, open_, hot = _wanted(units, replies, hot_units)
    n = len(block.bytes)
    mark = np.zeros(n + size, np.int32)
    whole = np.flatnonzero(repeated)
    np.add.at(mark, units.first[whole], 1)
    np.add.at(mark, units.first[whole] + units.number[whole] + size - 1, -1)
    starts, names = units.strings(np.flatnonzero(hot), size)
    if len(starts):
        hit = starts[joined_reply(hot_replies)[np.searchsorted(distinct(names), names)] > 1]
        np.add.at(mark, hit, 1)
        np.add.at(mark, hit + size, -1)
    mine = np.flatnonzero(open_ & ~repeated)
    if flags and len(mine):
        parts = [expand(x) for x in flags]
        name, number = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        bits = np.concatenate([np.unpackbits(p[2])[: p[1].sum()] for p in parts])
        if len(name):
            order = np.argsort(name)
            key = units.text[mine] ^ mix(units.anchor[mine])
            at = np.minimum(np.searchsorted(name[order], key), len(name) - 1)
            ok = name[order][at] == key
            mine, which = mine[ok], order[at[ok]]
            k = number[which]
            within = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            on = bits[np.repeat((np.cumsum(number) - number)[which], k) + within] > 0
            hit = (np.repeat(units.first[mine], k) + within)[on]
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + size, -1)
    return np.cumsum(mark)[:n] > 0


def _kept(block: Block, gone: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """Of each document: bytes removed, maximal removed runs, bytes kept."""
    removed, spans, kept, raw = [], [], [], block.bytes
    for i, j in zip(block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True):
        g = gone[i:j]
        m = int(np.count_nonzero(g))
        removed.append(m)
        spans.append(int(np.count_nonzero(g[1:] & ~g[:-1]) + g[0]) if m else 0)
        kept.append(raw[i:j].tobytes() if not m else b"" if m == j - i else raw[i:j][~g].tobytes())
    return removed, spans, kept


def _report(size: int, hot_units: int):
    """Blocks with all replies to rows: doc_id, n_bytes, n_removed, n_spans, kept."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for data, *told in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = Block(data)
                removed, spans, kept = _kept(block, _gone(block, *told, size, hot_units))
                yield pa.RecordBatch.from_arrays([block.id_column(), pa.array(np.diff(block.starts)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _rewrite(size: int, hot_units: int, names: list[str]):
    """Blocks with all replies to their documents' columns, with the kept text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for data, *told in zip(*(c.to_pylist() for c in b.columns), strict=True):
                block = Block(data)
                rest = block.rest()
                removed, _, kept = _kept(block, _gone(block, *told, size, hot_units))
                texts = [t.decode("utf-8", "ignore") for t in kept]
                stay = pa.array([not m or bool(t.strip()) for m, t in zip(removed, texts, strict=True)], pa.bool_())
                columns = {"doc_id": block.id_column(), **{c: rest.column(c) for c in rest.column_names}}
                cut = pa.array([m > 0 for m in removed], pa.bool_())
                columns["text"] = pa.array([t if before is not None else None for t, before in zip(texts, rest.column("text_before").to_pylist(), strict=True)], pa.string())
                if "n_chars" in columns:
                    columns["n_chars"] = pa.compute.if_else(cut, pa.array([len(t) for t in texts], pa.int64()), rest.column("n_chars").combine_chunks().cast(pa.int64())).cast(rest.column("n_chars").type)
                yield from pa.table([columns[c] for c in names], names).filter(stay).combine_chunks().to_batches()

    return run


def _settled(blocks: DataFrame, size: int, hot_units: int) -> DataFrame:
    """(data, replies, hot, flags): blocks with all that the corpus says about their units."""
    if size % 8 or size <= GRAM:
        raise ValueError(f"size must be a multiple of 8 over {GRAM}")
    n = blocks.count()
    replies = stored(count_keys(blocks, _unit_keys(size), n).select("g", "bucket", "reply"))
    # blocks meet their replies twice rather than to be stored with them
    asked = with_replies(blocks, replies)
    opened = stored(asked.select("g", "data", "replies").mapInArrow(_open_units(bucket_number(n), size, hot_units), "bucket long, g long, data binary"))
    strings = opened.where("bucket is null").select(F.col("g").alias("u"), F.lit(0).cast("long").alias("part"), "data")
    hot = exchange_keys(strings, n).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias("hot"))
    found = opened.where("bucket is not null").groupBy("bucket").applyInArrow(_array(size), "g long, flags binary")
    flags = found.groupBy("g").agg(F.collect_list("flags").alias("flags"))
    return asked.join(hot, "g", "left").join(flags, "g", "left").select("data", "replies", "hot", "flags")


def remove_repeats(docs: DataFrame, size: int = SIZE, hot_units: int = HOT_UNITS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans and the bytes kept."""
    return _settled(blocks_of(docs), size, hot_units).mapInArrow(_report(size, hot_units), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def clean_texts(docs: DataFrame, size: int = SIZE, hot_units: int = HOT_UNITS) -> DataFrame:
    """``docs`` with the kept bytes as text; n_chars, where there is one, follows. A sign that a cut runs through goes with
    it. Rows that lose something and keep nothing but white space are dropped."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    blocks = blocks_of(docs.withColumn("text_before", F.when(F.col("text").isNotNull(), "")), *rest, "text_before")
    return _settled(blocks, size, hot_units).mapInArrow(_rewrite(size, hot_units, docs.columns), docs.schema)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
