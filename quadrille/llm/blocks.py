"""Documents in blocks, and counts of keys over all blocks.

Operators that need facts about a whole corpus (how many documents have this shingle, how often does this word occur)
work on blocks: some MB of documents in one compressed row, stored once in the shared checkpoint folder. ``count_keys``
lets every block name its 64-bit keys with local counts, adds them up bucket by bucket, and sends each block the totals of
just its own keys, in the order in which the block holds them. Keys travel sorted, as packed differences: some four
bytes each instead of a row. Nothing is sent to the driver and nothing is broadcast; every part grows with the input only
in number, never in size. More blocks than ``FAN`` don't meet all buckets: they are first merged in groups, a group for
each of ``RADIX`` ranges of the keys, and what is merged is exchanged in turn, range by range. So a block writes a bounded
number of rows at any size of the input, and a row always holds many keys. Totals have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, stored

BLOCK_BYTES = 2 << 20
U64 = np.uint64


def squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed string."""
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(packed(*arrays))


_KINDS = {np.dtype(k).num: np.dtype(k) for k in (np.uint8, np.int32, np.uint32, np.int64, np.uint64, np.uint16, np.float64)}


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one string, as they are."""
    head = np.array([len(arrays), *(x for a in arrays for x in (np.dtype(a.dtype).num, a.size))], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def expand(data: bytes) -> list[np.ndarray]:
    import zstandard

    return unpacked(zstandard.ZstdDecompressor().decompress(data))


def unpacked(raw: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for kind, size in head.tolist():
        a = np.frombuffer(raw, _KINDS[kind], size, at)
        out.append(a)
        at += a.nbytes
    return out


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    out = np.sort(x)
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    out = np.sort(x)
    begin = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]])) if len(out) else np.zeros(0, np.int64)
    return out[begin], np.diff(np.append(begin, len(out)))


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of numbers, all first ones, then all second ones, ..., each kind compressed for itself: its own statistics
    make it short."""
    import zstandard

    coder = zstandard.ZstdCompressor(level=1)
    # a plane of zeros takes no room
    parts = [coder.compress(plane.tobytes()) if plane.any() else b"" for plane in x.view(np.uint8).reshape(len(x), -1).T]
    return np.frombuffer(b"".join([np.array([len(x), *map(len, parts)], np.int64).tobytes(), *parts]), np.uint8)


def _unplaned(planes: np.ndarray, kind: type) -> np.ndarray:
    import zstandard

    width, data = np.dtype(kind).itemsize, planes.tobytes()
    n, *sizes = np.frombuffer(data, np.int64, 1 + width).tolist()
    out, at, coder = np.zeros((n, width), np.uint8), 8 * (1 + width), zstandard.ZstdDecompressor()
    for k, size in enumerate(sizes):
        if size:
            out[:, k] = np.frombuffer(coder.decompress(data[at : at + size]), np.uint8)
        at += size
    return out.view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted 64-bit keys as byte planes of their differences: high bytes are nearly constant and vanish in compression."""
    return (_planes(np.diff(keys, prepend=U64(0))),)


def expand_sorted(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(_unplaned(planes, U64), dtype=U64)


def squeeze_counts(counts: np.ndarray) -> bytes:
    """Counts as byte planes: most are small, so the high ones vanish."""
    wide = len(counts) and int(counts.max()) >> 32
    return packed(np.array([8 if wide else 4], np.uint8), _planes(counts.astype(U64 if wide else np.uint32)))


def expand_counts(data: bytes) -> np.ndarray:
    width, planes = unpacked(data)
    return _unplaned(planes, U64 if width[0] == 8 else np.uint32).astype(np.int64)


class Block:
    """Some documents: ids (with null flags), the bytes of all texts one after another, and where each begins."""

    def __init__(self, data: bytes):
        self.ids, self.null, lengths, self.bytes, self._rest = expand(data)
        self.starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ids)

    def rest(self):
        """The further columns that the block carries, as an Arrow table."""
        import pyarrow as pa

        return pa.ipc.open_stream(self._rest.tobytes()).read_all()

    def id_column(self, rows=None):
        import pyarrow as pa

        ids, null = (self.ids, self.null) if rows is None else (self.ids[rows], self.null[rows])
        return pa.array(ids, pa.int64(), mask=null.astype(bool))


def _blocks(batches, most: int) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    from .common import text_bytes

    base, made = TaskContext.get().partitionId() << 32, 0
    ids, texts, rest, size = [], [], [], 0

    def row():
        nonlocal ids, texts, rest, size, made
        sink = pa.BufferOutputStream()
        if rest:
            with pa.ipc.new_stream(sink, rest[0].schema) as out:
                for x in rest:
                    out.write_batch(x)
        packed = squeeze(np.array([i or 0 for i in ids], np.int64), np.array([i is None for i in ids], np.uint8), np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8), np.frombuffer(sink.getvalue(), np.uint8), level=5)
        out = pa.RecordBatch.from_arrays([pa.array([base + made], pa.int64()), pa.array([packed], pa.binary())], ["g", "data"])
        ids, texts, rest, size, made = [], [], [], 0, made + 1
        return out

    for b in batches:
        more, begin = b.select(list(range(2, b.num_columns))), 0
        for k, (i, t) in enumerate(zip(b.column(0).to_pylist(), text_bytes(b.column(1)), strict=True)):
            ids.append(i)
            texts.append(t)
            size += len(t)
            if size >= most:
                if b.num_columns > 2:
                    rest.append(more.slice(begin, k + 1 - begin))
                begin = k + 1
                yield row()
        if b.num_columns > 2 and begin < b.num_rows:
            rest.append(more.slice(begin))
    if ids:
        yield row()


def blocks_of(docs: DataFrame, *more: str, size: int = BLOCK_BYTES) -> DataFrame:
    """(g, data): stored blocks of about ``size`` bytes. A document is never cut; null texts are empty. Columns named in
    ``more`` are carried."""
    return stored(documents_of(docs, *more).mapInArrow(lambda batches: _blocks(batches, size), "g long, data binary"))


#: Blocks that exchange with all buckets directly, and key ranges (and members of a group) of a merging step beyond.
FAN, RADIX = 768, 64


def bucket_number(n_blocks: int) -> int:
    """Buckets for ``n_blocks`` blocks: a bucket gets about as many keys as two blocks have, at any size of the input."""
    return max(16, -(-n_blocks // 2))


def bucket_bounds(keys: np.ndarray, n: int, bits: int, part: int = 0, parts: int = 1) -> np.ndarray:
    """Where the keys (sorted) of each of ``n`` buckets begin and end: equal ranges of the ``part``-th of ``parts`` equal
    ranges of ``bits`` bits."""
    edges = [(part * n + k << bits) // (parts * n) for k in range(1, n)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, U64), "left"), [len(keys)]]).astype(np.int64)


def _rows(found: np.ndarray, local: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The ranges that have keys, and each one's keys and counts, packed."""
    full = np.flatnonzero(np.diff(bounds))
    return full, [packed(*squeeze_sorted(found[i:j]), _planes(local[i:j].astype(U64))) for i, j in zip(bounds[full].tolist(), bounds[full + 1].tolist(), strict=True)]


def _merged(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, their total counts, and where each row's keys are among them."""
    sent = [expand_sorted(unpacked(x)[0]) for x in rows]
    ends = np.cumsum([len(s) for s in sent])[:-1]
    keys = np.concatenate(sent)
    del sent
    order = np.argsort(keys)
    keys = keys[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    keys, begin = keys[new], np.flatnonzero(new)
    place = np.empty(len(order), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    counts = np.concatenate([_unplaned(unpacked(x)[1], U64) for x in rows]).view(np.int64)
    return keys, np.add.reduceat(counts[order], begin), np.split(place, ends)


def exchange_keys(units: DataFrame, n_blocks: int, bits: int = 64, tally=None) -> DataFrame:
    """The same for keys that stand packed already: units (u, part, data), u being the block and part 0."""
    return _exchange(units, _packed_unit, n_blocks, 1, bits, tally).select(F.col("u").alias("g"), "bucket", "reply", "t0", "t1")


def _packed_unit(u: int, part: int, data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    found, local = unpacked(data)
    return (u, part, expand_sorted(found), _unplaned(local, U64)) if found.dtype == np.uint8 else (u, part, found, local)


def _exchange(units: DataFrame, read: Callable, n_units: int, parts: int, bits: int, tally) -> DataFrame:
    """(u, part, bucket, reply, t0, t1) for units of which each of ``parts`` key ranges has ``n_units``; read(*row) gives a
    unit's u, part, sorted keys and counts."""
    direct, radix = n_units <= FAN, RADIX
    n = (bucket_number(n_units) if parts == 1 else -(-n_units // 2)) if direct else radix
    groups = -(-n_units // radix)

    def send(batches):
        import pyarrow as pa

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                u, part, found, local = read(*row)
                full, rows = _rows(found, local, bucket_bounds(found, n, bits, part, parts))
                del row, found, local
                v = int(mix(np.array([u], np.int64).view(U64))[0] % U64(groups))
                yield pa.RecordBatch.from_arrays([pa.array(full + part * n, pa.int64()), pa.array(np.full(len(full), v), pa.int64()), pa.array(np.full(len(full), u), pa.int64()), pa.array(np.full(len(full), part), pa.int64()), pa.array(rows, pa.binary())], ["bucket", "v", "u", "part", "data"])

    def add(table):
        import pyarrow as pa

        keys, totals, places = _merged(table.column("data").to_pylist())
        none = [None] * (len(places) - 1)
        told = [[x, *none] for x in (tally(keys, totals) if tally else (None, None))]
        return pa.table({"u": table.column("u"), "part": table.column("part"), "bucket": table.column("bucket"), "reply": pa.array([squeeze_counts(totals[p]) for p in places], pa.binary()), "t0": pa.array(told[0], pa.int64()), "t1": pa.array(told[1], pa.int64())})

    sent = units.mapInArrow(send, "bucket long, v long, u long, part long, data binary")
    out = "u long, part long, bucket long, reply binary, t0 long, t1 long"
    if direct:
        return sent.groupBy("bucket").applyInArrow(add, out)

    def merge(table):
        import pyarrow as pa

        keys, totals, places = _merged(table.column("data").to_pylist())
        members = packed(*(x for u, p in zip(table.column("u").to_pylist(), places, strict=True) for x in (np.array([u], np.int64), *squeeze_sorted(p.astype(U64)))))
        return pa.table({"u": pa.array([table.column("v")[0].as_py()], pa.int64()), "part": pa.array([table.column("bucket")[0].as_py()], pa.int64()), "data": pa.array([packed(*squeeze_sorted(keys), _planes(totals.astype(U64)))], pa.binary()), "members": pa.array([members], pa.binary())})

    merged = stored(sent.groupBy("v", "bucket").applyInArrow(merge, "u long, part long, data binary, members binary"))
    told = _exchange(merged.select("u", "part", "data"), _packed_unit, groups, parts * radix, bits, tally)
    replies = told.groupBy("u", "part").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias("replies"), F.sum("t0").alias("t0"), F.sum("t1").alias("t1"))

    def down(batches):
        import pyarrow as pa

        for b in batches:
            for part, members, got, t0, t1 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                totals, held = joined_reply(got), unpacked(members)
                k = len(held) // 2
                yield pa.RecordBatch.from_arrays([pa.array([int(x[0]) for x in held[::2]], pa.int64()), pa.array([part // radix] * k, pa.int64()), pa.array([part] * k, pa.int64()), pa.array([squeeze_counts(totals[expand_sorted(x).astype(np.int64)]) for x in held[1::2]], pa.binary()), pa.array([t0, *[None] * (k - 1)], pa.int64()), pa.array([t1, *[None] * (k - 1)], pa.int64())], ["u", "part", "bucket", "reply", "t0", "t1"])

    return merged.select("u", "part", "members").join(replies, ["u", "part"]).select("part", "members", "replies", "t0", "t1").mapInArrow(down, out)


def packed_keys(found: np.ndarray, local: np.ndarray) -> bytes:
    """A unit's data: sorted distinct keys and their counts."""
    return packed(found, local.astype(U64))


def count_keys(blocks: DataFrame, keys: Callable[..., tuple[np.ndarray, np.ndarray]], n_blocks: int, bits: int = 64, tally: Callable[[np.ndarray, np.ndarray], tuple[int, int]] | None = None) -> DataFrame:
    """(g, bucket, reply, t0, t1): for each block and bucket the totals of the block's keys.

    keys(block) gives sorted distinct uint64 keys and their counts in the block; if ``blocks`` holds further columns after
    g and data, it gets their values too. Keys are below 2**bits. tally(keys, totals) gives two numbers for each bucket,
    which stand in t0 and t1 of one of its rows.
    """

    def read(g: int, data: bytes, *more):
        return (g, 0, *keys(Block(data), *more))

    return _exchange(blocks, read, n_blocks, 1, bits, tally).select(F.col("u").alias("g"), "bucket", "reply", "t0", "t1")


def with_replies(blocks: DataFrame, replies: DataFrame) -> DataFrame:
    """(g, data, replies): every block with its replies, an array by bucket."""
    told = replies.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("bucket", "reply"))).alias("replies"))
    return blocks.join(told, "g", "left")


def joined_reply(replies) -> np.ndarray:
    """One block's replies one after another: an entry for each of its keys, in their order."""
    parts = [expand_counts(r["reply"]) for r in replies or []]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


# ---------------------------------------------------------------- words and hashes

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, BLOCK_BYTES + (1 << 20))
        out = np.full(size, U64(base))
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), one to one."""
    out = np.asarray(x >> U64(30))
    out ^= x
    out *= U64(0xBF58476D1CE4E5B9)
    out ^= out >> U64(27)
    out *= U64(0x94D049BB133111EB)
    out ^= out >> U64(31)
    return out


_LETTER = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


_HEAD = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U64)
#: Longer words are hashed one by one.
LONG_WORD = 128


def byte_hashes(data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the strings that begin at ``begin``: eight bytes at a time are mixed in, long ones by a digest."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(length.astype(U64) * U64(0x2545F4914F6CDD1D) + U64(1))
    todo = np.flatnonzero(length <= LONG_WORD)
    at = 0
    while len(todo):
        left = length[todo] - at
        todo, left = todo[left > 0], left[left > 0]
        out[todo] = mix(out[todo] ^ (eight[begin[todo] + at] & _HEAD[np.minimum(left, 8)])) + U64(at)
        at += 8
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : begin[i] + length[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def word_hashes(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of a block in order: hash (A-Z lowered), document, and each document's number of words."""
    data, starts = block.bytes, block.starts
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(block), np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    of = np.searchsorted(starts, begin, "right") - 1
    return byte_hashes(_LOW[data], begin, end - begin), of, np.bincount(of, minlength=len(block)).astype(np.int64)
