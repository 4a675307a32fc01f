"""Best-fit packing of token pieces by bin completion.

Documents become pieces of at most ``capacity`` tokens. Only the number of pieces of each length decides how many
sequences are needed, so the driver sees one count per length (at most ``capacity`` rows, whatever the corpus), and one
branch-and-bound search over these counts plans all sequences. A node of the tree completes the sequence of the largest
piece left: its fillings come in order of their waste, longer pieces first, without those that another filling dominates (a
set of its pieces could give place to one larger piece that is left), and one filling is repeated as often as its lengths
last, or, when the search comes back, less often. A node is pruned if its waste exceeds what the incumbent allows, or if
Martello and Toth's bound of what is left can't beat the incumbent. Incumbents are the completed fillings on the path with
the rest packed by best fit decreasing; the first path goes on as long as it needs no more sequences than best fit, so that
the plan comes from completion also where best fit meets the bound at once. The search ends when an incumbent meets the
lower bound or the tree is done, either of which proves the fewest sequences; on inputs where neither comes (packing is
NP-hard), after ``SEARCH_STEPS`` nodes and fillings, with the incumbent and the lower bound known. ``steps=None`` searches to
the end. Executors then number the pieces of each length and read their sequence and place off the plan.

Defined results: a null or empty text is the one id 0; repeated rows are packed each for itself; null ids pass through;
an empty table gives no rows; very long texts are cut, never shortened; ties are broken by the row's other columns; further
columns don't matter. The literal of a special token in a text is its one id, as the library reads it by default; with
``special=False`` it is plain text.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents_of, read_table, stored

CAPACITY = 2048
#: Nodes and rejected fillings after which the search ends without a proof.
SEARCH_STEPS = 20_000
#: Nodes, the deepest ones, that keep their enumeration; others begin it anew when the search comes back to them.
LIVE_NODES = 16
#: Pieces of one length are numbered in groups of about so many.
GROUP_ROWS = 50_000


class ByteBpe:
    """The byte-level BPE of a tokenizer file, its merges run by tiktoken, which gives the same ids several times faster."""

    def __init__(self, path: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        # the printable stand-ins of bytes in such files: visible Latin-1 for itself, the rest from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stands = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(stands[c] for c in token): i for token, i in data["model"]["vocab"].items() if all(c in stands for c in token) and token not in self.special}
        self.coder = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str, special: bool = True) -> list[int]:
        if special and any(t in text for t in self.special):
            return self.coder.encode(text, allowed_special="all")
        return self.coder.encode_ordinary(text)


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, special: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. All but the first piece of a cut document are full."""

    def run(batches):
        import pyarrow as pa

        coder = byte_bpe(path or tokenizer_path())
        for b in batches:
            row, piece, start, length, check = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.array([*coder.encode(t or "", special), 0], "<u4").tobytes()
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                at = 0
                for k in range(1 + (n - first) // capacity):
                    m = first if k == 0 else capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(m)
                    check.append(zlib.crc32(ids[4 * at : 4 * (at + m)]))
                    at += m
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(check, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return documents_of(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Martello and Toth's second bound: over every threshold, the bins that large pieces force plus those the rest fills."""
    return _bound(_number(counts, capacity), capacity)


def _number(counts: dict[int, int], capacity: int) -> np.ndarray:
    out = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        out[s] = n
    return out


def _bound(number: np.ndarray, capacity: int) -> int:
    size = np.arange(capacity + 1)
    n, total = np.concatenate([[0], np.cumsum(number)]), np.concatenate([[0], np.cumsum(number * size)])
    half = capacity // 2
    k = np.arange(1, half + 1)
    large = n[-1] - n[capacity - k + 1]
    middle = n[capacity - k + 1] - n[half + 1]
    room = middle * capacity - (total[capacity - k + 1] - total[half + 1])
    small = total[half + 1] - total[k]
    return int(max(-(-total[-1] // capacity), (large + middle + np.maximum(0, -(-(small - room) // capacity))).max(initial=0)))


Filling = list[tuple[int, int]]
Plan = list[tuple[int, Filling]]


def best_fit(number: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Best fit decreasing: each piece, largest first, goes to the fullest sequence that has room for it. Sequences of equal
    room are kept together, so the work follows the number of lengths, not of pieces."""
    open_: dict[int, Plan] = {}
    rooms: list[int] = []  # rising
    for s in np.flatnonzero(number)[::-1].tolist():
        left = int(number[s])
        while left:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                room, groups = capacity, [(left, [])]
            else:
                room = rooms[at]
                groups = open_.pop(room)
                del rooms[at]
            many = room // s
            for times, filling in groups:
                full, rest = divmod(left, many)
                take = min(times, full)
                for some, k in ((take, many), (1 if take < times and full == take else 0, rest)):
                    if some and k:
                        _add(open_, rooms, room - s * k, (some, [*filling, (s, k)]))
                        left -= some * k
                        times -= some
                if times and room < capacity:
                    _add(open_, rooms, room, (times, filling))
    return [g for room in rooms for g in open_[room]]


def _add(open_: dict[int, Plan], rooms: list[int], room: int, group: tuple[int, Filling]) -> None:
    if room not in open_:
        open_[room] = []
        bisect.insort(rooms, room)
    open_[room].append(group)


def fillings(number: np.ndarray, room: int, most: int) -> Iterator[tuple[int, Filling] | None]:
    """(waste, [(length, how many)]) of ``room``, with a waste up to ``most``, by rising waste and longer pieces first; None
    stands for a filling that another one dominates.

    Sums that the lengths from a place on can reach are bits of a number, so no branch of the enumeration ends in vain."""
    sizes = [s for s in np.flatnonzero(number[: room + 1])[::-1].tolist() if s]
    mask = (1 << (room + 1)) - 1
    reach = [1] * (len(sizes) + 1)
    for i in range(len(sizes) - 1, -1, -1):
        sums, left, p = reach[i + 1], min(int(number[sizes[i]]), room // sizes[i]), 1
        while left:
            now = min(p, left)
            sums |= sums << (now * sizes[i])
            left, p = left - now, 2 * p
        reach[i] = sums & mask

    def filled(i: int, t: int) -> Iterator[Filling]:
        if not t:
            yield []
            return
        while i < len(sizes) and reach[i] >> t & 1:
            s = sizes[i]
            for k in range(min(int(number[s]), t // s), 0, -1):
                if reach[i + 1] >> (t - k * s) & 1:
                    for rest in filled(i + 1, t - k * s):
                        yield [(s, k), *rest]
            i += 1

    present = sum(1 << s for s in sizes)
    for waste in range(min(most, room) + 1):
        if reach[0] >> (room - waste) & 1:
            for f in filled(0, room - waste):
                yield None if _dominated(f, waste, number, present) else (waste, f)


def _dominated(filling: Filling, waste: int, number: np.ndarray, present: int) -> bool:
    """Whether some pieces of the filling could give place to one piece that is left, is larger than they are together (or,
    for several pieces, as large), and needs no more room than they and the waste have; or whether a piece fits the waste."""
    spare = present
    singles, several = 0, 0
    sums = 1
    for s, k in filling:
        if number[s] == k:
            spare &= ~(1 << s)
        singles |= 1 << s
        for _ in range(k):
            several |= (sums & ~1) << s
            sums |= sums << s
    if waste and spare & ((1 << (waste + 1)) - 1):
        return True
    # sums of pieces, moved up by 0 (1 for single pieces) to ``waste`` places
    for bits, width in ((several, waste + 1), (singles << 1, waste)):
        have = 1
        while have < width:
            step = min(have, width - have)
            bits |= bits << step
            have += step
        if width and bits & spare:
            return True
    return False


def _sequences(plan: Plan) -> int:
    return sum(times for times, _ in plan)


class _Node:
    """A node of the tree: the largest piece's fillings, those that a branch before has dealt with, and what is applied now."""

    def __init__(self, top: int, done: set):
        self.top, self.done = top, done
        self.options: Iterator | None = None
        self.bin: Filling = []
        self.key: tuple = ()
        self.waste = self.times = 0


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, steps: int | None = SEARCH_STEPS) -> tuple[Plan, int, bool]:
    """(plan, lower bound, whether the plan is proven to have the fewest sequences)."""
    left = _number(counts, capacity)
    sizes = np.arange(capacity + 1)
    total, bound = int((left * sizes).sum()), _bound(left, capacity)
    best = best_fit(left, capacity)
    fewest, ties = _sequences(best), True
    bins = waste = used = 0
    path: list[_Node] = []

    def open_node() -> None:
        """Stands on ``left``: takes a better incumbent if there is one, and opens a node unless a bound prunes it."""
        nonlocal best, fewest, ties
        if not left.any():
            if bins < fewest or ties and bins == fewest:
                best, fewest = [(n.times, n.bin) for n in path], bins
            ties = False
            return
        rest = best_fit(left, capacity)
        here = bins + _sequences(rest)
        if here < fewest or ties and here == fewest:
            best, fewest = [*((n.times, n.bin) for n in path), *rest], here
        aim = fewest if ties else fewest - 1
        if bins + _bound(left, capacity) > aim or aim * capacity - total < waste:
            ties = False
            return
        top = int(np.flatnonzero(left)[-1])
        path.append(_Node(top, set(path[-1].done) if path and path[-1].top == top else set()))
        if len(path) > LIVE_NODES:
            path[-1 - LIVE_NODES].options = None

    def options(node: _Node) -> Iterator:
        """Those of a node on which the search stands; what it has done before is passed over."""
        if node.options is None:
            left[node.top] -= 1
            node.options = fillings(left.copy(), capacity - node.top, (fewest if ties else fewest - 1) * capacity - total - waste)
            left[node.top] += 1
        return node.options

    def apply(node: _Node, times: int) -> None:
        nonlocal bins, waste
        for s, k in node.bin:
            left[s] -= k * times
        node.times += times
        bins += times
        waste += node.waste * times

    if fewest:
        open_node()
    while path and (fewest > bound or ties):
        node = path[-1]
        used += 1
        if steps is not None and used > steps:
            break
        if node.times:
            # the search came back: the same filling once less often, then the next one
            ties = False
            apply(node, -1)
            if node.times:
                open_node()
                continue
        while True:
            found = next(options(node), ())
            if found == ():
                path.pop()
                ties = False
                break
            used += 1
            if found is None:
                if steps is not None and used > steps:
                    break
                continue
            loss, filling = found
            key = tuple(filling)
            if key in node.done:
                continue
            node.done.add(key)
            whole = dict(filling)
            whole[node.top] = whole.get(node.top, 0) + 1
            node.bin, node.waste = sorted(whole.items(), reverse=True), loss
            aim = fewest if ties else fewest - 1
            allowed = aim * capacity - total - waste
            times = min(int(left[s]) // k for s, k in node.bin)
            if loss:
                times = min(times, allowed // loss)
            if times < 1:
                # fillings come by rising waste: no later one is allowed
                path.pop()
                ties = False
                break
            apply(node, times)
            open_node()
            break
    return best, bound, fewest == bound or not path


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, special: bool = True, steps: int | None = SEARCH_STEPS) -> DataFrame:
    """One row per piece with sequence_id and offset."""
    pieces = stored(pieces_of(docs, capacity, path, special))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # one row per length: capacity rows at most
    plan, _, _ = complete_bins(counts, capacity, steps)
    # for each length: from which number on, which sequences, how many in each, and where
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for times, bin_ in plan:
        at = 0
        for s, k in bin_:
            slots.setdefault(s, []).append((used.get(s, 0), base, k, at))
            used[s] = used.get(s, 0) + times * k
            at += s * k
        base += times
    table = {s: np.array(x, np.int64).T for s, x in slots.items()}

    salts = max(1, -(-sum(counts.values()) // GROUP_ROWS))
    # equal rows share a salt only if all their columns are equal; any order among those gives the same rows
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    group = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("rows")).withColumn("before", F.sum("rows").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")).select("length", "salt", "before")
    ranked = salted.withColumn("place", F.row_number().over(group)).join(before, ["length", "salt"]).withColumn("number", F.col("place") - 1 + F.col("before"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            length, number = b.column(3).to_numpy(zero_copy_only=False), b.column(5).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for s in np.unique(length).tolist():
                first, start, many, at = table[s]
                mine = np.flatnonzero(length == s)
                k = np.searchsorted(first, number[mine], "right") - 1
                nth = number[mine] - first[k]
                sequence[mine] = start[k] + nth // many[k]
                offset[mine] = at[k] + nth % many[k] * s
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
