"""SentencePiece BPE encoding and decoding by a prefix table.

A text's encoding by merges is determined by one fact per prefix: the last token of that prefix's own encoding. The
table is filled from left to right. At each place an automaton over the vocabulary names the tokens that end there; a
candidate is the prefix's last token exactly if it is compatible with the last token of the prefix before it, that is,
if merging the pair's characters gives just this pair. One token passes at each place. The ids are then read backwards.

Merges never join a word to the next one's space sign, so the table is filled per unit (space signs with the word after
them), and each distinct unit once per task. Runs of space signs merge last and by place, not by rank: their ids depend
on their length alone and are kept per length.

Defined results: a null or empty text has the two ids begin and end and decodes to the empty text; characters outside
the vocabulary become byte tokens, as the library does it; repeated rows are encoded each for itself; null ids pass through;
very long texts are encoded whole; an empty table gives no rows; further columns don't matter.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import documents_of, read_table

SPACE = "▁"
#: Units kept per task; beyond them the store is emptied and refilled.
KEPT_UNITS = 800_000


class PieceModel:
    """Vocabulary, merge order and decoding of one SentencePiece BPE model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or len(spec.precompiled_charsmap) or not spec.escape_whitespaces or spec.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model without normalisation is needed")
        self.prefix_space = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        # the kinds of pieces: 1 normal, 2 unknown, 3 control, 6 byte
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        self.score = {p.piece: p.score for p in model.pieces if p.type in (1, 4)}
        self.byte_ids = [0] * 256
        self.raw = [b""] * len(self.pieces)
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.raw[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type in (1, 4):
                self.raw[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == 2:
                self.raw[i] = model.trainer_spec.unk_surface.encode()
        self.bos = next(i for i, p in enumerate(self.pieces) if p == "<s>")
        self.eos = next(i for i, p in enumerate(self.pieces) if p == "</s>")
        #: With a space sign inside a piece, units would not be independent; the whole text is one unit then.
        self.splits = not any(SPACE in p.lstrip(SPACE) or p[:2] == SPACE * 2 and p.strip(SPACE) for p in self.ids)
        self.longest = max(map(len, self.ids))
        self.automaton = self._automaton()
        self.kept: dict[str, bytes] = {}
        self.runs: dict[int, tuple[str, ...]] = {}

    def _automaton(self):
        """The pieces with their lengths and the tokens known to fit, or not to fit, before them."""
        import ahocorasick

        out = ahocorasick.Automaton()
        for p in self.ids:
            # a piece that merges can't reach is never a token
            if self.merged(p) == (p,):
                out.add_word(p, (len(p), p, {}))
        out.make_automaton()
        return out

    def merged(self, text: str) -> tuple[str, ...]:
        """The library's definition: the best-scored adjacent pair merges first, among equals the leftmost."""
        symbols: list[str] = list(text)
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(symbols) and (both := symbols[i] + symbols[j]) in self.score:
                heapq.heappush(heap, (-self.score[both], i, j, both))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not symbols[i] or not symbols[j] or symbols[i] + symbols[j] != both or after[i] != j:
                continue
            symbols[i], symbols[j] = both, ""
            after[i] = after[j]
            if after[j] < len(symbols):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return tuple(s for s in symbols if s)

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the characters of both gives just these two tokens."""
        return self.merged(a + b) == (a, b)

    def tokens(self, unit: str) -> list[str]:
        """The tokens of a unit, read backwards from the table of each prefix's last token."""
        last: list[str] = [""] * (len(unit) + 1)
        # of the pieces that end at one place the automaton names the longest first
        for end, (size, piece, fits) in self.automaton.iter(unit):
            at = end + 1 - size
            if last[end + 1]:
                continue
            if at:
                # no piece ends at a character outside the vocabulary: it is a token of its own
                before = last[at] or unit[at - 1]
                known = fits.get(before)
                if known is None:
                    known = fits[before] = self.compatible(before, piece)
                if not known:
                    continue
            last[end + 1] = piece
        out, at = [], len(unit)
        while at:
            token = last[at] or unit[at - 1]
            out.append(token)
            at -= len(token)
        return out[::-1]

    def numbers(self, tokens) -> bytes:
        out: list[int] = []
        for t in tokens:
            known = self.ids.get(t)
            if known is None:
                out += [self.byte_ids[b] for b in t.encode()]
            else:
                out.append(known)
        return struct.pack(f"<{len(out)}I", *out)

    def unit_ids(self, unit: str) -> bytes:
        word = unit.lstrip(SPACE)
        if len(unit) - len(word) < 2 or not self.splits:
            return self.numbers(self.tokens(unit))
        tokens = self.tokens(SPACE + word) if word else []
        run = len(unit) - len(word) - 1
        if not word or tokens[0] == SPACE:
            run, tokens = run + 1, tokens[1:]
        if run not in self.runs:
            if len(self.runs) > 4096:
                self.runs.clear()
            self.runs[run] = self.merged(SPACE * run)
        return self.numbers([*self.runs[run], *tokens])

    def encode(self, text: str) -> bytes:
        """The ids without begin and end, as little-endian 32-bit integers."""
        if not text:
            return b""
        text = (SPACE if self.prefix_space else "") + text.replace(" ", SPACE)
        units = re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+$", text) if self.splits else [text]
        kept = self.kept
        try:
            return b"".join(map(kept.__getitem__, units))
        except KeyError:
            pass
        if len(kept) > KEPT_UNITS:
            kept.clear()
        for u in units:
            if u not in kept:
                kept[u] = self.unit_ids(u)
        return b"".join(map(kept.__getitem__, units))

    def decode(self, ids: bytes) -> str:
        """The text of the ids; control ids say nothing, and the first piece loses the space that encoding put before it."""
        raw = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.prefix_space and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


@lru_cache(4)
def model_at(path: str) -> PieceModel:
    return PieceModel(path)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_texts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``ids`` (begin, text, end) of every text."""

    def run(batches):
        import pyarrow as pa

        model = model_at(path or model_path())
        for b in batches:
            ids = [[model.bos, *np.frombuffer(model.encode(t or ""), "<u4").tolist(), model.eos] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ``text`` from ``ids``; null ids give the empty text."""

    def run(batches):
        import pyarrow as pa

        model = model_at(path or model_path())
        for b in batches:
            texts = [model.decode(np.array(x or [], "<u4").tobytes()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def token_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        model = model_at(path or model_path())
        begin, end = np.array([model.bos], "<u4").tobytes(), np.array([model.eos], "<u4").tobytes()
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for t in b.column(1).to_pylist():
                ids = begin + model.encode(t or "") + end
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                text_hash.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(read_table(spark, sf_dir, "documents"))
