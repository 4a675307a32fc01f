"""Language-model scoring by a weighted backoff automaton.

The model has a state for each context of the training texts (up to order - 1 tokens, begin signs included), an arc for each
n-gram seen after it, and a failure arc to the next shorter context. Smoothing is hierarchical (MacKay and Peto): an arc's
probability is (c(context, token) + a * p(token | shorter context)) / (c(context) + a); a failure arc weighs
a / (c(context) + a), so every state's arcs sum to one. The empty context's arcs are add-one estimates with one place for
unknown tokens. An arc leads to the longest context that it leaves known.

Counts come from the whole corpus and grow with it, so the automaton is never in one place: each block of documents asks
for the counts of just the n-grams that its texts can meet (see blocks), builds that part of the automaton (states, sorted
arcs, failure arcs) for some texts at a time, and walks these texts through it once, from left to right: a text carries its
state, takes the arc of the next token or falls back along failure arcs until one has it, and adds up the log-probabilities
on its way. All these texts walk in step. Every token but the last is followed by one, so an n-gram's count is also that of
the context it makes, and contexts need no counts of their own.

Defined results: a null or empty text is the one end token; null ids are never held out; without training texts (an empty
table has no rows at all) all counts are 0; repeated rows count as often as they occur; very long texts are scored whole;
further columns don't matter. Counts have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import U64, Block, blocks_of, count_keys, counted, distinct, joined_reply, mix, with_replies, word_hashes
from .common import read_table, stored

FOLDS = 7
ORDER = 3
#: Pseudo-count that a shorter context's estimate weighs against a context's own counts.
WEIGHT = 2.0
#: Tokens that a walker takes; longer texts have several.
STRETCH = 256
#: Tokens of the texts that walk in one automaton; what is built at a time is so bounded.
PART_TOKENS = 1 << 17
#: Larger blocks share more n-grams among their own texts.
LM_BLOCK_BYTES = 3 << 20

_END, _BEGIN, _GRAM = U64(0x3C6EF372FE94F82B), 0xA54FF53A5F1D36F1, 0x9B05688C2B3E6C1F


#: Keys of single tokens lie below, those of longer n-grams above.
SINGLE = U64(1 << 62)


def key_bits(n_blocks: int) -> int:
    """Bits of a longer n-gram's key: as many as let one in 10,000 n-grams meet another one by chance, at any size of the
    input (a block has a million of them or less). Single tokens' keys have 56 bits, as vocabularies are told exactly."""
    return min(63, 34 + n_blocks.bit_length())


def _salt(base: int, k: int) -> np.uint64:
    return U64(base * (2 * k + 1) & 0xFFFFFFFFFFFFFFFF)


def crc_text(ids: np.ndarray) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(str(i).encode()) for i in ids.tolist()], np.int64)


def held_out_rows(block: Block, folds: int = FOLDS) -> np.ndarray:
    return (crc_text(block.ids) % folds == 2) & (block.null == 0)


class Grams:
    """The n-grams of a block's token sequences: for each order the key of the n-gram that ends at each token. Before a
    text's first token stand begin signs."""

    def __init__(self, block: Block, order: int, bits: int):
        words, _, number = word_hashes(block)
        n = len(block)
        # each document's words, then its end
        length = number + 1
        last = np.cumsum(length) - 1
        tokens = np.empty(int(length.sum()), U64)
        inside = np.ones(len(tokens), bool)
        inside[last] = False
        tokens[inside], tokens[last] = words, _END
        self.length, self.first = length, last + 1 - length
        self.doc = np.repeat(np.arange(n), length)
        mask = ~U64((1 << (63 - bits)) - 1)
        self.keys: list[np.ndarray] = []
        gram = tokens
        for k in range(1, order + 1):
            key = mix(gram ^ _salt(_GRAM, k))
            self.keys.append(key >> U64(2) & ~U64(63) if k == 1 else (SINGLE * (U64(1) + key % U64(3))) | (key >> U64(2) & mask))
            before = np.empty_like(gram)
            before[1:], before[:1] = gram[:-1], 0
            before[self.first] = _salt(_BEGIN, k)
            gram = mix(before * U64(0xFF51AFD7ED558CCD) + tokens)
        self.end_key = (mix(np.array([_END]) ^ _salt(_GRAM, 1)) >> U64(2) & ~U64(63))[0]

    def part(self, begin: int, end: int) -> Grams:
        """Those of some documents in a row."""
        out = object.__new__(Grams)
        out.length, out.end_key = self.length[begin:end], self.end_key
        i, j = int(self.first[begin]), int(self.first[end - 1] + self.length[end - 1])
        out.first, out.doc, out.keys = self.first[begin:end] - i, self.doc[i:j] - begin, [k[i:j] for k in self.keys]
        return out

    def parts(self, tokens: int) -> Iterator[Grams]:
        """Parts of about so many tokens; a text is never cut."""
        ends = self.first + self.length
        begin = 0
        while begin < len(ends):
            end = max(begin + 1, int(np.searchsorted(ends, self.first[begin] + tokens, "right")))
            yield self.part(begin, end)
            begin = end


def gram_counts(order: int, folds: int, bits: int):
    """A block's distinct keys with their counts in training texts (0 for those of held-out texts alone)."""

    def keys(block: Block) -> tuple[np.ndarray, np.ndarray]:
        grams = Grams(block, order, bits)
        held = held_out_rows(block, folds)[grams.doc]
        known, number = counted(np.concatenate([k[~held] for k in grams.keys]))
        more = distinct(np.concatenate([k[held] for k in grams.keys]))
        del grams
        if len(known):
            more = more[known[np.minimum(np.searchsorted(known, more), len(known) - 1)] != more]
        at = np.searchsorted(known, more)
        return np.insert(known, at, more), np.insert(number, at, 0)

    return keys


class Automaton:
    """The part of the automaton that some texts meet, of whose n-grams the sorted ``keys`` have ``counts``. State 0 is the empty context; ``fail`` and ``fail_weight`` are the
    states' failure arcs; arc i leaves a state by a token: ``arcs`` holds state * tokens + token, sorted."""

    def __init__(self, grams: Grams, order: int, known: np.ndarray, counts: np.ndarray, tokens: int, types: int, weight: float):
        n = len(grams.doc)
        trained = int(counts[np.searchsorted(known, grams.end_key)])
        keys, place = np.unique(np.concatenate(grams.keys), return_inverse=True)
        counts = counts[np.searchsorted(known, keys)]
        place = place.astype(np.int32).reshape(order, n)
        first = np.zeros(n, bool)
        first[grams.first] = True
        # a token's number is that of its key; single tokens' keys come first
        self.token, self.tokens = place[0], int(np.searchsorted(keys, SINGLE))
        self.unknown = float(np.log10(1 / (tokens + types + 1)))
        total = [counts[p].astype(np.float64) for p in place]
        self.known = total[0] > 0
        # states: 0, then the contexts of begin signs by length, then every n-gram of less than order tokens that was seen
        begin = order - 1 if trained else 0
        self.start, made = begin, 1 + begin
        fail, fail_weight = [np.array([0, *range(begin)])], [np.array([0.0] + [np.log10(weight / (trained + weight))] * begin)]
        named = [np.zeros(n, np.int32)]
        state_of = np.empty(len(keys), np.int32)
        where = np.empty(len(keys), np.int32)
        where[place.ravel()] = np.tile(np.arange(n, dtype=np.int32), order)  # some place of each n-gram
        for k in range(1, order):
            mine = np.zeros(len(keys), bool)
            mine[place[k - 1][total[k - 1] > 0]] = True
            names = np.flatnonzero(mine)
            state_of[:] = -1
            state_of[names] = made + np.arange(len(names), dtype=np.int32)
            rows = where[names]
            fail.append(np.maximum(named[-1][rows], 0))
            fail_weight.append(np.log10(weight / (counts[names] + weight)))
            made += len(names)
            named.append(state_of[place[k - 1]])
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        # arcs, shortest context first: each n-gram that was seen, from the state of the tokens before it
        p = (total[0] + 1) / (tokens + types + 1)
        self.base = np.log10(p)
        arcs, weights, heads, head = [], [], [], np.zeros(n, np.int32)
        for k in range(1, order + 1):
            if k > 1:
                held = np.concatenate([[0.0], total[k - 2][:-1]])
                held[first] = trained
                p = (total[k - 1] + weight * p) / (held + weight)
            if k < order:
                head = np.where(named[k] >= 0, named[k], head)
            mine = np.zeros(len(keys), bool)
            mine[place[k - 1][total[k - 1] > 0]] = True
            rows = where[np.flatnonzero(mine)]
            source = np.where(first[rows], k - 1, named[k - 1][rows - 1]) if k > 1 else np.zeros(len(rows), np.int64)
            arcs.append(source.astype(np.int64) * self.tokens + self.token[rows])
            weights.append(np.log10(p[rows]))
            heads.append(head[rows])
        every = np.concatenate(arcs)
        by = np.argsort(every)
        self.arcs, self.weights, self.heads = every[by], np.concatenate(weights)[by], np.concatenate(heads)[by]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each walker's next state and the log-probability of its token."""
        gained = np.zeros(len(state))
        out = np.zeros(len(state), np.int64)
        going = np.arange(len(state))
        while len(going):
            want = state * self.tokens + token
            at = np.searchsorted(self.arcs, want)
            at[at == len(self.arcs)] = 0
            hit = self.arcs[at] == want if len(self.arcs) else np.zeros(len(going), bool)
            took = going[hit]
            gained[took] += self.weights[at[hit]]
            out[took] = self.heads[at[hit]]
            miss = ~hit
            # no arc from the empty context: an unknown token, after which nothing is known
            lost = miss & (state == 0)
            gained[going[lost]] += self.unknown
            miss &= ~lost
            going, state, token = going[miss], state[miss], token[miss]
            gained[going] += self.fail_weight[state]
            state = self.fail[state]
        return out, gained

    def walk(self, grams: Grams, order: int) -> np.ndarray:
        """Each text's log10 probability. All texts walk from left to right, in step. Long ones walk as stretches: a stretch
        sets out at the empty context, order - 1 tokens before its first, and so reaches it in the state of the whole walk,
        which is the longest known context of these tokens."""
        many = -(-grams.length // STRETCH)
        text = np.repeat(np.arange(len(many)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        lead = np.where(nth > 0, order - 1, 0)
        length = np.minimum(STRETCH, grams.length[text] - nth * STRETCH) + lead
        by = np.argsort(-length, kind="stable")
        text, nth, lead, length = text[by], nth[by], lead[by], length[by]
        first = grams.first[text] + nth * STRETCH - lead
        score, state = np.zeros(len(by)), np.where(nth > 0, 0, self.start)
        alive = len(by)
        for t in range(int(length[0]) if len(length) else 0):
            while length[alive - 1] <= t:
                alive -= 1
            state, gained = self.step(state[:alive], self.token[first[:alive] + t].astype(np.int64))
            score[:alive] += np.where(t < lead[:alive], 0.0, gained)
        return np.bincount(text, score, len(many))


def _score(order: int, folds: int, bits: int, tokens: int, types: int, weight: float):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for data, replies in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                block = Block(data)
                grams = Grams(block, order, bits)
                known, counts, n = distinct(np.concatenate(grams.keys)), joined_reply(replies), len(block)
                found = []
                for part in grams.parts(PART_TOKENS):
                    automaton = Automaton(part, order, known, counts, tokens, types, weight)
                    found.append([np.bincount(part.doc, x, len(part.length)) for x in (automaton.known, automaton.base)] + [automaton.walk(part, order)])
                seen, base, score = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [block.id_column(), pa.array(held_out_rows(block, folds)), pa.array(grams.length), pa.array(seen.astype(np.int64)), pa.array(np.full(n, tokens, np.int64)), pa.array(base), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score_documents(docs: DataFrame, order: int = ORDER, folds: int = FOLDS, weight: float = WEIGHT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = blocks_of(docs, size=LM_BLOCK_BYTES)
    n_blocks = blocks.count()
    bits = key_bits(n_blocks)

    def tally(keys: np.ndarray, totals: np.ndarray) -> tuple[int, int]:
        single = keys < SINGLE
        return int(totals[single].sum()), int((totals[single] > 0).sum())

    replies = stored(count_keys(blocks, gram_counts(order, folds, bits), n_blocks, 64, tally))
    tokens, types = replies.agg(F.coalesce(F.sum("t0"), F.lit(0)), F.coalesce(F.sum("t1"), F.lit(0))).first()
    return with_replies(blocks, replies.select("g", "bucket", "reply")).select("g", "data", "replies").mapInArrow(_score(order, folds, bits, tokens, types, weight), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
