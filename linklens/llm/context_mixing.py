"""Operator 11: language-model scores by online logistic mixing of hashed-context bit predictors.

A text is its words in lower case and one end. A word is spelled as its bytes and a space, the end as a space alone; every byte is a path
through one binary code tree, so each step is a bit to predict. For each bit,

* a predictor per context (the last one, two and three bytes, and the word so far) looks up how often the bit was 0 or 1 after the hashed
  context in the training documents;
* the predictors' log odds are combined by weights, which a gate chooses by how often the two longest contexts were seen;
* the product of a token's bits is refined adaptively: each document mixes it with the share of the known word among those of its head,
  with the word's share in the document so far and with the word that followed the last two before. The weights (a logistic model with one
  set a document) follow the document's own gains after every ``BLOCK`` tokens.

Only what lies before a token is used for it, so the product over a text is a probability.

The first two bytes of a word (its head) see the end of the word before, the rest (its tail) only the word itself. So bit counts follow
from two tables of counts, (end before, head) and words: counters, weights and the tokens' probabilities are computed on distinct heads and
words, not on texts. The weights are learned online, row by row in hash order, each task on its share, and averaged; a row's own
occurrence is taken out of the counters first, as it would be for a new text.

Of fixed size: the counters (2^bits slots a context, shared by contexts of one hash), the code tree, the weights. They are all that is broadcast.
Head and word counts grow with the corpus and are joined.

Defined cases: a null text is empty and has the end alone; a null id is not held out; repeated rows are scored each, and count each; words
seen in no training document have count 0; without training documents counts, N and V are 0 and the model knows no bits; an empty table
gives no row; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm.word_slices import LOWER, VALUES, bin_count, bin_rows, encoded, merged, opened_ids, received, sent_back, table, unpacked
from linklens.session import stage

FOLDS, HELD = 7, 2
SLOT_BITS = (17, 20, 21, 22)
ORDERS = len(SLOT_BITS)
PRIOR = 0.4
STEPS = (1, 3, 8, 32, 256)  # contexts seen less often share a gate
GATES = (len(STEPS) + 1) ** 2
HEAD = 2
BLOCK, RATE, START = 32, 0.1, (1.5, 0.5, -1.0)  # bits, known words, the text so far
REPEATS = 8
ROWS, LEARN_ROWS = 4096, 1024
SUM_BLOCK = 1 << 16
EXACT, GROWTH = 32, 1.13
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_ROLL = 0x5851F42D4C957F2D
_UNROLL = pow(_ROLL, -1, 1 << 64)


def split(text: bytes) -> list[bytes]:
    """Words in lower case, then the end (an empty word)."""
    words = text.translate(LOWER).split()
    words.append(b"")
    return words


def held(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


# -- counts of one byte ------------------------------------------------------------------------------------------------------------

_LEVELS = np.concatenate([np.arange(EXACT), (EXACT - 1) * GROWTH ** np.arange(1, 257 - EXACT)])


def quantised(counts: np.ndarray) -> np.ndarray:
    """Level of each count: small ones exactly, others to the nearest of a rising scale."""
    high = np.rint(np.log(np.maximum(counts, 1) / (EXACT - 1)) / np.log(GROWTH)) + EXACT - 1
    return np.where(counts < EXACT, counts, np.clip(high, EXACT - 1, 255)).astype(np.uint16)


def _odds() -> tuple[np.ndarray, np.ndarray]:
    """By code (level of zeros + 256 * level of ones): log odds and the step of the sum; as they are, then without one 0, then without one 1."""
    zeros, ones = np.tile(_LEVELS, 256), np.repeat(_LEVELS, 256)
    odds, seen = [], []
    for less_0, less_1 in ((0, 0), (1, 0), (0, 1)):
        a, b = np.maximum(zeros - less_0, 0), np.maximum(ones - less_1, 0)
        odds.append(np.log((b + PRIOR) / (a + PRIOR)))
        seen.append(np.searchsorted(STEPS, a + b, side="right"))
    return np.concatenate(odds).astype(np.float32), np.concatenate(seen).astype(np.uint8)


ODDS, SEEN = _odds()


# -- bits of words -------------------------------------------------------------------------------------------------------------------

def code_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary code of the 256 bytes by their counts: lengths, and per byte the inner nodes passed and the bits taken there."""
    counts = np.maximum(counts.astype(float), max(1.0, counts.sum() / (1 << 16)))
    heap = [(float(n), i, i) for i, n in enumerate(counts)]
    heapq.heapify(heap)
    parent, side, node = np.zeros(511, int), np.zeros(511, int), 256
    while len(heap) > 1:
        (a, tie, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        parent[left], parent[right], side[right] = node, node, 1
        heapq.heappush(heap, (a + b, tie, node))
        node += 1
    paths = []
    for byte in range(256):
        path, at = [], byte
        while at != node - 1:
            path.append((parent[at] - 256, side[at]))
            at = parent[at]
        paths.append(path[::-1])
    length = np.array([len(p) for p in paths])
    nodes, bits = np.zeros((256, length.max()), np.uint64), np.zeros((256, length.max()), np.int8)
    for byte, path in enumerate(paths):
        nodes[byte, :len(path)], bits[byte, :len(path)] = zip(*path)
    return length, nodes, bits


@dataclass
class Bits:
    """The bits of some rows in order: number per row; per bit its value and its slot for each context."""
    number: np.ndarray
    bit: np.ndarray
    slots: list[np.ndarray]


def bits_of(rows: list[bytes], own: int, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Bits:
    """Bits of the bytes of each row after the first ``HEAD``; the widest context begins at byte ``own``."""
    lengths, nodes, bits = tree
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    text = np.frombuffer(b"".join(rows), np.uint8)
    start = np.cumsum(size) - size
    place = np.arange(len(text)) - np.repeat(start, size)
    wide = text.astype(np.uint64)
    contexts, context = [], np.zeros(len(text), np.uint64)
    for back in range(1, ORDERS):
        byte = np.zeros(len(text), np.uint64)
        byte[back:] = wide[:-back]
        context = context | np.where(place >= back, byte, np.uint64(0)) << np.uint64(8 * (back - 1))
        contexts.append(context)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(text), _ROLL, np.uint64)]))
    inverse = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(text), _UNROLL, np.uint64)]))
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((wide + np.uint64(1)) * power[:-1])])
    begin = np.minimum(start + own, len(text))
    contexts.append((running[:-1] - np.repeat(running[begin], size)) * np.repeat(inverse[begin], size))

    kept = np.flatnonzero(place >= HEAD)
    number = lengths[text[kept]]
    of = np.repeat(kept, number)
    step = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
    at = text[of]
    node = nodes[at, step] * _MIX[1]
    slots = [(((c * _MIX[0])[of] ^ node) * _MIX[2] >> np.uint64(64 - b)).astype(np.int64) for c, b in zip(contexts, SLOT_BITS)]
    total = np.concatenate([[0], np.cumsum(number)])
    ends = np.cumsum(np.maximum(size - HEAD, 0))
    return Bits(np.diff(total[ends], prepend=0), bits[at, step], slots)


# -- training ------------------------------------------------------------------------------------------------------------------------

def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of training documents, with the space that ends them, and their counts, from bins."""
    for _, words, counts in bin_rows(batches):
        used = np.flatnonzero(counts)
        yield [words[i] + b" " for i in used], counts[used]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    for batch in batches:
        yield batch.column("row").to_pylist(), batch.column("c").to_numpy()


def _chunks(tables: Iterator[tuple[list[bytes], np.ndarray]], most: int) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Rows and counts in runs of at most ``most`` rows and about 64 bytes a row; a longer row is a run of its own."""
    for rows, counts in tables:
        first = total = 0
        for i, row in enumerate(rows):
            if i > first and (i - first >= most or total + len(row) > 64 * most):
                yield rows[first:i], counts[first:i]
                first, total = i, 0
            total += len(row)
        if first < len(rows):
            yield rows[first:], counts[first:]


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes as spelled, the number of words (at 256) and of distinct words (at 257)."""
    total = np.zeros(258)
    for rows, counts in _chunks(_words(batches), ROWS):
        total[:256] += np.bincount(np.frombuffer(b"".join(rows), np.uint8), np.repeat(counts, [len(r) for r in rows]), 256)
        total[256:] += counts.sum(), len(rows)
    yield pa.RecordBatch.from_arrays([pa.array(range(258), pa.int32()), pa.array(total)], ["byte", "n"])


def _count(tree, own: int, opened):
    """The counters of one task, as the used entries of each block of ``SUM_BLOCK``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 << b) for b in SLOT_BITS]
        for rows, counts in _chunks(opened(batches), ROWS):
            b = bits_of(rows, own, tree)
            weight = np.repeat(counts.astype(float), b.number)
            for table, slot in zip(tables, b.slots):
                np.add.at(table, 2 * slot + b.bit, weight)
        for order, table in enumerate(tables):
            for block in range(len(table) // SUM_BLOCK):
                values = table[block * SUM_BLOCK:(block + 1) * SUM_BLOCK]
                used = np.flatnonzero(values)
                if len(used):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([order], pa.int32()), pa.array([block], pa.int32()), pa.array([used.astype("<u2").tobytes()], pa.binary()),
                         pa.array([values[used].tobytes()], pa.binary())], ["order", "block", "used", "counts"])
    return run


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of one task, quantised: two counts in one code."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for order, block, used, counts in zip(*(batch.column(c).to_pylist() for c in ("order", "block", "used", "counts"))):
            total = sums.setdefault((order, block), np.zeros(SUM_BLOCK))
            total[np.frombuffer(used, "<u2")] += np.frombuffer(counts)
    for (order, block), total in sums.items():
        levels = quantised(total)
        yield pa.RecordBatch.from_arrays([pa.array([order], pa.int32()), pa.array([block], pa.int32()),
                                          pa.array([(levels[0::2] | levels[1::2] << 8).astype("<u2").tobytes()], pa.binary())], ["order", "block", "codes"])


@dataclass
class Mixer:
    """Counters and weights for the bits of heads or of tails."""
    own: int
    tree: tuple[np.ndarray, np.ndarray, np.ndarray]
    tables: list[np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.hstack([np.full((GATES, ORDERS - 1), 0.1), np.full((GATES, 1), 0.7), np.zeros((GATES, 1))]))

    def look_up(self, b: Bits, without_own: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of the predictors per bit, and the gates."""
        less = (b.bit.astype(np.int64) + 1) << 16 if without_own else 0
        odds, gate = np.empty((ORDERS, len(b.bit)), np.float32), np.zeros(len(b.bit), np.int64)
        for order, (table, slot) in enumerate(zip(self.tables, b.slots)):
            code = table[slot] + less
            odds[order] = ODDS[code]
            if order >= ORDERS - 2:
                gate = gate * (len(STEPS) + 1) + SEEN[code]
        return odds, gate

    def mixed(self, odds: np.ndarray, gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
        total = weights[:, -1][gate]
        for order in range(ORDERS):
            total += weights[:, order][gate] * odds[order]
        return np.clip(total, -20, 20)

    def scores(self, rows: list[bytes]) -> np.ndarray:
        """Natural log of the probability of each row's bits."""
        parts = [np.zeros(0)]
        for i in range(0, len(rows), ROWS):
            b = bits_of(rows[i:i + ROWS], self.own, self.tree)
            odds, gate = self.look_up(b)
            lost = np.log1p(np.exp((1 - 2 * b.bit) * self.mixed(odds, gate, self.weights)))
            ends = np.cumsum(b.number)
            parts.append(-np.diff(np.concatenate([[0], np.cumsum(lost)])[ends], prepend=0))
        return np.concatenate(parts)


def _learn(shared, opened):
    """Online Newton steps over one task's rows: each run of rows is predicted first, then moves the weights by its slope, measured in the curvature so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer = shared.value
        weights, curve = mixer.weights.copy(), np.tile(np.eye(ORDERS + 1) * 20.0, (GATES, 1, 1))
        for rows, counts in _chunks(opened(batches), LEARN_ROWS):
            b = bits_of(rows, mixer.own, mixer.tree)
            odds, gate = mixer.look_up(b, without_own=True)
            share = np.repeat(np.minimum(counts, 64).astype(float), b.number)
            chance = 1 / (1 + np.exp(-mixer.mixed(odds, gate, weights)))
            order = np.argsort(gate.astype(np.uint8), kind="stable")
            x = np.stack([*odds, np.ones(len(gate), np.float32)], axis=1)[order]
            miss, steep = (v.astype(np.float32)[order] for v in ((b.bit - chance) * share, chance * (1 - chance) * share))
            ends = np.cumsum(np.bincount(gate, minlength=GATES))
            for g, (low, high) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
                if high > low:
                    curve[g] += x[low:high].T @ (x[low:high] * steep[low:high, None])
                    weights[g] += np.clip(np.linalg.solve(curve[g], x[low:high].T @ miss[low:high]), -0.5, 0.5)
        sums = np.concatenate([curve.reshape(GATES, -1), np.einsum("gij,gj->gi", curve, weights)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(GATES), pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], ["gate", "sums"])
    return run


def joined_weights(sums: np.ndarray) -> np.ndarray:
    """Weights of all tasks, each counting by its curvature."""
    n = ORDERS + 1
    return np.linalg.solve(sums[:n * n].reshape(n, n), sums[n * n:])


def totals(words: DataFrame) -> tuple[np.ndarray, int, int]:
    """How often each byte is spelled in training documents, their words and distinct words."""
    counts = np.zeros(258)
    for row in words.mapInArrow(_histogram, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        counts[row["byte"]] = row["n"]
    return counts[:256], int(counts[256]), int(counts[257])


def fit(rows: DataFrame, own: int, tree, opened) -> Mixer:
    """Counters and weights from a table that ``opened`` reads as rows and their counts above 0."""
    parts = rows.mapInArrow(_count(tree, own, opened), "order int, block int, used binary, counts binary")
    blocks = parts.repartition("order", "block").mapInArrow(_sum_blocks, "order int, block int, codes binary").collect()
    tables = [np.zeros(1 << b, np.uint16) for b in SLOT_BITS]
    half = SUM_BLOCK // 2
    for row in blocks:
        tables[row["order"]][row["block"] * half:(row["block"] + 1) * half] = np.frombuffer(bytes(row["codes"]), "<u2")
    mixer = Mixer(own, tree, tables)
    shared = rows.sparkSession.sparkContext.broadcast(mixer)
    learned = rows.mapInArrow(_learn(shared, opened), "gate int, sums array<double>")
    width = (ORDERS + 1) * (ORDERS + 2)
    for row in learned.groupBy("gate").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect():
        mixer.weights[row["gate"]] = joined_weights(np.array(row[1:]))
    return mixer


# -- heads and repeats of a slice ----------------------------------------------------------------------------------------------------

@dataclass
class Slice:
    """Tokens of whole texts: ``ids`` number ``words``, a text ends before each of ``ends``."""
    words: list[bytes]
    ids: np.ndarray
    ends: np.ndarray

    def __post_init__(self):
        self.sizes = np.diff(self.ends, prepend=0)
        self.starts = self.ends - self.sizes
        self.text = np.repeat(np.arange(len(self.ends)), self.sizes)

    def heads(self) -> tuple[list[bytes], np.ndarray]:
        """Distinct rows (two bytes of the word before, head) and their number per token; the word before a text's first is empty."""
        short = np.frombuffer(b"".join([w[-2:].rjust(2, b"\0") + (w[:2] + b" \0")[:2] for w in self.words]) + bytes(4), ">u2").reshape(-1, 2)
        (ends, end_of), (heads, head_of) = (np.unique(short[:, side], return_inverse=True) for side in (0, 1))
        before = np.concatenate([[len(self.words)], self.ids[:-1]])
        before[self.starts] = len(self.words)
        pairs = end_of[before] * np.int64(len(heads)) + head_of[self.ids]
        if len(ends) * len(heads) <= 1 << 24:
            used = np.flatnonzero(np.bincount(pairs))
            number = np.zeros(used[-1] + 1 if len(used) else 0, np.int64)
            number[used] = np.arange(len(used))
            of = number[pairs]
        else:
            used, of = np.unique(pairs, return_inverse=True)
        rows = [int(ends[p // len(heads)]).to_bytes(2) + int(heads[p % len(heads)]).to_bytes(2).rstrip(b"\0") for p in used.tolist()]
        return rows, of

    def _grouped(self, *keys: np.ndarray, hashed: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places in order of (keys, place), and where a new group begins; ``hashed`` groups may hold different keys."""
        places = np.arange(len(self.ids))
        bits = [int(k.max(initial=0)).bit_length() for k in keys]
        low = max(1, len(places).bit_length())
        if not hashed and sum(bits) + low > 63:
            order = np.lexsort(keys[::-1])
            new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        else:
            if hashed:
                key = np.zeros(len(places), np.uint64)
                for k in keys:
                    key = (key ^ k.astype(np.uint64)) * _MIX[0]
                    key ^= key >> np.uint64(29)
                key = key >> np.uint64(low) << np.uint64(low)
            else:
                key = np.zeros(len(places), np.uint64)
                for k, b in zip(keys, bits):
                    key = key << np.uint64(b) | k.astype(np.uint64)
                key = key << np.uint64(low)
            key = np.sort(key | places.astype(np.uint64))
            order = (key & np.uint64((1 << low) - 1)).astype(np.int64)
            new = np.diff(key >> np.uint64(low)) != 0
        return order, np.concatenate([[True], new])[:len(order)]

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Per token the word foreseen from the last place where the same two words stood (-1: none), and how many such guesses were right in a row, as a step."""
        n = len(self.ids)
        last, last_but_one = (np.concatenate([np.zeros(k, np.int64), self.ids[:n - k]]) for k in (1, 2))
        order, new = self._grouped(self.text, last_but_one, last, hashed=True)
        early = np.arange(n) - self.starts[self.text] < 2
        same = ~new[1:] & (self.text[order[1:]] == self.text[order[:-1]]) & ~early[order[1:]] & ~early[order[:-1]]
        guess = np.full(n, -1, np.int64)
        guess[order[1:][same]] = self.ids[order[:-1][same]]
        places = np.arange(n)
        wrong = np.maximum.accumulate(np.where(guess == self.ids, -1, places))
        run = np.concatenate([[0], (places - wrong)[:-1]])
        run[self.starts] = 0
        steps = np.minimum(np.ceil(np.log2(np.arange(1, (1 << REPEATS) + 1))), REPEATS - 1).astype(np.int64)
        return guess, steps[np.minimum(run, 1 << REPEATS) - (run >= 1 << REPEATS)]

    def said(self) -> np.ndarray:
        """Per token how often its text had the word before."""
        order, new = self._grouped(self.text, self.ids)
        places = np.arange(len(order))
        out = np.empty(len(order), np.int64)
        out[order] = places - np.maximum.accumulate(np.where(new, places, 0))
        return out


def opened(row) -> Slice:
    ends = row["ends"].values.to_numpy()
    return Slice(unpacked(row["words"].as_py(), row["n_words"].as_py()), opened_ids(row["ids"].as_py(), int(ends[-1])), ends)


def head_codes(words: list[bytes]) -> np.ndarray:
    """The head of each word as a number of two bytes; the end's second is 0."""
    return np.frombuffer(b"".join([(w[:HEAD] + b" \0")[:HEAD] for w in words]), ">u2").astype(np.int64)


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of heads in the training texts of each slice, and of guesses made and right by their run."""
    for batch in batches:
        for i in range(batch.num_rows):
            one = opened({c: batch.column(c)[i] for c in ("words", "n_words", "ids", "ends")})
            trained = ~np.array(batch.column("marks")[i].as_py(), bool)[one.text]
            rows, of = one.heads()
            counts = np.bincount(of[trained], minlength=len(rows))
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([rows[k] for k in used], pa.binary()), pa.array(counts[used])], ["row", "c"])
            guess, run = one.repeats()
            made = trained & (guess >= 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b"%d" % k for k in range(2 * REPEATS)], pa.binary()),
                 pa.array(-1 - np.concatenate([np.bincount(run[made], minlength=REPEATS), np.bincount(run[made & (guess == one.ids)], minlength=REPEATS)]))], ["row", "c"])


# -- scoring -------------------------------------------------------------------------------------------------------------------------

def refined(one: Slice, head: np.ndarray, tail: np.ndarray, known: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """Natural log of each text's probability.

    A token's probability is a mixture: its bits (natural logs ``head`` and ``tail``), its head's bits and the share of the word among
    words of that head (``known``), its share in the text so far (before the first: its bits) and, where there is a guess, the guess;
    ``trust`` has the guesses' weights by run. The other weights follow the text's own gains.
    """
    guess, run = one.repeats()
    weight = np.where(guess >= 0, trust[run], 0.0)
    right = guess == one.ids
    first = np.exp(head)
    order = np.argsort(-one.sizes, kind="stable")  # texts of like length go in step, their tokens side by side
    size, start = one.sizes[order], one.starts[order]
    bits = first * np.exp(tail)
    said = one.said() / np.maximum(np.arange(len(one.ids)) - one.starts[one.text], 1)
    said[one.starts] = bits[one.starts]
    parts = (bits, first * known, said)
    score, lean = np.zeros(len(one.ends)), np.tile(np.array(START)[:, None], len(one.ends))
    for begin in range(0, int(size[0]) if len(size) else 0, BLOCK):
        active = int(np.searchsorted(-size, -begin, side="left"))
        take = np.minimum(size[:active] - begin, BLOCK)
        ends = np.cumsum(take)
        at = np.repeat(start[:active] + begin - ends + take, take) + np.arange(ends[-1])
        share = np.exp(lean[:, :active])
        share /= share.sum(0)
        told = [np.repeat(s, take) * p[at] for s, p in zip(share, parts)]
        mix = told[0] + told[1] + told[2]
        held = weight[at]
        score[:active] += np.add.reduceat(np.log(mix + held * (right[at] - mix)), ends - take)
        gain = np.array([np.add.reduceat(t / mix, ends - take) for t in told]) - share * take
        lean[:, :active] = np.clip(lean[:, :active] + RATE * gain, -5, 5)
    out = np.empty(len(score))
    out[order] = score
    return out


_VALUE = np.dtype([("c", "<i8"), ("tail", "<f4")])


def _tails(shared):
    """Count and natural log of the tail's probability of each word, sent to the slices that have it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, counts in bin_rows(batches):
            values = np.empty(len(words), _VALUE)
            values["c"], values["tail"] = counts, shared.value.scores([w + b" " for w in words])
            yield sent_back(row, values)
    return run


def _head_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16)
    for rows, counts in _chunks(_words(batches), ROWS):
        total += np.bincount(head_codes([r[:-1] for r in rows]), counts, 1 << 16)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["head", "n"])


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _scorer(shared, trust: np.ndarray, total: int, distinct: int, bins: int):
    def run(sliced: pa.Table, values: pa.Table) -> pa.Table:
        one = opened({c: sliced.column(c)[0] for c in ("words", "n_words", "ids", "ends")})
        got = received(values, one.words, None, bins, _VALUE)
        counts = got["c"]
        mixer, begun = shared.value
        share = counts / np.maximum(begun[head_codes(one.words)], 1)
        base = np.add.reduceat(np.log10((counts + 1) / (total + distinct + 1))[one.ids], one.starts)
        known = np.add.reduceat((counts > 0)[one.ids].astype(np.int64), one.starts)
        rows, of = one.heads()
        score = refined(one, mixer.scores(rows)[of], got["tail"].astype(float)[one.ids], share[one.ids], trust)
        spelled = np.add.reduceat((np.fromiter(map(len, one.words), np.int64, len(one.words)) + 1)[one.ids], one.starts)
        return table(RESULT, [sliced.column("doc_ids")[0].values, sliced.column("marks")[0].values, one.sizes, known, np.full(len(known), total, np.int64), base,
                              score / np.log(10), -score / np.log(2) / spelled])
    return run


def scores(docs: DataFrame) -> DataFrame:
    """Per row: token counts, the unigram score and the model's score in log10, and the model's bits per byte as spelled."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held(F.col("doc_id")).alias("mark"), F.lit(None).cast("string").alias("part"),
                       F.col("text").cast("string").alias("text"))
    sliced = encoded(rows, split)
    bins = bin_count(sliced)
    words = merged(sliced, bins)
    trained = words.select("words", "n_words", "counts")
    spelled, total, distinct = totals(trained)
    tree = code_tree(spelled)
    begun = np.zeros(1 << 16)  # one number for each possible head
    for head, n in trained.mapInArrow(_head_totals, "head long, n double").groupBy("head").agg(F.sum("n")).collect():
        begun[head] = n
    counted = stage(sliced.select("words", "n_words", "ids", "ends", "marks").mapInArrow(_heads, "row binary, c long").groupBy(
        "row", (F.col("c") < 0).alias("guesses")).agg(F.sum("c").alias("c"), F.count("*").alias("n")), "heads")
    guesses = {int(bytes(r["row"])): -r["c"] - r["n"] for r in counted.where("guesses").collect()}
    made, right = (np.array([guesses.get(k + REPEATS * side, 0) for k in range(REPEATS)], float) for side in (0, 1))
    rows = counted.where("not guesses").select("row", "c").repartition("row").sortWithinPartitions(F.xxhash64("row"), "row")
    heads = spark.sparkContext.broadcast((fit(rows, HEAD, tree, _counted), begun))
    tails = spark.sparkContext.broadcast(fit(trained, 0, tree, _words))
    values = words.mapInArrow(_tails(tails), VALUES)
    return sliced.select("slice", "doc_ids", "marks", "ends", "words", "n_words", "ids").groupBy("slice").cogroup(values.groupBy("of_slice")).applyInArrow(
        _scorer(heads, (right + 0.5) / (made + 1.5), total, distinct, bins), RESULT)
