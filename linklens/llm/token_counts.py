"""Operator 7: token counts by compiled finite-state transducers.

Two deterministic machines replace the byte-level tokenizer:

* ``SPLIT`` reads character classes and marks where words begin (the tokenizer's splitting pattern). Texts are laid end to end and
  cut into chunks; every chunk's map from entry state to exit state is computed for all states at once, the maps are composed by a
  parallel prefix scan, and each chunk then runs from its true entry state.
* ``Transducer`` reads the bytes of a word; each transition is annotated with the number of tokens it adds to the encoding of the prefix
  (it may be negative: a longer token can replace several). A state is the set of tokens that may still be under way: for each
  start the last token before it, the place in the vocabulary's trie and the count so far. A token may follow another exactly if the
  merges keep the pair apart, so one encoding of each prefix survives. States and transitions are compiled when first reached, up
  to ``MOST_STATES``; then the table is begun anew.

Special strings in a text count as one token each, as the library's default has it.

Defined cases: null and empty texts have 0 bytes and 0 tokens; null ids and repeated rows stay; other columns are not read; an empty table
gives no row. ``over_limit`` is n_tokens > limit.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.llm.words import WordCache, file_bytes, raw_texts, slices

MOST_STATES = 200_000
# Characters of a chunk of the splitting machine.
CHUNK = 128


# --- the splitting machine ---------------------------------------------------

# Character classes; SINGLE are s, t, m, d, which end a contraction at once.
LETTER, NUMBER, OTHER, SPACE, BLANK, QUOTE, SINGLE, R, V, LL, E_, END = range(12)
# States: what the last character was part of. PR, PV, PL: a quote and the first letter of a two-letter ending; DONE: a contraction.
S_START, S_LETTER, S_NUMBER, S_OTHER, S_QUOTE, S_PR, S_PV, S_PL, S_DONE, S_BLANK, S_SPACE, S_BLANKS, S_SPACES = range(13)
HERE, BACK = 1, 2  # a word begins at this character; at the one before


def _step(state: int, char: int) -> tuple[int, int]:
    """Next state and where words begin."""
    letters = (LETTER, SINGLE, R, V, LL, E_)
    if state in (S_PR, S_PV, S_PL):
        if (state in (S_PR, S_PV) and char == E_) or (state == S_PL and char == LL):
            return S_DONE, 0
        after, marks = _step(S_LETTER, char)  # no contraction: the letter before began a word
        return after, marks | BACK
    if char == END:
        return S_START, HERE
    if char in (SPACE, BLANK):
        if state in (S_BLANK, S_SPACE, S_BLANKS, S_SPACES):
            return (S_BLANKS if char == BLANK else S_SPACES), 0
        return (S_BLANK if char == BLANK else S_SPACE), HERE
    marks = HERE
    if state == S_BLANK:  # a single blank belongs to the word that follows
        marks = 0
    elif state == S_BLANKS:  # the last blank of a run does
        marks = BACK
    elif state == S_SPACES:  # the last space of a run stands alone
        marks = BACK | HERE
    if char in letters:
        if state == S_QUOTE:
            if char == SINGLE:
                return S_DONE, 0
            if char in (R, V, LL):
                return {R: S_PR, V: S_PV, LL: S_PL}[char], 0
        return S_LETTER, 0 if state == S_LETTER else marks
    if char == NUMBER:
        return S_NUMBER, 0 if state == S_NUMBER else marks
    if state in (S_OTHER, S_QUOTE):
        return S_OTHER, 0
    return (S_QUOTE if char == QUOTE and marks & HERE else S_OTHER), marks


STATES, CLASSES = 13, 12
_TABLE = [[_step(s, c) for c in range(CLASSES)] for s in range(STATES)]
NEXT = np.array([[t[0] for t in row] for row in _TABLE], np.uint8).ravel()
MARKS = np.array([[t[1] for t in row] for row in _TABLE], np.uint8).ravel()


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point."""
    import regex
    points = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, value in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for match in regex.finditer(pattern, points):
            table[match.start():match.end()] = value
    for chars, value in ((" ", BLANK), ("'", QUOTE), ("stmd", SINGLE), ("r", R), ("v", V), ("l", LL), ("e", E_)):
        for ch in chars:
            table[ord(ch)] = value
    return table


def entry_states(columns: np.ndarray) -> np.ndarray:
    """Entry state of each chunk; ``columns`` has one row per position and one column per chunk."""
    chunks = columns.shape[1]
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[None], chunks, 0)  # chunk, entry state -> state so far
    for i, row in enumerate(columns):
        if i >= 8 and (maps == maps[:, :1]).all():  # every entry state has led to one state: the rest of a map is one run
            state = maps[:, 0]
            for later in columns[i:]:
                state = NEXT[state.astype(np.intp) * CLASSES + later]
            maps = np.repeat(state[:, None], STATES, 1)
            break
        maps = NEXT[maps.astype(np.intp) * CLASSES + row[:, None]]
    step = 1
    while step < chunks:  # prefix scan: each round composes maps of twice as many chunks
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1) if step < chunks else maps[step:]
        step *= 2
    return np.r_[np.uint8(S_START), maps[:-1, S_START]] if chunks else np.zeros(0, np.uint8)


def word_starts(text: str) -> np.ndarray:
    """Positions at which words begin in texts laid end to end, each followed by the character U+10FFFF."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = class_table()[points]
    classes[points == 0x10FFFF] = END
    chunks = -(-len(classes) // CHUNK)
    padded = np.full(chunks * CHUNK, END, np.uint8)
    padded[:len(classes)] = classes
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    state = entry_states(columns)
    marks = np.empty_like(columns)
    for i, row in enumerate(columns):
        at = state.astype(np.intp) * CLASSES + row
        marks[i], state = MARKS[at], NEXT[at]
    flat = marks.T.ravel()[:len(classes)]
    begins = (flat & HERE).astype(bool)
    begins[:-1] |= (flat[1:] & BACK).astype(bool)
    return np.flatnonzero(begins)


# --- the counting transducer --------------------------------------------------

def byte_names() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, spec: str):
        names = byte_names()
        model = json.loads(spec)["model"]
        text = lambda s: bytes(names[c] for c in s)
        tokens = {t: i for s, i in model["vocab"].items() if all(c in names for c in s) for t in [text(s)]}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(tokens[text(a)], tokens[text(b)]): (i, tokens[text(a + b)]) for i, (a, b) in enumerate(pairs)}
        self.single = [tokens[bytes([b])] for b in range(256)]
        self.bytes = {i: t for t, i in tokens.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.final: list[int] = [-1]
        for token, i in tokens.items():
            if len(token) > 1 and self.encode(token) != [i]:
                continue  # no text leads to it
            node = 0
            for byte in token:
                if byte not in self.trie[node]:
                    self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.final.append(-1)
                node = self.trie[node][byte]
            self.final[node] = i
        self.follows: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((-1, 0, 0),)
        self.numbers, self.states, self.moves = {start: 0}, [start], [{}]

    def encode(self, word: bytes) -> list[int]:
        """The merges themselves, used when a transition is compiled."""
        parts = [self.single[b] for b in word]
        while len(parts) > 1:
            best = min(((self.rank.get(p, (1 << 60, 0))[0], i) for i, p in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 60:
                break
            a, b = parts[best[1]], parts[best[1] + 1]
            merged, out, i = self.rank[a, b][1], [], 0
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(merged)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _may_follow(self, before: int, token: int) -> bool:
        if before < 0:
            return True
        known = self.follows.get((before, token))
        if known is None:
            known = self.encode(self.bytes[before] + self.bytes[token]) == [before, token]
            if len(self.follows) > 5 * MOST_STATES:
                self.follows.clear()
            self.follows[before, token] = known
        return known

    def _compile(self, number: int, byte: int) -> tuple[int, int]:
        """The transition of a state on a byte: next state and tokens added."""
        moved = [(last, node, count) for last, at, count in self.states[number] if (node := self.trie[at].get(byte)) is not None]
        last, added = next((token, count + 1) for before, node, count in moved
                           if (token := self.final[node]) >= 0 and self._may_follow(before, token))
        state = (*((b, n, c - added) for b, n, c in moved if self.trie[n]), (last, 0, 0))
        target = self.numbers.get(state)
        if target is None:
            target = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        self.moves[number][byte] = (target, added)
        return target, added

    def count(self, word: bytes) -> int:
        if len(self.states) > MOST_STATES:
            self.reset()
        moves, state, total = self.moves, 0, 0
        for byte in word:
            move = moves[state].get(byte) or self._compile(state, byte)
            state = move[0]
            total += move[1]
        return total


class Counter:
    """Token counts of texts by one tokenizer file."""

    def __init__(self, spec: str):
        parsed = json.loads(spec)
        split = parsed.get("pre_tokenizer") or {}
        if parsed.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("a byte-level tokenizer with the standard splitting pattern is needed")
        special = sorted((t["content"] for t in parsed["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        machine = Transducer(spec)
        self.words = WordCache(lambda words: (machine.count(w.encode("utf-8", "surrogatepass")) for w in words))

    def counts(self, texts: list[str]) -> list[int]:
        totals, owner, parts = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            pieces = [text]
            if self.special and "<" in text or self.special and self.special.search(text):
                pieces = self.special.split(text)
                totals[i] = len(pieces) - 1
            for piece in pieces:
                if "\U0010ffff" in piece:  # the mark between texts; as a character it is a word of other signs
                    totals[i] += self._alone(piece)
                elif piece:
                    owner.append(i)
                    parts.append(piece)
        if parts:
            joined = "\U0010ffff".join(parts) + "\U0010ffff"
            starts = word_starts(joined).tolist()
            words = [joined[a:b] for a, b in zip(starts, [*starts[1:], len(joined)])]
            get = self.words.lookup(words)
            at = 0
            values = [0 if w == "\U0010ffff" else get(w) for w in words]
            sums, part = np.add.reduceat(np.array(values, np.int64), np.flatnonzero(np.array([True, *(w == "\U0010ffff" for w in words[:-1])]))), None
            for at, part in enumerate(owner):
                totals[part] += int(sums[at])
        return totals

    def _alone(self, piece: str) -> int:
        """A text that holds the mark itself: the mark is put in as another sign of its class and its bytes are restored in the words."""
        stand_in = next(chr(c) for c in range(0x100000, 0x10FFFF) if chr(c) not in piece)
        joined = piece.replace("\U0010ffff", stand_in) + "\U0010ffff"
        starts = word_starts(joined).tolist()
        words = [joined[a:b].replace(stand_in, "\U0010ffff") for a, b in zip(starts, starts[1:])]
        get = self.words.lookup(words)
        return sum(map(get, words))


@functools.lru_cache(maxsize=2)
def counter(spec: str) -> Counter:
    return Counter(spec)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """Per row: bytes and tokens of the text, and whether there are more than ``limit`` tokens."""
    spec = file_bytes(tokenizer).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            texts = raw_texts(batch)
            counts = counter(spec).counts([t.decode() for t in texts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(list(map(len, texts)), pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
