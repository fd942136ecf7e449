"""Operator 12: importance resampling towards a target, with word n-gram features found by an Aho-Corasick dictionary.

Texts are normalised to words between spaces. The dictionary holds words with a space on either side; one scan of its automaton emits, for
each occurrence, the word's checksum and length. The checksum of a run of words follows from those of its words (appending a text multiplies
the checksum's polynomial by a power that depends on the length alone), so runs are never spelled out. A run's checksum gives its bucket; bucket
counts of documents and target give each bucket's gain, and a document's weight is the mean gain of its features. Adding
Gumbel noise that depends on the id alone turns the highest scores into a draw without replacement.

The dictionary grows in each task from the words that its scans left over, up to ``WORDS`` of them; words that it doesn't hold lie in the gaps
between matches and get their checksum there. Results don't depend on what it holds.

Defined cases: null and empty texts have no feature and weight 0; a null id draws its noise as the text ``2024:null`` and comes before other
ids; rows of equal id and score are ranked in any order; empty tables give no row, an empty target the gain of no count; other columns
are not read. Ranks come from counts per score, so no task orders all rows; documents that can't be drawn are not ordered at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linklens.llm.words import raw_texts, slices
from linklens.session import stage

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
WORDS = 100_000
SCAN_BYTES = 1 << 20
STRIP = 256  # scores counted together

# Words are runs of digits, lower-case letters and everything beyond ASCII.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def _shift(length: int) -> np.ndarray:
    """What ``length`` more bytes do to each bit of a checksum."""
    zeros = bytes(length)
    none = zlib.crc32(zeros, 0)
    return np.array([zlib.crc32(zeros, 1 << k) ^ none for k in range(32)], np.uint32)


def joined(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of texts from those of their two parts and the length of the second."""
    out = right.astype(np.uint32)
    lengths, of = np.unique(length, return_inverse=True)
    shifts = np.array([_shift(int(n)) for n in lengths], np.uint32).reshape(-1, 32)
    for bit in range(32):
        out ^= np.where(left >> np.uint32(bit) & np.uint32(1), shifts[of, bit], np.uint32(0))
    return out


class Dictionary:
    """An automaton of delimiter-bounded words whose payloads are checksum and length."""

    def __init__(self, most: int = WORDS):
        self.most, self.automaton = most, None
        self.words: set[bytes] = set()
        self.fresh: dict[bytes, int] = {}
        self.crc = self.length = np.zeros(0, np.uint32)

    def grow(self) -> None:
        """Takes in what was left over at least twice, once that is as much as it holds."""
        import ahocorasick
        if len(self.words) >= self.most or len(self.fresh) < max(64, len(self.words)):
            return
        often = sorted((w for w, n in self.fresh.items() if n > 1), key=lambda w: (-self.fresh[w], w))[:self.most - len(self.words)]
        self.fresh = {}
        if not often:
            return
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, word in enumerate(often, len(self.words)):
            self.automaton.add_word(f" {word.decode('latin-1')} ", number)
        self.automaton.make_automaton()
        self.words.update(often)
        self.crc = np.concatenate([self.crc, np.array([zlib.crc32(w) for w in often], np.uint32)])
        self.length = np.concatenate([self.length, np.array([len(w) for w in often], np.uint32)])

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, checksum and length of every word of ``text``, which begins and ends with a space."""
        if self.automaton is None:
            ends = number = np.zeros(0, np.int64)
        else:
            found = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64).reshape(-1, 2)
            ends, number = found[:, 0], found[:, 1]
        start = ends - self.length[number]
        filled = np.concatenate([[0], np.cumsum(np.frombuffer(text, np.uint8) != 32)])
        low, high = np.concatenate([[0], ends]), np.concatenate([start, [len(text)]])
        gaps = np.flatnonzero(filled[low] != filled[high])
        left = [m for a, b in zip(low[gaps].tolist(), high[gaps].tolist()) for m in _WORD.finditer(text, a, b)]
        if not left:
            return start, self.crc[number], self.length[number]
        words = [m.group() for m in left]
        if len(self.words) < self.most:
            for word in words:
                self.fresh[word] = self.fresh.get(word, 0) + 1
            if len(self.fresh) > 4 * self.most:
                self.fresh = {w: n for w, n in self.fresh.items() if n > 1}
        start = np.concatenate([start, [m.start() for m in left]])
        order = np.argsort(start, kind="stable")
        return (start[order], np.concatenate([self.crc[number], np.array([zlib.crc32(w) for w in words], np.uint32)])[order],
                np.concatenate([self.length[number], np.array([len(w) for w in words], np.uint32)])[order])


def features(dictionary: Dictionary, texts: list[bytes], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words per text, checksums of all runs of 1 to ``longest`` words, and the text of each."""
    plain = [t.translate(_PLAIN) for t in texts]
    sizes = np.fromiter(map(len, plain), np.int64, len(plain)) + 1
    start, crc, length = dictionary.scan(b" " + b" ".join(plain) + b" ")
    dictionary.grow()
    text = np.searchsorted(np.cumsum(sizes), start - 1, side="right")
    runs, of, run = [crc], [text], crc
    spaced = joined(np.full(len(crc), zlib.crc32(b" "), np.uint32), crc, length) if longest > 1 else crc
    for width in range(2, longest + 1):
        inside = text[width - 1:] == text[:len(text) - width + 1]
        run = joined(run[:len(inside)], spaced[width - 1:], length[width - 1:] + 1) if len(inside) else run[:0]
        runs.append(run[inside])
        of.append(text[width - 1:][inside])
    return np.bincount(text, minlength=len(texts)), np.concatenate(runs), np.concatenate(of)


def _bucketed(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = Dictionary()
        for batch in slices(batches, most=SCAN_BYTES):
            words, crc, of = features(dictionary, raw_texts(batch), longest)
            order = np.argsort(of, kind="stable")
            sizes = np.bincount(of, minlength=batch.num_rows)
            found = (crc % np.uint32(buckets)).astype("<u4" if buckets > 1 << 16 else "<u2")[order].tobytes()
            ends = np.concatenate([[0], np.cumsum(sizes)]) * (4 if buckets > 1 << 16 else 2)
            lists = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(found)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words), pa.array(sizes), lists], ["doc_id", "n_words", "n_features", "found"])
    return run


def bucketed(rows: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``doc_id, n_words, n_features, found`` of rows with ``doc_id`` and ``text``: the buckets of all features, two bytes each (four beyond 65,536)."""
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _bucketed(buckets, longest), "doc_id long, n_words long, n_features long, found binary")


def _opened(column: pa.Array, buckets: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4" if buckets > 1 << 16 else "<u2")


def bucket_counts(found: DataFrame, buckets: int, name: str) -> DataFrame:
    """``bucket`` and its number of features, summed in each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_opened(batch.column("found"), buckets), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])
    return found.select("found").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from the bucketed rows of both sides: ``buckets`` numbers."""
    spark = docs.sparkSession
    counts = (spark.range(buckets).withColumnRenamed("id", "bucket").join(bucket_counts(docs, buckets, "s"), "bucket", "left")
              .join(bucket_counts(target, buckets, "t"), "bucket", "left").na.fill(0, ["s", "t"]))
    total = F.struct(F.sum("s").over(W.partitionBy()).alias("s"), F.sum("t").over(W.partitionBy()).alias("t"))
    whole = lambda c: c.cast("double")
    gain = F.floor(1000 * F.log(whole(F.col("t") + 1) * whole(F.col("all.s") + buckets) / (whole(F.col("s") + 1) * whole(F.col("all.t") + buckets))))
    out = np.zeros(buckets, np.int64)
    for bucket, value in counts.withColumn("all", total).select("bucket", gain.alias("gain")).collect():
        out[bucket] = value
    return out


def _weighed(shared, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_features").to_numpy()
            sums = np.concatenate([[0], np.cumsum(shared.value[_opened(batch.column("found"), buckets)])])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array((sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1))],
                ["doc_id", "n_words", "n_features", "weight"])
    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def _ranked(rows: DataFrame, wanted: int) -> DataFrame:
    """``rank`` (1 to ``wanted``, else null) in order of score and id; rows that reach no rank are not ordered."""
    counts = rows.groupBy("score").agg(F.count("*").alias("n")).withColumn("strip", F.floor(F.col("score") / STRIP))
    strips = counts.groupBy("strip").agg(F.sum("n").alias("n"))
    above = W.orderBy(F.desc("strip")).rowsBetween(W.unboundedPreceding, -1)  # a score is a logarithm: some hundred strips
    strips = strips.select("strip", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("higher"))
    inside = W.partitionBy("strip").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)  # at most STRIP rows
    starts = counts.withColumn("higher_here", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(strips, "strip").select(
        "score", (F.col("higher") + F.col("higher_here")).alias("before")).where(F.col("before") < wanted)
    drawn = rows.join(starts, "score")
    place = F.col("before") + F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "n_features"))
    drawn = drawn.withColumn("place", place).withColumn("rank", F.when(F.col("place") <= wanted, F.col("place")))
    return drawn.drop("before", "place").unionByName(rows.join(starts, "score", "left_anti").withColumn("rank", F.lit(None).cast("long")))


def draw(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, percent: int = PERCENT,
         seed: int = SEED) -> DataFrame:
    """Every row's features, weight and score, and the rank of those that are drawn: ``percent`` of the rows with ``least_words`` words."""
    found = stage(bucketed(docs, buckets, longest), "features")
    aims = bucketed(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets, longest)
    shared = docs.sparkSession.sparkContext.broadcast(gains(found, aims, buckets))
    weighed = found.mapInArrow(_weighed(shared, buckets), "doc_id long, n_words long, n_features long, weight long")
    scored = stage(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    able = F.col("n_words") >= least_words
    wanted = scored.where(able).count() * percent // 100
    out = _ranked(scored.where(able), wanted).unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def resampled(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; ids are taken to be distinct."""
    drawn = draw(docs, target, **settings).where("rank is not null").select(F.col("doc_id").alias("drawn_id"))
    return docs.join(drawn, docs["doc_id"].eqNullSafe(F.col("drawn_id")), "left_semi")
