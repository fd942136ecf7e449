"""Operator 13: phrase collocations by stripes: each prefix keys an associative counter of what comes next.

Phrases grow word by word. Level n knows at which places of a slice a frequent phrase of n words begins. Where two such phrases begin one
word apart they make a phrase of n + 1 words, kept in the stripe of the first (its prefix) under the second (its suffix, which names the next
word). Stripes of all slices are merged elementwise; a merged stripe gives the extensions of its prefix and, with the stripes' other end, the
largest extension of either side, all that the subsumption rule asks for: a phrase is at least as frequent as any that contains it, so the
most frequent container is one word longer. What is frequent goes back to the slices that hold it, and only there.

A phrase can only be frequent if both of its shorter ends are, so nothing is dropped that could count. Stripes of prefixes that occur often
are cut into pieces by suffix, so that no piece has more than about ``PIECE`` occurrences; pieces are dealt to as many groups as the corpus
has ``GROUP`` words.

Defined cases: null and empty texts have no words; null languages are ``und``; repeated rows count each; words hold any character but
blanks and piece ends; empty tables and corpora without a frequent phrase give no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linklens.llm.word_slices import VALUES, bin_count, bin_rows, encoded, merged, opened_ids, opened_short, received, sent_back, short, table, unpacked
from linklens.session import stage

LEAST, LONGEST, PART, FIRST, FACTOR = 30, 4, 80, 2000, 2_000_000
PIECE, GROUP = 1_000_000, 1_000_000
SALTS = 64

# Piece ends become line feeds, tabs blanks, A-Z lower case.
_ENDS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_FIXED = {b"\n": -1, b"": -2}


def split(text: bytes) -> list[bytes]:
    """Words, line feeds between pieces and after the text, and empty texts that count for nothing."""
    tokens = text.translate(_ENDS).replace(b"\n", b" \n ").split(b" ")
    tokens.append(b"\n")
    return tokens


# -- slices: places and ids of frequent phrases ---------------------------------------------------------------------------------------

PLACED = "slice long, n long, gaps binary, local binary, known binary, pieces binary"
STRIPES = "slice long, bin int, prefixes binary, sizes binary, suffixes binary, counts binary, n_prefixes long, n long"
MERGED = "slice long, bin int, id long, prefix long, suffix long, f long, back binary"


def _pieces(f: np.ndarray, piece: int) -> np.ndarray:
    return np.minimum(-(-f // piece), 1 << 30).astype("<i4")


_VALUE = np.dtype([("id", "<i8"), ("pieces", "<i4")])
WORDS = "id long, part string, word binary, f long"


def _ids(bin_number: int, bins: int, kept: np.ndarray) -> np.ndarray:
    """Ids of what a bin keeps, no bin's like another's and small as long as there are few; -1 for the rest."""
    return np.where(kept, bin_number + np.int64(bins) * (np.cumsum(kept) - 1), -1)


def _narrow(numbers: np.ndarray) -> bytes:
    """Four bytes a number, eight if one needs them."""
    return numbers.astype("<u4" if numbers.max(initial=0) < 1 << 32 else "<i8").tobytes()


def _opened_narrow(value: bytes, number: int) -> np.ndarray:
    return np.frombuffer(value, "<u4" if len(value) == 4 * number else "<i8").astype(np.int64)


def _small(numbers: np.ndarray) -> bytes:
    """One byte a number, four more at the end for those from 255 on."""
    return np.minimum(numbers, 255).astype("u1").tobytes() + numbers[numbers >= 255].astype("<u4").tobytes()


def _opened_small(value: bytes, number: int) -> np.ndarray:
    low = np.frombuffer(value, "u1", number)
    out = low.astype(np.int64)
    out[low == 255] = np.frombuffer(value, "<u4", offset=number)
    return out


def _frequent(least: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, counts in bin_rows(batches):
            ids, of = _ids(row["bin"], bins, counts >= least), np.frombuffer(row["part_of"], "<i4")
            kept = np.flatnonzero(ids >= 0)
            yield from table(WORDS, [ids[kept], [row["parts"][of[i]] for i in kept], [words[i] for i in kept], counts[kept]]).to_batches()
    return run


def _part_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, _, counts in bin_rows(batches):
        sums = np.bincount(np.frombuffer(row["part_of"], "<i4"), counts, len(row["parts"])).astype(np.int64)
        yield from table("part string, n long", [row["parts"], sums]).to_batches()


def _numbers(least: int, piece: int, bins: int):
    """To every slice: the ids of its frequent words, and in how many pieces their stripes are cut."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, words, counts in bin_rows(batches):
            values = np.empty(len(words), _VALUE)
            values["id"], values["pieces"] = _ids(row["bin"], bins, counts >= least), _pieces(counts, piece)
            yield sent_back(row, values)
    return run


def _frequent_words(bins: int):
    """The first level of a slice from its token ids and the ids of its words."""
    def run(sliced: pa.Table, values: pa.Table) -> pa.Table:
        if not sliced.num_rows or not values.num_rows:
            return table(PLACED, [[]] * 6)
        row = {c: sliced.column(c)[0].as_py() for c in sliced.column_names}
        got = received(values, unpacked(row["words"], row["n_words"]), row["part"], bins, _VALUE)
        ids = opened_ids(row["ids"], row["ends"][-1])
        number = np.append(got["id"], -1)[ids]  # fixed tokens fall on the last
        at = np.flatnonzero(number >= 0)
        known = np.flatnonzero(got["id"] >= 0)  # the most frequent words of the slice come first
        rank = np.zeros(len(got), np.int64)
        rank[known] = np.arange(len(known))
        return _placed(row["slice"], at, rank[ids[at]], got["id"][known], got["pieces"][known])
    return run


def _placed(number: int, at: np.ndarray, local: np.ndarray, known: np.ndarray, pieces: np.ndarray) -> pa.Table:
    """A slice's frequent phrases: where they begin, as gaps, and which they are, as numbers into ``known`` ids and their pieces."""
    return table(PLACED, [[number], [len(at)], [short(np.diff(at, prepend=0))], [short(local)], [known.astype("<i8").tobytes()], [pieces.astype("<i4").tobytes()]])


def _mixed(value: np.ndarray) -> np.ndarray:
    value = value.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return value ^ value >> np.uint64(31)


class _Pairs:
    """Pairs of phrases that begin one word apart in a slice, each once, in order of their bin."""

    def __init__(self, row: dict, bins: int):
        self.at, local = np.cumsum(opened_short(row["gaps"], row["n"])), opened_short(row["local"], row["n"])
        self.first = np.flatnonzero(self.at[1:] == self.at[:-1] + 1)
        known, pieces = np.frombuffer(row["known"], "<i8"), np.frombuffer(row["pieces"], "<i4")
        self.mine = local[self.first] * np.int64(len(known)) + local[self.first + 1]
        every = np.sort(self.mine)
        begin = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, np.int64)
        self.counts, self.keys = np.diff(np.append(begin, len(every))), every[begin]
        left, right = self.keys // max(1, len(known)), self.keys % max(1, len(known))
        piece = (_mixed(known[right]) % pieces[left].astype(np.uint64)).astype(np.int64)
        bin_of = (_mixed(known[left] + piece * np.int64(0x632BE5AB)) % np.uint64(bins)).astype(np.int64)
        self.order = np.argsort(bin_of, kind="stable")
        self.ends = np.cumsum(np.bincount(bin_of, minlength=bins))
        self.prefix, self.suffix = known[left], known[right]

    def of_bin(self, b: int) -> np.ndarray:
        return self.order[self.ends[b - 1] if b else 0:self.ends[b]]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _stripes(bins: int):
    """Per slice and bin: prefixes in order, the size of each stripe, and its suffixes and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            pairs, columns = _Pairs(row, bins), []
            for b in np.flatnonzero(np.diff(pairs.ends, prepend=0)).tolist():
                own = pairs.of_bin(b)
                prefix = pairs.prefix[own]
                new = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
                columns.append((row["slice"], b, _narrow(prefix[new]), _small(np.diff(np.append(new, len(own)))), _narrow(pairs.suffix[own]), _small(pairs.counts[own]),
                                len(new), len(own)))
            if columns:
                yield table(STRIPES, list(zip(*columns))).to_batches()[0]
    return run


def _merger(least: int, bins: int, back: bool):
    """Merges the stripes of one bin elementwise: its frequent phrases with new ids and, per slice, the ids and frequencies of the pairs it sent."""
    def run(stripes: pa.Table) -> pa.Table:
        rows, number = stripes.to_pylist(), stripes.column("bin")[0].as_py()
        prefix = np.concatenate([np.repeat(_opened_narrow(r["prefixes"], r["n_prefixes"]), _opened_small(r["sizes"], r["n_prefixes"])) for r in rows])
        suffix = np.concatenate([_opened_narrow(r["suffixes"], r["n"]) for r in rows])
        count = np.concatenate([_opened_small(r["counts"], r["n"]) for r in rows])
        if max(prefix.max(), suffix.max()) < 1 << 31:
            keys, of = np.unique(prefix << 32 | suffix, return_inverse=True)
            prefix, suffix = keys >> 32, keys & 0xFFFFFFFF
        else:
            starts, left = np.unique(prefix, return_inverse=True)
            ends, right = np.unique(suffix, return_inverse=True)
            keys, of = np.unique(left * np.int64(len(ends)) + right, return_inverse=True)
            prefix, suffix = starts[keys // len(ends)], ends[keys % len(ends)]
        total = np.bincount(of, count, len(keys)).astype(np.int64)  # exact below 2^53
        ids = _ids(number, bins, total >= least)
        kept = np.flatnonzero(ids >= 0)
        none = [None] * len(kept)
        out = [table(MERGED, [none, none, ids[kept], prefix[kept], suffix[kept], total[kept], none])]
        if back and len(kept):
            ends = np.cumsum([r["n"] for r in rows])
            sent = [of[e - r["n"]:e] for e, r in zip(ends, rows)]
            hit = [i for i, own in enumerate(sent) if (ids[own] >= 0).any()]
            none = [None] * len(hit)
            out.append(table(MERGED, [[rows[i]["slice"] for i in hit], [number] * len(hit), none, none, none, none,
                                      [_back(ids[sent[i]], total[sent[i]]) for i in hit]]))
        return pa.concat_tables(out)
    return run


def _back(ids: np.ndarray, total: np.ndarray) -> bytes:
    packed = _narrow(ids + 1)
    return bytes([len(packed) // len(ids)]) + packed + _narrow(total[ids >= 0])


def _opened_back(value: bytes, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (-1: not frequent) of a slice's pairs in one bin, and the frequencies of the frequent ones; the first byte has the ids' width."""
    end = 1 + value[0] * number
    ids = _opened_narrow(value[1:end], number) - 1
    return ids, _opened_narrow(value[end:], int((ids >= 0).sum()))


def _longer(piece: int, bins: int):
    """The next level of a slice from what came back to it."""
    def run(placed: pa.Table, back: pa.Table) -> pa.Table:
        if not placed.num_rows or not back.num_rows:
            return table(PLACED, [[]] * 6)
        row = placed.to_pylist()[0]
        pairs = _Pairs(row, bins)
        ids, f = np.full(len(pairs.keys), -1, np.int64), np.zeros(len(pairs.keys), np.int64)
        for b, value in zip(back.column("bin").to_pylist(), back.column("back").to_pylist()):
            own = pairs.of_bin(b)
            ids[own], frequent = _opened_back(value, len(own))
            f[own[ids[own] >= 0]] = frequent
        kept = np.flatnonzero(ids >= 0)
        rank = np.full(len(ids), -1, np.int64)
        rank[kept] = np.arange(len(kept))
        local = rank[np.searchsorted(pairs.keys, pairs.mine)]
        hit = np.flatnonzero(local >= 0)
        return _placed(row["slice"], pairs.at[pairs.first[hit]], local[hit], ids[kept], _pieces(f[kept], piece))
    return run


# -- levels ----------------------------------------------------------------------------------------------------------------------------

def level(placed: DataFrame, bins: int, least: int, last: bool) -> DataFrame:
    """Staged phrases of one more word (``slice`` null), and what goes back to each slice."""
    stripes = placed.mapInArrow(_stripes(bins), STRIPES)
    return stage(stripes.groupBy("bin").applyInArrow(_merger(least, bins, not last), MERGED), "stripes")


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, piece: int = PIECE) -> tuple[DataFrame, list[DataFrame]]:
    """Word occurrences per ``part``, and per length from 1 the frequent phrases: ``id, part, phrase, last, a, lefts, rights, prefix, suffix``.

    ``lefts`` and ``rights`` have the frequencies of the phrase's beginnings and ends by their length; the phrase itself is the last.
    """
    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("mark"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("part"),
                       F.col("text").cast("string").alias("text"))
    sliced = encoded(rows, split, _FIXED)
    word_bins = bin_count(sliced)
    words = merged(sliced, word_bins)
    totals = stage(words.mapInArrow(_part_totals, "part string, n long").groupBy("part").agg(F.sum("n").alias("n")).where("n > 0"), "totals")
    whole = totals.agg(F.sum("n")).first()[0] or 0
    frequent = stage(words.mapInArrow(_frequent(least, word_bins), WORDS), "frequent")
    text = F.col("word").cast("string")
    grams = [frequent.select("id", "part", text.alias("phrase"), text.alias("last"), F.col("f").alias("a"), F.array("f").alias("lefts"), F.array("f").alias("rights"),
                             F.lit(None).cast("long").alias("prefix"), F.lit(None).cast("long").alias("suffix"))]
    values = words.mapInArrow(_numbers(least, piece, word_bins), VALUES)
    placed = stage(sliced.select("slice", "part", "words", "n_words", "ids", "ends").groupBy("slice").cogroup(values.groupBy("of_slice")).applyInArrow(
        _frequent_words(word_bins), PLACED), "places")
    bins = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), whole // GROUP + 1)
    for n in range(2, longest + 1):
        found = level(placed, bins, least, n == longest)
        p, s = (grams[-1].select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "part", "phrase", "last", "lefts", "rights")]) for side in ("p", "s"))
        grown = found.where("slice is null").select("id", "prefix", "suffix", "f").join(p, F.col("prefix") == F.col("p_id")).join(s, F.col("suffix") == F.col("s_id"))
        grams.append(stage(grown.select("id", F.col("p_part").alias("part"), F.concat_ws(" ", "p_phrase", "s_last").alias("phrase"), F.col("s_last").alias("last"),
                                        F.col("f").alias("a"), F.concat("p_lefts", F.array("f")).alias("lefts"), F.concat("s_rights", F.array("f")).alias("rights"),
                                        "prefix", "suffix"), "phrases"))
        if n < longest:
            back = found.where("slice is not null").select(F.col("slice").alias("of_slice"), "bin", "back")
            placed = stage(placed.groupBy("slice").cogroup(back.groupBy("of_slice")).applyInArrow(_longer(piece, bins), PLACED), "places")
    return totals, grams


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, part: int = PART, first: int = FIRST, factor: int = FACTOR,
                 piece: int = PIECE) -> DataFrame:
    """Per language the ``first`` phrases by their weakest cut, without those that a longer candidate explains."""
    totals, grams = phrases(docs, longest, least, piece)
    kept = None
    for n in range(2, longest + 1):
        rows = grams[n - 1]
        if n < longest:
            longer = grams[n]
            most = longer.select(F.col("prefix").alias("inner"), "a").unionByName(longer.select(F.col("suffix").alias("inner"), "a")).groupBy("inner").agg(F.max("a").alias("most"))
            rows = rows.join(most, F.col("id") == F.col("inner"), "left").where(f"most is null or 100 * most < {part} * a")
        # exact: the product is a decimal of 38 digits
        cuts = [F.struct(F.expr(f"cast({factor}BD as decimal(18,0)) * cast(a as decimal(20,0)) div (lefts[{k - 1}] + rights[{n - k - 1}])").alias("score"), F.lit(k).alias("k"),
                         F.col("lefts")[k - 1].alias("l"), F.col("rights")[n - k - 1].alias("r")) for k in range(1, n)]
        rows = rows.select(F.col("part").alias("lang"), "phrase", "a", F.array_min(F.array(*cuts)).alias("cut"), F.pmod("id", F.lit(SALTS)).alias("salt"))
        kept = rows if kept is None else kept.unionByName(rows)
    best = (F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    some = kept.withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*best))).where(F.col("place") <= first)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= first)  # of at most SALTS * first rows
    return ranked.join(totals.withColumnRenamed("part", "lang"), "lang").select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
