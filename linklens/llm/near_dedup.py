"""Operator 5: near-duplicates by MinHash bands, sequential Bayesian verification and an exact check.

1. ``profiles``: the shingle set of each text (64-bit hashes of word runs), its 128-bit fingerprint and its signature. Texts with equal sets are
   one class from here on; a class is a node.
2. Bands of the signatures name buckets. In each bucket every node is compared with the smallest node only (``stars``): their
   number grows with the nodes, not with the square of a bucket.
3. ``verify_signatures`` compares signatures batch by batch. With a uniform prior the similarity after m matches of n is
   Beta(m + 1, n - m + 1); a pair is dropped as soon as the probability that it reaches the threshold is below ``MISS``.
4. Survivors are checked on full sets: first the best partner of each node, then only pairs whose nodes are in different
   components, since a link inside a component changes nothing.
5. Buckets that still hold several components have all their pairs across components compared: small ones by a join of members, larger
   ones block by block inside tasks. There signatures and full sets are compared in place, and a task returns the links that join
   components, fewer than it has nodes. Large buckets that share nodes are compared at once where that is less work than one by one.

Defined cases: letters A-Z are lowered, words are runs of bytes other than ASCII white space; a text with fewer words than a shingle has its
whole sequence as its only shingle; a text without words, or null, has an empty set and no link. Null ids take part, but a component's id is
its smallest id that is not null. Repeated rows are linked with each other. Other columns are not read by ``components_of``
and kept by ``keep_one``. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linklens.llm.graph import components
from linklens.llm.marks import flagged, place
from linklens.llm.words import give_back, lean, raw_texts, slices
from linklens.session import stage

BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
# Hashes compared before each decision.
BATCH = 25
# Probability at which a pair that may reach the threshold is given up.
MISS = 1e-6
# Buckets up to this size are joined, larger ones are compared in blocks of BLOCK nodes.
SMALL, BLOCK = 64, 512
# Shingles of one block: a task holds about two blocks, or two sets where these are larger.
BLOCK_SHINGLES = 1 << 21
# Parts that the rows of one label are dealt to.
SALTS = 32


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``words`` words; a link needs ``whole * intersection >= part * union``."""
    words: int = 5
    part: int = 80
    whole: int = 100

    @property
    def threshold(self) -> float:
        return self.part / self.whole


# --- sets and signatures ------------------------------------------------------

_rng = np.random.default_rng(97)
MULTIPLY = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
STEP = np.uint64(0x9E3779B97F4A7C15)


def nth(i: int) -> np.uint64:
    return np.uint64(int(STEP) * i % (1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    import xxhash
    split = [t.lower().split() for t in texts]
    counts = list(map(len, split))
    words = np.fromiter((h for ws in split for h in map(xxhash.xxh3_64_intdigest, ws)), np.uint64, sum(counts))
    runs = mixed(words) if width == 1 else words
    if len(words) >= width > 1:
        runs = np.zeros(len(words), np.uint64)
        for i in range(width):
            part = words[i:len(words) - width + 1 + i]
            runs[:len(part)] = mixed(runs[:len(part)] + part + nth(i + 1))
    sets, at = [], 0
    for n in counts:
        if n >= width:
            sets.append(np.unique(runs[at:at + n - width + 1]))
        elif n:
            value = np.zeros(1, np.uint64)
            for word in words[at:at + n]:
                value = mixed(value + np.full(1, word) + nth(n + 1000))
            sets.append(value)
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 32-bit minima per set; all sets have members."""
    sizes = np.array(list(map(len, sets)))
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) if len(sets) else np.zeros(0, np.uint32)
    owner_starts = np.r_[0, np.cumsum(sizes)]
    first = 0
    while first < len(sets):  # runs of sets that fit the processor's cache; a larger set is cut
        last = max(first + 1, int(np.searchsorted(owner_starts, owner_starts[first] + 16_384, "right")) - 1)
        begin, end = int(owner_starts[first]), int(owner_starts[last])
        for at in range(begin, end, 65_536):
            x = values[at:min(end, at + 65_536)]
            starts = np.maximum(owner_starts[first:last] - at, 0) if last - first > 1 else np.zeros(1, int)
            for k in range(HASHES):
                found = np.minimum.reduceat(x * MULTIPLY[k] + ADD[k], starts)
                out[first:last, k] = np.minimum(out[first:last, k], found)
        first = last
    return out


def buckets(signature: np.ndarray) -> np.ndarray:
    """A 64-bit bucket name per band."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    name = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * STEP, rows.shape[:2]).copy()
    for i in range(ROWS):
        name = mixed(name + rows[:, :, i] + STEP)
    return name.view(np.int64)


def _profile(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            sets = shingle_sets(raw_texts(batch), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            nodes: list = [None] * len(sets)
            signs: list = [None] * len(sets)
            for i, row in zip(full, signatures([sets[i] for i in full])):
                nodes[i] = hashlib.blake2b(sets[i].astype("<u8").tobytes(), digest_size=16).digest()
                signs[i] = row.astype("<u2").tobytes()  # low 16 bits: different minima agree once in 65,536 times, which only adds candidates
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(list(map(len, sets)), pa.int64()), pa.array(nodes, pa.binary()),
                 pa.array(signs, pa.binary())], ["doc_id", "text_key", "n_shingles", "node", "signature"])
    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "text_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def profiles(docs: DataFrame, like: Likeness) -> DataFrame:
    return _texts(docs).mapInArrow(lean(_profile(like.words)), "doc_id long, text_key long, n_shingles long, node binary, signature binary")


# --- sequential verification --------------------------------------------------

def least_matches(threshold: float, miss: float = MISS) -> list[int]:
    """For each number of compared hashes the fewest matches with P(similarity >= threshold) >= miss under the Beta posterior."""
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def sequential(left: np.ndarray, right: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that pass all decisions, and their matches."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int64)
    for i, need in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (left[alive, part] == right[alive, part]).sum(1)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    return alive, matches


def _signs(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<u2").reshape(-1, HASHES)


def _sequential(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive, matches = sequential(_signs(batch.column("sign_a").to_pylist()), _signs(batch.column("sign_b").to_pylist()), least)
            at = pa.array(alive, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at), pa.array(matches, pa.int64())], ["a", "b", "matches"])
    return run


def verify_signatures(pairs: DataFrame, reps: DataFrame, like: Likeness) -> DataFrame:
    """``a, b, matches`` of the pairs that survive the Bayesian decisions."""
    a = reps.select(F.col("node").alias("a"), F.col("signature").alias("sign_a"))
    b = reps.select(F.col("node").alias("b"), F.col("signature").alias("sign_b"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "sign_a", "sign_b").mapInArrow(
        lean(_sequential(least_matches(like.threshold))), "a binary, b binary, matches long")


# --- exact check --------------------------------------------------------------

def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=2 << 20):
            sets = [s.astype("<u8").tobytes() for s in shingle_sets(raw_texts(batch), width)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "members"])
    return run


def _exact(part: int, whole: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("set_a"), batch.column("set_b")):  # views on the batch, not copies
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (left, right))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(whole * both >= part * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def verify_sets(pairs: DataFrame, docs: DataFrame, reps: DataFrame, like: Likeness) -> DataFrame:
    """``a, b`` of the pairs whose full sets are alike; sets are built only for the nodes at hand."""
    pairs = pairs.select("a", "b")
    sets = node_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), docs, reps, like)
    a = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    b = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(lean(_exact(like.part, like.whole)), "a binary, b binary")


def node_sets(nodes: DataFrame, docs: DataFrame, reps: DataFrame, like: Likeness) -> DataFrame:
    """``node, members``: the shingle sets of ``nodes``, staged. A bitmap of the wanted rows is applied before texts move, which they do once."""
    key = lambda doc_id, text_key: (F.coalesce(doc_id, F.lit(0)).alias("id"), F.col(doc_id).isNull().alias("no_id"), F.col(text_key).alias("key"))
    wanted = stage(reps.join(nodes, "node", "left_semi").select("node", "place.doc_id", "place.text_key").select(
        "node", *key("doc_id", "text_key"), place("doc_id", "text_key")), "wanted")
    texts = flagged(_texts(docs).withColumn("place", place("doc_id", "text_key")), wanted, wanted=F.lit(True)).where("wanted")
    names = ["id", "no_id", "key"]
    # copies of a row collapse before they move; without nulls in the keys the join finds the texts dealt as it needs them
    once = texts.select(*key("doc_id", "text_key"), "text").dropDuplicates(names)
    return stage(once.join(wanted.drop("place"), names).select("node", "text").mapInArrow(lean(_sets(like.words)), "node binary, members binary"), "shingle-sets")


# --- candidates ----------------------------------------------------------------

def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = buckets(_signs(batch.column("signature").to_pylist())) if batch.num_rows else np.zeros((0, BANDS), np.int64)
        owner = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
        kept = [c for c in batch.schema.names if c != "signature"]
        yield pa.RecordBatch.from_arrays([pa.array(names.ravel()), *(batch.column(c).take(owner) for c in kept)], ["bucket", *kept])


def bucket_members(reps: DataFrame) -> DataFrame:
    """``bucket, node, n_shingles, centre`` of the buckets that hold several nodes, staged; ``centre`` is the smallest node."""
    members = reps.select("node", "signature", "n_shingles").mapInArrow(lean(_members), "bucket long, node binary, n_shingles long")
    # a window deals the members out once; a bucket beyond its buffer is spilled
    bucket = Window.partitionBy("bucket")
    several = members.withColumns({"centre": F.min("node").over(bucket), "other": F.max("node").over(bucket)}).where("centre != other")
    return stage(several.drop("other"), "bucket-members")


def ordered_pair(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def stars(members: DataFrame) -> DataFrame:
    """Pairs of each node with the smallest node of its buckets."""
    return members.where("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()


def overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs ``sets[x], sets[y]``."""
    if len(x) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x, y)], np.int64)
    # many pairs: rows of a membership matrix over the members that several sets share, some columns at a time
    owner = np.repeat(np.arange(len(sets)), list(map(len, sets)))
    _, place, copies = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = copies[place] > 1
    owner, place = owner[shared], np.unique(place[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(place.max()) + 1 if len(place) else 0, 4096):
        part = (place >= first) & (place < first + 4096)
        matrix = np.zeros((len(sets), 4096), np.float32)
        matrix[owner[part], place[part] - first] = 1
        both += matrix @ matrix.T
    return np.rint(both[x, y]).astype(np.int64)


def _block_links(like: Likeness):
    """Links between components among the nodes of two blocks (or inside one): Bayesian decisions, exact check, a spanning forest."""
    least = least_matches(like.threshold)

    def run(table: pa.Table) -> pa.Table:
        node, root = table.column("node").to_pylist(), table.column("root").to_pylist()
        side = np.array(table.column("side").to_pylist())
        sets = [np.frombuffer(v, "<u8") for v in table.column("members").to_pylist()]
        signs, sizes = signatures(sets), np.array(list(map(len, sets)))
        number = {r: i for i, r in enumerate(dict.fromkeys(root))}
        roots = np.array([number[r] for r in root])
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        passed: list[tuple[np.ndarray, np.ndarray]] = []
        for first in range(0, len(left), 64):  # some rows at a time
            x, y = (g.ravel() for g in np.meshgrid(left[first:first + 64], right, indexing="ij"))
            small, large = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
            open_ = (roots[x] != roots[y]) & (like.whole * small >= like.part * large)
            x, y = x[open_], y[open_]
            alive, _ = sequential(signs[x], signs[y], least)
            passed.append((x[alive], y[alive]))
        x, y = (np.concatenate([p[i] for p in passed]) if passed else np.zeros(0, int) for i in (0, 1))
        both = overlaps(sets, x, y)
        linked = like.whole * both >= like.part * (sizes[x] + sizes[y] - both)
        parent, links = list(range(len(number))), []

        def find(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, j in zip(x[linked].tolist(), y[linked].tolist()):
            a, b = find(roots[i]), find(roots[j])
            if a != b:
                parent[a] = b
                links.append((node[i], node[j]))
        return pa.table({"a": pa.array([k[0] for k in links], pa.binary()), "b": pa.array([k[1] for k in links], pa.binary())})
    return run


def open_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``bucket, node, n_shingles, root, size, weight`` of the buckets that hold several components; ``weight`` sums the shingles."""
    placed = (members.join(roots, "node", "left")
              .select("bucket", "node", "n_shingles", F.coalesce("root", "node").alias("root")))
    several = (placed.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"), F.min("root").alias("low"), F.max("root").alias("high"))
               .where("low != high").select("bucket", "size", "weight"))
    return stage(placed.join(several, "bucket"), "open-buckets")


def small_pairs(opened: DataFrame) -> DataFrame:
    """Pairs of different components in buckets of at most ``SMALL`` nodes."""
    small = opened.where(F.col("size") <= SMALL)
    other = small.select("bucket", F.col("node").alias("other"), F.col("root").alias("other_root"))
    return small.join(other, "bucket").where("node < other and root != other_root").select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()


def large_links(large: DataFrame, docs: DataFrame, reps: DataFrame, like: Likeness) -> DataFrame:
    """Links between components in larger buckets.

    Buckets are gathered under a label, the smallest node that a bucket of one of their nodes holds; the buckets of one crowd of copies
    mostly share it. All nodes under a label are compared as one group if the square of their number is at most the sum of the
    squares of its buckets, otherwise each bucket is a group: two nodes of one bucket meet either way. Groups are cut into
    blocks of about ``BLOCK`` nodes, or fewer where their sets hold more than ``BLOCK_SHINGLES`` shingles; every two blocks meet in a task.
    """
    nearest = large.join(large.groupBy("bucket").agg(F.min("node").alias("centre")), "bucket").groupBy("node").agg(F.min("centre").alias("centre"))
    labels = large.join(nearest, "node").groupBy("bucket").agg(F.min("centre").alias("label"))
    labelled = stage(large.join(labels, "bucket").withColumn("salt", F.pmod(F.xxhash64("node", "bucket"), F.lit(SALTS))), "labelled")
    work = labelled.groupBy("label").agg(F.sum(F.col("size").cast("double")).alias("apart"))  # a row of each of its nodes adds the size once
    nodes = (labelled.select("label", "node", "n_shingles").distinct().groupBy("label")
             .agg(F.count("*").alias("nodes"), F.sum("n_shingles").alias("shingles")))
    # a label has more than SMALL nodes, so its SALTS copies are fewer than its rows
    gathered = work.join(nodes, "label").select(
        F.col("label").alias("of"), "nodes", "shingles", (F.col("nodes").cast("double") * F.col("nodes") <= F.col("apart")).alias("at_once"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("part"))
    rows = (labelled.join(gathered, (labelled["label"] == gathered["of"]) & (labelled["salt"] == gathered["part"]))
            .select("node", "root", F.when(F.col("at_once"), F.col("label")).otherwise(F.col("bucket").cast("string").cast("binary")).alias("group"),
                    F.when(F.col("at_once"), F.col("nodes")).otherwise(F.col("size")).alias("size"),
                    F.when(F.col("at_once"), F.col("shingles")).otherwise(F.col("weight")).alias("weight")).distinct())
    sets = node_sets(large.select("node").distinct(), docs, reps, like)
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")
    dealt = (rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
             .withColumn("partner", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .select("group", F.least("own", "partner").alias("i"), F.greatest("own", "partner").alias("j"),
                     F.when(F.col("own") <= F.col("partner"), 0).otherwise(1).alias("side"), "node", "root").join(sets, "node"))
    compare = _block_links(like)

    def run(table: pa.Table) -> pa.Table:
        links = compare(table)
        give_back()  # sets and matrices of two blocks
        return links

    return dealt.groupBy("group", "i", "j").applyInArrow(run, "a binary, b binary")


# --- the operator ---------------------------------------------------------------

def linked_profiles(docs: DataFrame, like: Likeness) -> DataFrame:
    """``doc_id, text_key, n_shingles, node, root, component_id`` of every row."""
    rows = stage(profiles(docs, like), "profiles")
    place = F.min(F.struct("doc_id", "text_key")).alias("place")
    reps = stage(rows.where("node is not null").groupBy("node").agg(
        place, F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature")), "classes")
    members = bucket_members(reps)
    pairs = stage(verify_signatures(stars(members), reps, like), "star-pairs")
    both = pairs.select("a", "b", "matches").union(pairs.select("b", "a", "matches"))
    # a partner that is clearly alike, the smallest of these: they hang on few nodes; otherwise the most alike
    clear = F.col("matches") >= (like.threshold + 0.03) * HASHES
    best = (both.groupBy("a").agg(F.min(F.when(clear, F.col("b"))).alias("clear"), F.max(F.struct("matches", "b")).alias("best"))
            .select(*ordered_pair(F.col("a"), F.coalesce("clear", "best.b"))).distinct())
    links = stage(verify_sets(best, docs, reps, like), "links")
    roots = stage(components(links), "roots")

    def root_of(side: str) -> DataFrame:
        return roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))

    rest = (pairs.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
            .where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    opened = open_buckets(members, roots)
    near = verify_signatures(small_pairs(opened), reps, like).select("a", "b")
    later = stage(rest.unionByName(near).distinct(), "later-pairs")
    more = []
    if not later.isEmpty():
        more.append(stage(verify_sets(later, docs, reps, like), "links"))
    large = opened.where(F.col("size") > SMALL)
    if not large.isEmpty():
        more.append(stage(large_links(large, docs, reps, like), "links"))
    if more:
        roots = stage(merged(roots, functools.reduce(DataFrame.unionByName, more)), "roots")

    classes = reps.select("node", "least_id").join(roots, "node", "left").select("node", "least_id", F.coalesce("root", "node").alias("root"))
    tops = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = classes.join(tops, "root").select("node", "root", "component_id")
    return (rows.drop("signature").join(named, "node", "left")
            .select("doc_id", "text_key", "n_shingles", "node", "root",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``node, root`` after further links: only the roots at their ends are connected anew."""
    def end(side: str) -> DataFrame:
        return roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))

    ends = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    tops = stage(components(ends), "tops").select(F.col("node").alias("top"), F.col("root").alias("new_root"))
    known = roots.unionByName(tops.select(F.col("top").alias("node"), F.col("top").alias("root"))).distinct()
    return known.join(tops, known["root"] == tops["top"], "left").select("node", F.coalesce("new_root", "root").alias("root"))


def components_of(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """Per row: set size, component and whether the row has the component's id."""
    return linked_profiles(docs, like).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """One row of each component, its smallest id; rows without words all stay."""
    rows = stage(linked_profiles(docs, like).where("node is not null").select("doc_id", "text_key", "root"), "linked")
    least = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("k"))
    keys = (rows.select("doc_id", "text_key", F.lit(1).alias("row"), F.lit(0).alias("least"))
            .unionByName(least.select("k.doc_id", "k.text_key", F.lit(0).alias("row"), F.lit(1).alias("least")))
            .groupBy("doc_id", "text_key").agg(F.sum("row").alias("rows"), F.max("least").alias("least")))
    # only rows that go, and copies of one row, are doubtful: a bitmap of them leaves the texts of nearly all others where they lie
    doubtful = stage(keys.where("least = 0 or rows > 1").select(F.col("doc_id").alias("at_id"), F.col("text_key").alias("at_key"), "least",
                                                               place("doc_id", "text_key")), "doubtful")
    source = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_in"), F.col("doc_id").cast("long").alias("key_id"),
                         F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key_text"))
    source = flagged(source.withColumn("place", place("key_id", "key_text")), doubtful, doubted=F.lit(True))
    found = (source.where("doubted").join(doubtful, F.col("key_id").eqNullSafe(F.col("at_id")) & (F.col("key_text") == F.col("at_key")), "left")
             .where("least is null or least = 1"))
    order = Window.partitionBy("key_id", "key_text").orderBy(F.lit(1))
    kept = found.withColumn("copy", F.row_number().over(order)).where("least is null or copy = 1")
    return (source.where("not doubted").select("row_in").unionByName(kept.select("row_in"))
            .select(*[F.col("row_in")[c].alias(c) for c in docs.columns]))
