"""Operator 3: secret scans through a trigram index, in DataFrame functions only.

Each rule's pattern is read into a Boolean query over trigrams that every match must hold (``trigram_query``). The index
keeps, for the trigrams of all rules, a posting (trigram, row) per row that holds them, sorted by trigram in each file. Postings are
intersected per row as a bit mask, the rows whose mask satisfies a rule's query are its candidates, and only candidates are
verified by the pattern itself, where their texts lie: a bitmap of fixed size per rule says which rows they are, and no text is moved.
A rule without a mandatory trigram (``hex``) scans every text.

Spans are code points with exclusive ends. A row of the index is (id, hash of the text): equal rows share it, and a hash or a place in
the bitmap that two texts share only adds a candidate. Trigrams are compared in lower case, which can add candidates and never lose one.

Defined cases: a null or empty text has no span; null ids and repeated rows are kept as they are; other columns are not read by
``scan`` and are kept by ``redact``; an empty table gives an empty result; rules with equal spans are all reported, in rule order.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.llm.marks import flagged, place
from linklens.session import stage


@dataclass(frozen=True)
class Rule:
    """``group`` of a match must have ``least`` characters; spans cover the whole match."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


# The contract's rules, in its order.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)


# --- from patterns to trigram queries ----------------------------------------

def _literals(nodes, most: int = 64) -> list[list[str]]:
    """Alternatives of a pattern, each a list of the runs of characters that a match must hold in this order."""
    alternatives: list[list[str]] = [[""]]
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            alternatives = [[*runs[:-1], runs[-1] + chr(arg)] for runs in alternatives]
        elif name in ("SUBPATTERN", "ATOMIC_GROUP"):
            alternatives = _append(alternatives, _literals(arg[-1] if name == "SUBPATTERN" else arg, most))
        elif name == "BRANCH":
            alternatives = _append(alternatives, [a for branch in arg[1] for a in _literals(branch, most)])
        elif name.endswith("REPEAT") and (low := arg[0]) <= 1 and arg[1] == 1:
            once = _literals(arg[2], most)
            alternatives = _append(alternatives, once if low else [[""], *once])
        elif name.endswith("REPEAT") and arg[0] >= 1:  # at least once, then anything
            alternatives = [[*runs, ""] for runs in _append(alternatives, _literals(arg[2], most))]
        elif name == "AT":
            continue
        else:  # a class, an optional repeat or anything else may be any text
            alternatives = [[*runs, ""] for runs in alternatives]
        if len(alternatives) > most:  # too many: keep nothing mandatory from here
            return [[""]]
    return alternatives


def _append(left: list[list[str]], right: list[list[str]]) -> list[list[str]]:
    return [[*a[:-1], a[-1] + b[0], *b[1:]] for a in left for b in right]


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """A match holds all trigrams of at least one of these sets; no sets: nothing is mandatory."""
    import re._parser as parser
    sets = {frozenset(run[i:i + 3].lower() for run in runs for i in range(len(run) - 2)) for runs in _literals(parser.parse(rule.pattern))}
    if any(not s or any(ord(ch) > 127 for t in s for ch in t) for s in sets):
        return []
    return sorted((s for s in sets if not any(other < s for other in sets)), key=sorted)


# --- index and candidates ----------------------------------------------------

def keyed(docs: DataFrame) -> DataFrame:
    """Id, text (null: empty) and text hash."""
    return docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn(
        "text_key", F.xxhash64("text"))


def trigrams_of(rules) -> list[str]:
    return sorted({t for rule in rules for s in trigram_query(rule) for t in s})


def write_index(docs: DataFrame, rules=RULES) -> DataFrame:
    """Postings ``(trigram, doc_id, text_key)`` of the rules' trigrams, sorted by trigram within each file."""
    low = F.lower("text")
    grams = trigrams_of(rules)
    # one test of the trigrams' common part keeps most texts out
    held = F.filter(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in grams] or [F.lit(None).cast("string")]),
                    lambda g: g.isNotNull())
    postings = (keyed(docs).withColumn("low", low).select("doc_id", "text_key", F.explode(held).alias("trigram"))
                .select("trigram", "doc_id", "text_key").sortWithinPartitions("trigram"))
    return stage(postings, "trigrams")


def candidates(index: DataFrame, rules=RULES) -> DataFrame:
    """``(doc_id, text_key, wanted)``: rows whose postings satisfy a rule's query; ``wanted`` has a bit per rule."""
    grams = trigrams_of(rules)
    bit = F.element_at(F.create_map(*[F.lit(v) for g, i in zip(grams, range(len(grams))) for v in (g, 1 << i)]), F.col("trigram"))
    masks = index.where(F.col("trigram").isin(grams)).groupBy("doc_id", "text_key").agg(F.bit_or(bit.cast("long")).alias("mask"))

    def needs(grams_of_set) -> Column:
        mask = F.lit(sum(1 << grams.index(g) for g in grams_of_set)).cast("long")
        return F.col("mask").bitwiseAND(mask) == mask

    wanted = F.lit(0)
    for i, rule in enumerate(rules):
        if query := trigram_query(rule):
            wanted = wanted.bitwiseOR(F.when(functools.reduce(operator.or_, map(needs, query)), F.lit(1 << i)).otherwise(F.lit(0)))
    return masks.select("doc_id", "text_key", wanted.alias("wanted")).where("wanted != 0")


# --- verification ------------------------------------------------------------

SPAN = "array<struct<start:int,order:int,kind:string,end:int>>"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans of a rule's passing matches: lengths of matches and of the gaps between them, summed up."""
    matches = F.regexp_extract_all(text, F.lit(rule.java), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(rule.java), F.lit(rule.group)) if rule.group else matches
    gaps = F.split(text, rule.java, -1)
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("found"))

    def add(state, piece):
        begin = state["at"] + piece["gap"]
        end = begin + piece["length"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        found = F.when(piece["size"] >= rule.least, F.array_append(state["found"], span)).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    pieces = F.transform(F.arrays_zip(matches.alias("m"), values.alias("v"), F.slice(gaps, 1, F.size(matches)).alias("g")), lambda z: F.struct(
        F.length(z["g"]).alias("gap"), F.length(z["m"]).alias("length"), F.length(z["v"]).alias("size")))
    return F.aggregate(pieces, start, add, lambda state: state["found"])


def _passing(rule: Rule) -> str:
    """A pattern that any passing match holds: for a class repeated to the end, as many of it as are needed."""
    return re.sub(r"\+$", f"{{{rule.least}}}", rule.java) if rule.pattern.startswith("[") and not rule.group else rule.java


def _found(text: Column, rule: Rule, order: int, wanted: Column) -> Column:
    return F.when(wanted & text.rlike(_passing(rule)), spans(text, rule, order)).otherwise(F.expr(f"cast(array() as {SPAN})"))


def with_spans(docs: DataFrame, rules=RULES, column: str = "found") -> DataFrame:
    """Every row of ``docs`` as ``row_in``, with all its spans in order of start, then rule."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row_in"), F.col("doc_id").alias("key_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    indexed = [i for i, rule in enumerate(rules) if trigram_query(rule)]
    if indexed:
        chosen = candidates(write_index(docs, rules), rules).select(place("doc_id", "text_key"), "wanted")
        bits = {f"rule_{i}": F.col("wanted").bitwiseAND(F.lit(1 << i)) != 0 for i in indexed}
        rows = flagged(rows.withColumn("text_key", F.xxhash64("text")).withColumn("place", place("key_id", "text_key")), chosen, **bits)
    found = [_found(F.col("text"), rule, i, F.col(f"rule_{i}") if i in indexed else F.lit(True)) for i, rule in enumerate(rules)]
    return rows.select("row_in", F.array_sort(F.concat(*found)).alias(column))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """Per row: spans counted by kind, their digest and their list."""
    rows = with_spans(docs.select("doc_id", "text"), rules).select(F.col("row_in")["doc_id"].alias("doc_id"), "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    text = joined(F.col("found"))
    return rows.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in rules],
                       F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))


def redact(docs: DataFrame, rules=RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask`` and ``n_chars`` counted anew; overlapping spans become one."""
    rows = with_spans(docs, rules)
    text = F.col("row_in")["text"]
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, span):
        fresh = span["start"] >= s["at"]
        begin = F.greatest(s["at"], span["start"])
        out = F.when(fresh, F.concat(s["out"], F.substring(text, s["at"] + 1, begin - s["at"]), F.lit(mask))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], span["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("found", state, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    fresh = F.when(F.size("found") > 0, clean).otherwise(text)
    out = []
    for field in docs.schema.fields:
        value = F.col("row_in")[field.name]
        if field.name == "text":
            value = fresh
        elif field.name == "n_chars":
            value = F.when(F.size("found") > 0, F.length(fresh).cast(field.dataType)).otherwise(value)
        out.append(value.alias(field.name))
    return rows.select(*out)
