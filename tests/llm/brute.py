"""Plain versions of the operators, on lists of rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
RULES = (("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 8),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32))


def codes(rows, tokenizer, end_id):
    """``doc_id -> (start, n, crc)`` of rows with distinct ids."""
    out, start = {}, 0
    for doc_id, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def usable(rows, zero):
    return [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
            and (zero or any(x != 0 for x in v))]


def top(rows, every, k, integer):
    rows = usable(rows, integer)
    ids = np.array([i for i, _ in rows])
    vecs = np.array([np.floor(256 * v) if integer else v for _, v in rows])
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = np.einsum("ij,j->i", vecs, vecs[i])
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(r + 1, int(ids[j]), float(score[j])) for r, j in enumerate(order)]
    return out


def secrets(text):
    found = []
    for order, (kind, pattern, group, least) in enumerate(RULES):
        found += [(m.start(), order, kind, m.end()) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    found.sort()
    joined = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in found)
    return (*(sum(f[2] == kind for f in found) for kind, *_ in RULES), hashlib.sha256(joined.encode()).hexdigest(), joined)


def shingles(text, width):
    words = SPACE.findall((text or "").encode().lower())
    if not words:
        return set()
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)}


def near(rows, width, part, whole):
    """``(doc_id, size, component)`` per row, in order."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    owners = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            owners[x].append(i)
    for i, s in enumerate(sets):
        seen = defaultdict(int)
        for x in s:
            for j in owners[x]:
                if j < i:
                    seen[j] += 1
        for j, both in seen.items():
            if whole * both >= part * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        if doc_id is not None and (r not in least or doc_id < least[r]):
            least[r] = doc_id
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def fill(per_source, weights=(5, 2, 1), epochs=3):
    """Targets by clamping and sharing anew until no source is above its cap."""
    names = sorted((s for s in per_source if s is not None)) + [s for s in per_source if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    free, left, out = set(names), float(sum(per_source.values())), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > epochs * per_source[s]}
        if not over:
            out |= {s: unit * weight[s] for s in free}
            break
        out |= {s: float(epochs * per_source[s]) for s in over}
        left -= sum(out[s] for s in over)
        free -= over
    return out


def unigram(rows, folds=7, held=2):
    """``doc_id -> (held, tokens, known, N, base)`` of rows with distinct ids."""
    texts = {d: [*(t or "").encode().translate(LOWER).split(), b""] for d, t in rows}
    out = {d: zlib.crc32(str(d).encode()) % folds == held if d is not None else False for d in texts}
    counts = defaultdict(int)
    for d, words in texts.items():
        for w in words if not out[d] else ():
            counts[w] += 1
    total = sum(counts.values())
    return {d: (out[d], len(words), sum(counts.get(w, 0) > 0 for w in words), total,
                sum(math.log10((counts.get(w, 0) + 1) / (total + len(counts) + 1)) for w in words)) for d, words in texts.items()}


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FEATURE = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    words = FEATURE.findall((text or "").encode().translate(LOWER))
    return len(words), [zlib.crc32(b" ".join(words[i:i + n])) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def drawn(rows, target, buckets, longest, least, percent):
    """``doc_id -> (features, weight, score, rank)`` of rows with distinct ids."""
    own = {d: runs(t, longest) for d, t in rows}
    s, t = defaultdict(int), defaultdict(int)
    for counts, texts in ((s, (f for _, f in own.values())), (t, (runs(x, longest)[1] for x in target))):
        for crcs in texts:
            for c in crcs:
                counts[c % buckets] += 1
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = {}
    for d, (_, crcs) in own.items():
        weight = sum(gain(c % buckets) for c in crcs) // len(crcs) if crcs else 0
        h = int(hashlib.sha256(f"2024:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        out[d] = [len(crcs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((d for d in out if own[d][0] >= least), key=lambda d: (-out[d][2], d is not None, d or 0))
    for rank, d in enumerate(able[:percent * len(able) // 100], 1):
        out[d][3] = rank
    return out


def phrases(rows, least, part, first, longest=4, factor=2_000_000):
    """Rows of ``(lang, rank, phrase, a, l, r, n, score)`` from ``(text, lang)``."""
    f, n = defaultdict(int), defaultdict(int)
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().translate(LOWER)):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i:i + k])] += 1
    found = {key: a for key, a in f.items() if len(key[1]) >= 2 and a >= least}
    inner = defaultdict(int)
    for (lang, words), a in found.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner[lang, words[i:i + k]] = max(inner[lang, words[i:i + k]], a)
    by_lang = defaultdict(list)
    for (lang, words), a in found.items():
        if 100 * inner[lang, words] < part * a:
            score, k = min((factor * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words)))
            by_lang[lang].append((-score, -a, b" ".join(words), f[lang, words[:k]], f[lang, words[k:]]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, rows in by_lang.items() for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1))
