"""Plain versions of the operators' results, for small tables only."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def repeated_bytes(docs, width=100):
    """op1: {doc_id: (n_bytes, n_removed, n_spans, kept_sha256)} of [(doc_id, text)]."""
    first = {}
    for doc, text in sorted(docs, key=lambda r: r[0]):
        b = (text or "").encode()
        for s in range(len(b) - width + 1):
            first.setdefault(b[s : s + width], (doc, s))
    out = {}
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if first[b[s : s + width]] < (doc, s):
                gone[s : s + width] = b"\1" * width
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[doc] = (len(b), sum(gone), spans, sha(kept))
    return out


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    if len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def linked_components(docs, percent=75):
    """op3: {doc_id: (n_shingles, component_id)}."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    common = Counter()
    for group in holders.values():
        for i, a in enumerate(group):
            for b in group[:i]:
                common[min(a, b), max(a, b)] += 1
    for (a, b), both in common.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


RULES = (
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def secrets(text):
    """op4: (n_assign, n_access, n_hex, base_sha256, spans)."""
    found = []
    for k, (kind, pattern, group, least) in enumerate(RULES):
        found += [(m.start(), k, m.end(), kind) for m in pattern.finditer(text or "") if len(m.group(group)) >= least]
    listed = ",".join(f"{kind}:{s}:{e}" for s, _, e, kind in sorted(found))
    n = Counter(f[3] for f in found)
    return n["assign"], n["access"], n["hex"], sha(listed), listed


def targets(sizes, weights=(5, 2, 1), repeats=3):
    """op5: {source: target} of {source: size}; NULL is last."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(repeats * sizes[s] for s in capped)
        among = sum(weight[s] for s in names if s not in capped)
        share = {s: repeats * sizes[s] if s in capped else left * weight[s] / among for s in names}
        over = {s for s in names if s not in capped and share[s] > repeats * sizes[s]}
        if not over:
            return share
        capped |= over


def lines(docs, least_chars=20, least_docs=3):
    """op7: {doc_id: (n_lines, n_dropped, kept_sha256)}."""
    strip = " \t\n\x0b\x0c\r"

    def key(line):
        return line.strip(strip).translate(LOWER)

    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        all_lines = (t or "").split("\n")
        left = [x for x in all_lines if len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == d]
        out[d] = (len(all_lines), len(all_lines) - len(left), sha("\n".join(left)))
    return out


def measures(text):
    """op9: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(runs)
    hit = set()
    for i, r in enumerate(runs):
        if n[r] > 1:
            hit |= set(range(i, i + 5))
    symbols = sum(c in "#*$%&|<>" for c in text)
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), symbols, dup, len(hit), failed


def n_lines(text):
    """Lines with a word."""
    return sum(bool(words(line)) for line in (text or "").split("\n"))


def top(rows, is_query, k=10):
    """op10: {(query_id, rank): (vec_id, score)} of [(vec_id, vector)]."""
    usable = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            usable.append((i, [math.floor(1024 * float(x)) for x in v]))
    out = {}
    for q, a in usable:
        if is_query(q):
            best = sorted(
                (-sum(x * y for x, y in zip(a, b)), i) for i, b in usable if i != q and len(a) == len(b)
            )
            for r, (s, i) in enumerate(best[:k], 1):
                out[q, r] = (i, -s)
    return out


def held_out(doc_id, folds, fold):
    return zlib.crc32(str(doc_id).encode()) % folds == fold
