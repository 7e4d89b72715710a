"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def substrings(rows, window=100):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(w)
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()
    return out


def fingerprint(text):
    import xxhash

    w = words(text)
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=2):
    """prints: id -> fingerprint."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def lines(rows, pct=80):
    sets, out = [], {}
    for i, text in sorted(rows):
        kept, n = [], 0
        for x in (text or "").split("\n"):
            w = {y for y in re.split(r"[\x20\x09-\x0D]+", x.lower()) if y}
            again = bool(w) and any(100 * len(w & s) >= pct * len(w | s) for s in sets)
            if w:
                sets.append(w)
            if again:
                n += 1
            else:
                kept.append(x)
        out[i] = n, "\n".join(kept)
    return out


def quality(text, repeat_len):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = len(w)
    c = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    longest = [max((next((k for k in range(n) if max(i, j) + k >= n or w[i + k] != w[j + k]), n) for j in range(n) if j != i), default=0) for i in range(n)]
    three = {x for i in range(n - 2) if c[tuple(w[i : i + 3])] > 1 for x in (i, i + 1, i + 2)}
    covered = {x for i in range(n) if longest[i] >= repeat_len for x in range(i, i + longest[i])}
    seen, dup = set(), 0
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    return n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(three), len(covered), max(longest, default=0)


def unigram(rows):
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    tokens = {i: [*words(t), b"\n"] for i, t in rows}
    c = Counter(w for i in tokens if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (held[i], len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in tokens.items()}


def contained(rows, items, pct=80):
    def tokens(t):
        return [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]

    def shingles(w, k):
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    out = {}
    for i, t in rows:
        for j, item in items:
            w = tokens(item)
            if w:
                k = min(5, len(w))
                a, b = shingles(w, k), shingles(tokens(t), k)
                if 100 * len(a & b) >= pct * len(a):
                    out[i, j] = len(a), len(a & b)
    return out
