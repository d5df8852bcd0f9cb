"""Plain single-machine versions of the operators' contracts."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def roots(n, links):
    low = {x: x for x in n}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {x: find(x) for x in n}


def embeddings(rows):
    """rows of (vec_id, vector, label) -> {vec_id: (n_links, component)}"""
    good = {}
    for i, v, label in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
        if label is not None and len(x) and np.isfinite(x).all() and (x != 0).any():
            good[i] = (label, x)
    links = [(a, b) for a in good for b in good if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.linalg.norm(good[a][1]) / np.linalg.norm(good[b][1]) >= 0.93]
    degree = collections.Counter(x for link in links for x in link)
    root = roots([r[0] for r in rows], links)
    return {i: (degree[i], root[i]) for i in root}


def substrings(rows, window=50):
    first, out = {}, {}
    for i, text in sorted(set(rows)):
        words = WORD.findall(text or "")
        gone = bytearray(len(words))
        for a in range(len(words) - window + 1):
            if first.setdefault(tuple(words[a : a + window]), i) < i:
                gone[a : a + window] = b"\1" * window
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[i] = (len(words), len(words) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def secrets(text):
    """Spans by walking the patterns of the contract one match at a time."""
    text, found = text or "", []
    rules = (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
        ("access", r"AKIA[A-Z0-9]+", 0, 18),
        ("hex", r"[0-9a-f]+", 0, 16),
    )
    for order, (kind, pattern, group, least) in enumerate(rules):
        at = 0
        while m := re.compile(pattern).search(text, at):
            at = m.end()
            if len(m[group]) >= least:
                found.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def shingles(text, width=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def near(rows, width=4):
    sets = {i: shingles(t, width) for i, t in rows if i is not None}
    ids = sorted(sets)
    links = []
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    links.append((a, b))
    root = roots(ids, links)
    return {i: (len(sets[i]), root[i]) for i in ids}


def quality(text):
    words = WORD.findall(text or "")
    seen, cover = collections.defaultdict(list), set()
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    for places in seen.values():
        if len(places) > 1:
            cover |= {p + k for p in places for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(cover) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover), failed


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def parse(rows, window=50):
    """{id: spans} by a plain greedy parser that compares words with each reference document in turn."""
    texts = {i: WORD.findall(t or "") for i, t in rows}
    novel: dict[int, set[int]] = {}  # windows that no smaller place holds
    seen: set[tuple] = set()
    for i in sorted(texts):
        novel[i] = set()
        for a in range(len(texts[i]) - window + 1):
            w = tuple(texts[i][a : a + window])
            if w not in seen:
                seen.add(w)
                novel[i].add(a)
    out = {}
    for i, words in texts.items():
        spans, a = [], 0
        while a + window <= len(words):
            best = (0, 0, 0)
            for j in sorted(x for x in texts if x < i):
                for b in novel[j]:
                    n = 0
                    while a + n + window <= len(words) and b + n in novel[j] and words[a + n : a + n + window] == texts[j][b + n : b + n + window]:
                        n += 1
                    if n > best[0]:
                        best = (n, j, b)
            if best[0]:
                spans.append((a, a + best[0] - 1 + window, best[1], best[2]))
            a += best[0] or 1
        out[i] = spans
    return out


def toxic_features(text):
    """Words, stems, bigrams and skip-grams of a text, as they are written."""
    words = [b.strip(b".,;:!?\"'()[]{}*#%&$<>|-_/\\") or b for b in (text or "").encode().lower().split()]
    found = {("word", w) for w in words} | {("stem", k, w[:k]) for w in words for k in (4, 5, 6) if len(w) > k}
    return found | {("next", a, b) for a, b in zip(words, words[1:])} | {("skip", a, b) for a, b in zip(words, words[2:])}


def ftrl(stream, alpha, beta, l1, l2):
    """Follow-the-regularised-leader, one coordinate at a time, over dictionaries; returns the score of a text."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f):
        bound = l1 if f else 0.0  # the empty feature is the intercept
        if abs(z[f]) <= bound:
            return 0.0
        return -(z[f] - (bound if z[f] > 0 else -bound)) / ((beta + n[f] ** 0.5) / alpha + l2)

    def score(text):
        return 1 / (1 + np.exp(-sum(weight(f) for f in [(), *toxic_features(text)])))

    for text, label in stream:
        g = score(text) - label
        for f in [(), *toxic_features(text)]:
            rate = ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / alpha
            z[f] += g - rate * weight(f)
            n[f] += g * g
    return score


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def contamination(docs, items, width=10, shingle=5, least=1.0):
    """[(words, hit places, item ids)] of each text, window by window."""
    records = set()
    for item, text in items:
        words = ALNUM.findall(ascii_lower(text))
        if words:
            n = min(width, len(words))
            records |= {(item, tuple(words[p : p + n])) for p in range(len(words) - n + 1)}
    out = []
    for text in docs:
        words = ALNUM.findall(ascii_lower(text))
        hit, ids = set(), set()
        for item, record in records:
            n = len(record)
            k = min(shingle, n)
            places = range(n - k + 1)
            for p in range(len(words) - n + 1):
                window = tuple(words[p : p + n])
                met = sum(window[o : o + k] == record[o : o + k] for o in places)
                if window == record if least >= 1 else met >= max(1, math.ceil(least * len(places) - 1e-9)):
                    hit |= set(range(p, p + n))
                    ids |= {item} - {None}
        out.append((len(words), hit, sorted(map(str, ids), key=str.encode)))
    return out


def runs(s, least=12):
    """(start, length, period) of every run, by every period and place."""
    found = {}
    for q in range(1, len(s) // 2 + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def divergence(rows, ranks=200):
    """Rows of (text, lang, source): every share of every kept term written out."""
    rows = [(LETTERS.findall(ascii_lower(t)), lang or "", source or "") for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        seen = collections.Counter(w for words, own, _ in rows if own == lang for w in set(words))
        kept = sorted(w for w, n in seen.items() if n >= 3)
        names = {s for _, own, s in rows if own == lang}
        counts = {s: collections.Counter(w for words, own, source in rows if own == lang and source == s for w in words) for s in names}
        counts[None] = sum(counts.values(), collections.Counter())
        share = {}
        for s, c in counts.items():
            total = sum(c[w] for w in kept)
            share[s] = {w: 1 + 1_000_000_000 * (c[w] + 1) // (total + len(kept)) for w in kept}
        for s in names:
            pairs = [(-sum((share[s][w] - share[o][w]) ** 2 // share[o][w] for w in kept), o.encode(), o) for o in names - {s}]
            terms = [(-((share[s][w] - share[None][w]) ** 2 // share[None][w]), w.encode(), w) for w in kept if counts[s][w] and share[s][w] > share[None][w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(sorted(found)[:most])]
    return sorted(out)
