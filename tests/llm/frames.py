"""Small fixture frames and plain Python versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, node string"
SPACED = r"[^\x20\x09-\x0D]+"
ALPHA = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def texts(seed=3, n=60):
    """Random prose with exact and near copies, shared passages, and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "ou", "ré", "st", "i", "K"]) for _ in range(rng.randint(1, 4)))
    vocabulary = [word() for _ in range(400)]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, out = prose(60), []
    for i in range(n):
        w = prose(rng.choice([0, 1, 3, 5, 30, 90, 200]))
        if i % 4 == 1:
            w[len(w) // 2 : len(w) // 2] = passage
        if i % 5 == 2 and out:
            w = list(rng.choice(out))
            if w and i % 10 == 2:
                w[rng.randrange(len(w))] = "changed"
        out.append(w)
    joined = ["".join(x + rng.choice([" ", " ", "  ", "\n", "\t"]) for x in w) for w in out]
    return [*joined, None, "", " \n ", "x", "Er " * 400, "a b c", "A B C", "x" * 3000, "one\u00a0two\u0085three \x1f end", "many " + "<|endoftext|> don't it's. !!" * 3]


def rows(seed=3, n=60):
    out = [(i, t, [None, "en", "de"][i % 3], f"src{i % 2}", None if t is None else len(t), 5, "clash") for i, t in enumerate(texts(seed, n))]
    return [*out, out[3], (out[4][0], "another text of the same id", "en", None, 3, 1, None), (None, "no id at all", None, None, None, None, None), (None, None, None, None, None, None, None)]


def removed(docs, window=20):
    """For each (id, text): words and removed places. Same rows count once."""
    order = sorted({(i is None, i or 0, key, t or "") for i, t, key in docs})
    first, out = {}, {}
    for none, i, key, t in order:
        w = t.encode().split()
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if first.setdefault(k, (none, i, key, s)) != (none, i, key, s):
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[None if none else i, t] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text):
    w = lower(text).encode().split()
    return {tuple(w[s : s + 4]) for s in range(max(1, len(w) - 3))} if w else set()


def components(sets, percent=85):
    """sets: by row number. The row numbers of each row's component."""
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    items = list(sets.items())
    for k, (i, a) in enumerate(items):
        for j, b in items[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in sets:
        groups.setdefault(find(i), set()).add(i)
    return {i: groups[find(i)] for i in sets}


def contamination(docs, items, window=13):
    windows = {}
    for item, text in items:
        w = re.findall(ALPHA, lower(text))
        for s in range(max(1, len(w) - window + 1)) if w else ():
            windows.setdefault(tuple(w[s : s + window]), set()).add("" if item is None else str(item))
    out = {}
    for i, text in docs:
        w = re.findall(ALPHA, lower(text))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if got := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= got
        out[i, text] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def measures(text):
    w = re.findall(SPACED, text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(SPACED, line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(w[s : s + 8]) for s in range(len(w) - 7))
    repeated = {p for s in range(len(w) - 7) if count[tuple(w[s : s + 8])] > 1 for p in range(s, s + 8)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(repeated)
