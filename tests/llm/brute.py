"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def shingle_set(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_components(docs):
    """(set size, component) by id, every pair compared."""
    sets = {i: shingle_set(t) for i, t in docs.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders, common = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            common.update((j, i) for j in holders[x])
            holders[x].append(i)
    for (i, j), n in common.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def substrings(docs, window=50):
    """(words, removed, kept) by id."""
    split, first = {i: words(docs[i]) for i in sorted(docs)}, {}
    for i, w in split.items():
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), i)
    out = {}
    for i, w in split.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < i:
                gone.update(range(s, s + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def luhn(digits):
    doubled = [int(d) * (2 if k % 2 else 1) for k, d in enumerate(digits[::-1])]
    return sum(n // 10 + n % 10 for n in doubled) % 10 == 0


def pii(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in kinds for m in re.finditer(p, text or "") if ok(m.group())]


def patience(a, b):
    """Matched places of two lists: the longest chain of elements that are once in both, rising in both."""
    pairs = sorted((a.index(x), b.index(x)) for x in a if a.count(x) == 1 and b.count(x) == 1)
    best = []
    for i, j in pairs:
        before = max((c for c in best if c[-1][0] < i and c[-1][1] < j), key=len, default=[])
        best.append(before + [(i, j)])
    return max(best, key=len, default=[])


def runs_of(text, least):
    """(first line, line after the last, lines) of the runs of at least so many characters without shorter ones inside at one of their ends."""
    lines, out = text.split("\n"), {}
    size = lambda i, j: sum(map(len, lines[i:j]))
    for i in range(len(lines)):
        j = next((j for j in range(i + 1, len(lines) + 1) if size(i, j) >= least), None)
        if j:
            out[i, j] = tuple(lines[i:j])
        k = next((k for k in range(i, -1, -1) if size(k, i + 1) >= least), None)
        if k is not None:
            out[k, i + 1] = tuple(lines[k : i + 1])
    return out


def aligned_lines(docs, least=40):
    """Lines of each document that patience diff aligns with any earlier document, every pair on its own.

    A pair is aligned in rounds; a run that the later document repeats waits for the next round, and runs that were
    aligned leave it.
    """
    out, seen = {}, {}
    for d in sorted(docs):
        gone = set()
        for earlier in seen.values():
            left = runs_of(docs[d], least)
            there = list(dict.fromkeys(earlier.values()))
            while True:
                places = {}
                for place, run in sorted(left.items()):
                    places.setdefault(run, place)
                here = list(places)
                matched = [places[here[j]] for _, j in patience(there, here)]
                if not matched:
                    break
                for a, b in matched:
                    gone.update(range(a, b))
                    del left[a, b]
        seen[d] = runs_of(docs[d], least)
        out[d] = gone
    return out


def line_blocks(docs, least=40):
    """(lines, removed, kept) by id: every run of lines of every document against all earlier ones."""
    seen, out = set(), {}
    for i in sorted(docs):
        lines = docs[i].split("\n")
        gone, runs = set(), set()
        for a in range(len(lines)):
            size = 0
            for b in range(a, len(lines)):
                size += len(lines[b])
                run = tuple(lines[a : b + 1])
                if size >= least:
                    runs.add(run)
                    if run in seen:
                        gone.update(range(a, b + 1))
        seen |= runs
        out[i] = (len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def spelling(docs, slips=199):
    """word -> (n, near words, form, root) of the words of six letters and five occurrences."""
    up, counts = str.maketrans({c: c + 32 for c in range(65, 91)}), Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(up)
            h = zlib.crc32(f"{i}:{w}".encode())
            if slips and i is not None and h % slips == 0:
                w = "".join(c for k, c in enumerate(w) if k != h % len(w))
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    found = {w: [x for x in counts if near(w, x)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(found[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 5 * n else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n, len(found[w]), form[w], root, counts.get(form[w]))
    return out
