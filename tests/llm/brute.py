"""Brute-force versions of the operators, on plain lists of (doc_id, text)."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def jaccard(rows, k, p, q):
    sets = []
    for _, text in rows:
        w = WORD.findall(ascii_lower(text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    shared = Counter()
    for members in by.values():
        for a in range(len(members)):
            for b in range(a):
                shared[members[b], members[a]] += 1
    for (a, b), n in shared.items():
        if q * n >= p * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(rows[a][0]), find(rows[b][0])
            parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for (d, _), s in zip(rows, sets))


def windows(rows, width):
    first = {}
    for d, text in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(text or "")
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = []
    for d, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return sorted(out)


def byte_strings(rows, width):
    seen = Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for d, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


def gone_lines(rows, min_words):
    """{doc: (lines, which of them go)}: lines of the runs, of any length from min_words words on, that also stand earlier; ids are distinct."""
    docs = [(d, text.split("\n")) for d, text in sorted(rows, key=lambda r: r[0]) if text is not None]
    first, gone = {}, {d: [False] * len(x) for d, x in docs}
    for d, x in docs:
        for i in range(len(x)):
            n = 0
            for j in range(i, len(x)):
                n += len(WORD.findall(x[j]))
                if n >= min_words and first.setdefault(tuple(x[i : j + 1]), (d, i)) != (d, i):
                    gone[d][i : j + 1] = [True] * (j + 1 - i)
    return {d: (x, gone[d]) for d, x in docs}


def maximal_line_runs(rows, min_words):
    return {d: "\n".join(a for a, b in zip(x, gone) if not b) for d, (x, gone) in gone_lines(rows, min_words).items()}


def lines(rows, min_words):
    """Of each document: lines, how many go, in how many maximal spans, hash of the rest."""
    by, out = gone_lines(rows, min_words), []
    for d, _ in rows:
        x, gone = by.get(d, ([], []))
        kept = "\n".join(a for a, b in zip(x, gone) if not b)
        spans = sum(b and not (i and gone[i - 1]) for i, b in enumerate(gone))
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def contamination(rows, items, width=13):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    by = defaultdict(set)
    for item, text in items:
        w = split.findall(ascii_lower(text or ""))
        for i in range(max(len(w) - width + 1, 1) if w else 0):
            by[tuple(w[i : i + width])].add(item)
    sizes = {len(x) for x in by}
    out = []
    for d, text in rows:
        w = split.findall(ascii_lower(text or ""))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in by:
                    hit[i : i + n] = [True] * n
                    found |= by[x]
        names = sorted(str(x) for x in found if x is not None)
        n = sum(hit)
        out.append((d, len(w), n, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n > 0 and 20 * n >= len(w)))
    return sorted(out)


def trie(rows, rebuild=None):
    """Nodes of the prefix trie of (conv_id, turn, role, text) rows, as op11 returns them; -1 for no parent."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            by[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), text))
    seqs = {}
    for v in by.values():
        v.sort()
    for c, v in by.items():
        h = zlib.crc32(str(c).encode()) % rebuild[1] if rebuild else 0
        head = by.get(c - int(math.fmod(c, rebuild[0])), [])[:h] if rebuild else []
        seqs[c] = [(x[2], x[4]) for x in head + v[h:]]
    node, kids, out = defaultdict(list), defaultdict(list), {}
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            node[tuple(seqs[c][:d])].append(c)
    for k in node:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(node, key=len, reverse=True):
        words = len(WORD.findall(k[-1][1])) if k else 0
        leaves = sum(out[x][5] for x in kids[k]) or 1
        saved = (len(node[k]) - 1) * words + sum(out[x][6] for x in kids[k])
        ends = ",".join(str(c) for c in node[k] if len(seqs[c]) == len(k))
        out[k] = (node[k][0], len(k), node[k[:-1]][0] if k else -1, len(node[k]), len(kids[k]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values())


def letters(rows, misspelt=None):
    """Counts of runs of letters, each with its letter taken out where the crc32 says so."""
    out = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if misspelt and h % misspelt == 0 else run] += 1
    return out


def one_edit(s, t):
    edits = {s[:i] + s[i + 1 :] for i in range(len(s))}
    return s != t and (t in edits or s in {t[:i] + t[i + 1 :] for i in range(len(t))} or len(s) == len(t) and sum(a != b for a, b in zip(s, t)) == 1)


def variants(rows, length, count, ratio, misspelt=None):
    n = {w: c for w, c in letters(rows, misspelt).items() if len(w) >= length and c >= count}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n[form[w]] if form[w] else -1) for w in n)
