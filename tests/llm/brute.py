"""Plain versions of the corpus operators, written from their definitions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for i, t in items:
        if t is None:
            continue
        w = word.findall(lower(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else []:
            windows[tuple(w[k : k + n])].add(i if i is None else str(i))
    sizes = {len(k) for k in windows}
    out = []
    for d, t in docs:
        w = word.findall(lower(t))
        hit, own = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    own |= windows[g]
                    hit.update(range(k, k + n))
        out.append((d, len(w), len(hit), len(own), sha(",".join(sorted(own - {None}))), bool(hit)))
    return out


def quality_base(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        g = list(zip(w, w[1:], w[2:], strict=False))
        c = Counter(g)
        cov = {i + o for i, x in enumerate(g) if c[x] > 1 for o in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        out.append((d, len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(cov), len(w) < 50 or 100 * len(cov) > 50 * len(w)))
    return out


def simhash(docs, size=4, radius=4):
    fps = []
    for d, t in docs:
        w = WORD.findall(lower(t))
        sh = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([" ".join(w)] if w else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps.append((d, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    nodes = sorted({f for _, f in fps})
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    low = {}
    for d, f in fps:
        low[find(f)] = min(low.get(find(f), d), d)
    return [(d, f"{f:016x}", low[find(f)]) for d, f in fps]


def line_dedup(docs, min_docs=10, min_len=1):
    key = lambda x: lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x))
    n = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_len)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if n[key(x)] < min_docs]
        out.append((d, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return out


def substring_dedup(docs, k=50):
    first = {}
    rows = sorted((d, (t or "").encode()) for d, t in docs)
    out = []
    for d, b in rows:
        cut = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if first.setdefault(b[i : i + k], d) < d:
                cut[i : i + k] = b"\1" * k
        runs = len(re.findall(b"\1+", bytes(cut)))
        out.append((d, len(b), sum(cut), runs, sha(bytes(x for x, c in zip(b, cut, strict=True) if not c))))
    return out


SECRETS = [("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile("[0-9a-f]+"), 0, 32)]


def secrets(docs):
    out = []
    for d, t in docs:
        spans, n = [], []
        for rank, (kind, rule, group, least) in enumerate(SECRETS):
            own = [(m.start(), rank, m.end(), kind) for m in rule.finditer(t or "") if len(m.group(group)) >= least]
            n.append(len(own))
            spans += own
        out.append((d, *n, sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(spans)))))
    return out


def water_fill(sizes, weights, share=1.5, cap=2.0):
    """Targets by repeated resharing, not by the closed form."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        t = budget / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * t > cap * sizes[s]}
        if not over:
            return full | {s: w[s] * t for s in open_}
        for s in over:
            full[s] = cap * sizes[s]
            budget -= full[s]
        open_ -= over
    return full


def warc(pages):
    best = {}
    data = [(p, (h or "").encode()) for p, _, h in pages]
    for p, b in data:
        if len(b) >= 1000:
            best[b] = max(best.get(b, p), p)
    return [(p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if best.get(b, p) != p else "response", best[b] if best.get(b, p) != p else None) for p, b in data]
