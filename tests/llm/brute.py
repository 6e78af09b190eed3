"""Plain restatements of the operators, a document at a time."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def groups(rows, k, percent=80):
    """(id, text) -> id -> (set size, component)."""
    sets = defaultdict(list)
    for i, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets[i].append({tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            for a in sets[i]:
                for b in sets[j]:
                    both = len(a & b)
                    if both and 100 * both >= percent * (len(a) + len(b) - both):
                        x, y = find(i), find(j)
                        up[max(x, y)] = min(x, y)
    return {i: (sorted(len(s) for s in sets[i]), find(i)) for i in ids}


def substrings(rows, window=20):
    """(id, text) with unique ids -> id -> (words, removed, kept text)."""
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for a in range(len(w) - window + 1):
            first.setdefault(tuple(w[a : a + window]), (i, a))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a : a + window])] != (i, a):
                gone.update(range(a, a + window))
        out[i] = (len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone))
    return out


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    c = Counter(tuple(w[a : a + 5]) for a in range(len(w) - 4))
    covered = {x for a in range(len(w) - 4) if c[tuple(w[a : a + 5])] > 1 for x in range(a, a + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


KINDS = [
    ("assign", re.compile(r"""((?ia:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?ia:", "(?i:")), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def secrets(text):
    """Base spans (start, rank, end, kind)."""
    out = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        out += [(m.start(), rank, m.end(), kind) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return sorted(out)


def targets(sizes, weights=(5, 2, 1), most=3):
    """source -> target by resharing the excess until none is above."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(out.values())) / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return out


def verdicts(rows):
    """(id, text, host) -> whether each row is kept, in the order of rows."""
    judged = []
    for _, text, host in rows:
        n, chars, symbols, dup, _, base = measures(text)
        lines = sum(1 for x in (text or "").split("\n") if words(x))
        soft = 10 * symbols > n or 10 * dup > 3 * lines or chars < 2 * n or chars > 15 * n
        excess = max([a / b for a, b in ((10 * symbols, n), (10 * dup, 3 * lines), (2 * n, chars), (chars, 15 * n)) if b], default=0)
        judged.append((host, base, soft, excess))
    hosts = defaultdict(lambda: [0, 0])
    for host, base, soft, _ in judged:
        hosts[host][0] += 1
        hosts[host][1] += base or soft
    rates = [f / n for n, f in hosts.values()]
    mean = sum(rates) / len(rates) if rates else 0
    var = sum((x - mean) ** 2 for x in rates) / len(rates) if rates else 0
    weight = min(1000, max(2, mean * (1 - mean) / var - 1 if var > 0 else 1000))
    rate = {h: (f + mean * weight) / (n + weight) for h, (n, f) in hosts.items()}
    return [not base and not (soft and rate[h] * excess * excess > 1 - rate[h]) for h, base, soft, excess in judged]
