"""Plain Python versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)


def words(text):
    return WORD.findall(text or "")


def secrets(text):
    """Counts a kind, and the listed spans."""
    text = text or ""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    n = Counter(s[2] for s in spans)
    listed = ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))
    return n["assign"], n["access"], n["hex"], hashlib.sha256(listed.encode()).hexdigest(), listed


def sizes(text):
    return (len(text.encode()) if text is not None else 0) + 1, zlib.crc32((text or "").encode())


def substrings(rows, window=20):
    """(n_words, n_removed, kept_sha256) of each (doc_id, text), in order;
    None orders last, equal ids as they are listed."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    seen, out = set(), [None] * len(rows)
    for k in order:
        ws = words(rows[k][1])
        gone = [False] * len(ws)
        for i in range(len(ws) - window + 1):
            key = tuple(ws[i:i + window])
            if key in seen:
                gone[i:i + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out[k] = (len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def measures(text):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(ws[i:i + 5]) for i in range(len(ws) - 4))
    inside = set()
    for i in range(len(ws) - 4):
        if grams[tuple(ws[i:i + 5])] > 1:
            inside.update(range(i, i + 5))
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(n - 1 for n in Counter(lines).values()), len(inside))


def base_failed(text):
    n_words, _, _, _, n_repeat = measures(text)
    return n_words < 10 or 100 * n_repeat > 20 * n_words


def targets(size_of):
    """Target of each source of {source: size}."""
    order = sorted((s for s in size_of if s is not None), key=lambda s: [ord(c) for c in s])
    order += [None] * (None in size_of)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    out, total = {}, sum(size_of.values())
    while True:
        left = total - sum(out.values())
        open_ = [s for s in order if s not in out]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if weight[s] * level > 3 * size_of[s]]
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 3.0 * size_of[s] for s in full}


def shingles(text, k=5):
    """Occurrence-labelled runs of k words, in order."""
    ws, seen, out = words(text), Counter(), []
    runs = [tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)] if len(ws) >= k else [tuple(ws)] * bool(ws)
    for run in runs:
        out.append((run, seen[run]))
        seen[run] += 1
    return out


def alignment(a, b):
    """m / (a + b - m) for the longest common subsequence of m labelled shingles."""
    x, y = shingles(a), shingles(b)
    row = [0] * (len(y) + 1)
    for s in x:
        before = row[:]
        for j, t in enumerate(y, 1):
            row[j] = before[j - 1] + 1 if s == t else max(before[j], row[j - 1])
    return row[-1] / (len(x) + len(y) - row[-1]) if x and y else 0.0


def near_groups(rows, least=0.8):
    """Smallest id of each (doc_id, text)'s group; None for blank texts."""
    texts = sorted({t for _, t in rows if words(t)})
    sets = {t: set(shingles(t)) for t in texts}
    parent = {t: t for t in texts}

    def top(t):
        while parent[t] != t:
            t = parent[t]
        return t

    links = set()
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared >= least * (len(sets[a]) + len(sets[b]) - shared) and alignment(a, b) >= least:
                links.add((a, b))
                parent[top(a)] = top(b)
    groups = {}
    for i, t in rows:
        if words(t) and i is not None:
            groups[top(t)] = min(i, groups.get(top(t), i))
    return [groups.get(top(t)) if words(t) else None for _, t in rows], links


def plain_words(text):
    return [w for w in re.split("[^a-z0-9\u0080-\U0010ffff]+", (text or "").lower()) if w]


def leaks(docs, benchmark, span=13, substituted=2, least=9):
    """(doc_id, item_id) of contaminated documents, over all diagonals."""
    items = {}
    for i, t in benchmark:
        ws = tuple(plain_words(t))
        if len(ws) >= least:
            items[ws] = min(i, items.get(ws, i))
    out = set()
    for d, t in docs:
        ws = plain_words(t)
        for item, i in items.items():
            n = min(span, len(item))
            for shift in range(-len(item), len(ws) + 1):
                agree = [0 <= shift + j < len(ws) and ws[shift + j] == w for j, w in enumerate(item)]
                if any(sum(agree[s:s + n]) >= n - substituted for s in range(len(item) - n + 1)):
                    out.add((d, i))
                    break
    return out
