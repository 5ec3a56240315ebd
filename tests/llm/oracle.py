"""Plain versions of the search operators and of fill-in-middle, straight from their definitions."""

import hashlib
import math
import re
from collections import Counter


def best_products(rows, k):
    """(query, rank, id, score) by comparing every query row with every other row, in whole numbers."""
    whole = []
    for key, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((key, [math.floor(256 * x) if abs(x) < 2**50 else int(256 * x) for x in v]))
    out = []
    for i, (key, q) in enumerate(whole):
        if key is None or key % 50:
            continue
        found = []
        for j, (other, v) in enumerate(whole):
            if i != j and len(q) == len(v):
                found.append((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v)))), other is None, other))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(key, rank, other, -score) for rank, (score, _, other) in enumerate(found[:k], 1)]
    return sorted(out, key=repr) if any(r[2] is None for r in out) else sorted(out)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k):
    held = [(key, Counter(terms(t))) for key, t in docs]
    held = [(key, c) for key, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in sorted({(i, t) for i, t, *_ in items}, key=repr):
        scores = []
        for key, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(weight[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)] if n_docs else []
    return sorted(map(repr, out))


def cut_text(key, text, seed, fim_rate, spm_rate):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    drawn = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(drawn[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_rate:
        return (key, len(units), "plain", None, None, text, text)
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return (key, len(units), form, len(prefix), len(middle), output, text)
