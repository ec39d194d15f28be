"""Plain versions of the operators' contracts, from their definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

SPACED = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def substring(docs, size=13):
    """docs: (doc_id, text) with distinct ids."""
    words, first = {d: SPACED.findall((t or "").encode()) for d, t in docs}, {}
    for d, w in words.items():
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone.update(range(i, i + size))
        out[d] = (len(w), len(gone), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def suffix(docs, size=100):
    first, out = {}, {}
    texts = {d: (t or "").encode() for d, t in docs}
    for d in sorted(texts):
        for i in range(len(texts[d]) - size + 1):
            first.setdefault(texts[d][i : i + size], (d, i))
    for d, b in texts.items():
        gone, reach = bytearray(len(b)), 0
        for i in range(len(b) - size + 1):
            if first[b[i : i + size]] != (d, i):
                low = max(i, reach)
                reach = i + size
                gone[low:reach] = b"\1" * (reach - low)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept))
    return out


def near(docs, size=3, percent=85):
    sets = {}
    for d, t in docs:
        w = SPACED.findall(lower(t))
        sets[d] = frozenset([tuple(w)] if 0 < len(w) < size else [tuple(w[i : i + size]) for i in range(len(w) - size + 1)])
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            having[x].append(d)
    for d, s in sets.items():
        for e, both in Counter(e for x in s for e in having[x] if e < d).items():
            if 100 * both >= percent * (len(s) + len(sets[e]) - both):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), find(d), find(d) == d) for d, s in sets.items()}


def leaks(docs, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[k : k + size])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = ALNUM.findall(lower(t)), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                k = tuple(w[i : i + n])
                if k in windows:
                    found |= windows[k]
                    hit.update(range(i, i + n))
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit))
    return out


KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def _luhn(digits):
    doubled = "".join(str(int(c) * (1 + i % 2)) if i % 2 == 0 or int(c) < 5 else str(int(c) * 2 - 9) for i, c in enumerate(reversed(digits)))
    return sum(map(int, doubled)) % 10 == 0


def private(text):
    spans = []
    for k, (kind, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            spans.append((m.start(), k, m.end()))
    return ",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in sorted(spans))


def variants(docs):
    """word -> (form, root, n, n_near, form_n)."""
    counts = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def edits(w):
        letters = sorted({c for x in counts for c in x})
        for i in range(len(w) + 1):
            yield from (w[:i] + c + w[i:] for c in letters)
            if i < len(w):
                yield w[:i] + w[i + 1 :]
                yield from (w[:i] + c + w[i + 1 :] for c in letters)

    near = {w: {v for v in edits(w) if v in counts and v != w} for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), counts.get(form[w]))
    return out


def phrases(rows, min_count=100, top=2000):
    """rows: (lang, text); sorted (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {g: a for g, a in f.items() if a >= min_count}
    inside = defaultdict(int)
    for g, a in f.items():
        w = g[1:]
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[g[0], *w[i : i + k]] = max(inside[g[0], *w[i : i + k]], a)
    out = defaultdict(list)
    for g, a in f.items():
        if len(g) > 2 and inside[g] < a:
            cuts = ((f[g[:k]], f[g[0], *g[k:]]) for k in range(2, len(g)))
            score, k, l, r = min((1000 * a * n[g[0]] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
            out[g[0]].append((-score, -a, b" ".join(g[1:]), l, r))
    return sorted(
        (lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])
    )
