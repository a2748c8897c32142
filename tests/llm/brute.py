"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text) if text else []


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text) if text else ""


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def secret_base(text):
    text, out = text or "", []
    for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        for m in re.finditer(pattern, text):
            if len(m[0]) >= least:
                out.append((m.start(), kind, m.end()))
    names = ("assign", "access", "hex")
    return {k: sum(x[1] == i for x in out) for i, k in enumerate(names)}, ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(out))


def quality(text):
    w, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


BENCH = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items):
    by = defaultdict(set)
    for name, text in items:
        w = BENCH.findall(ascii_lower(text))
        for i in range(max(1, len(w) - 9)) if w else ():
            by[tuple(w[i : i + 10])].update(() if name is None else (str(name),))
    sizes = {len(x) for x in by}
    out = []
    for doc, text in docs:
        w, hit, names = BENCH.findall(ascii_lower(text)), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := by.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def shingle_set(text, size):
    w = words(ascii_lower(text))
    return ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or {tuple(w)}) if w else set()


def near(docs, size, percent):
    sets = [shingle_set(t, size) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    pairs = Counter((a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :])
    for (a, b), common in pairs.items():
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            root[find(b)] = find(a)
    least = {}
    for k, (doc, _) in enumerate(docs):
        least[find(k)] = min(doc, least.get(find(k), doc))
    return [(doc, len(s), least[find(k)]) for k, ((doc, _), s) in enumerate(zip(docs, sets, strict=True))]


def dedup(docs, width=50):
    first = {}
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if doc is not None:
                first[g] = min(doc, first.get(g, doc))
    out = []
    for doc, text in docs:
        w, gone = words(text), set()
        for i in range(len(w) - width + 1):
            g = tuple(w[i : i + width])
            if doc is not None and g in first and first[g] < doc:
                gone.update(range(i, i + width))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out
