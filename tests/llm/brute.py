"""Plain versions of the operators, straight from their definitions."""

import hashlib
import math
import re
from collections import Counter, defaultdict

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def near_duplicates(docs, percent=75, k=5):
    sets = {}
    for i, x in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def secrets(x):
    x = x or ""
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    spans = [(m.start(), 0, "assign", m.end()) for m in re.finditer(rf'({word})["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)', x) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    text = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
    return (*(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(text.encode()).hexdigest())


def contamination(docs, items, window=10):
    words = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").translate(LOW))
    windows = defaultdict(set)
    for i, x in items:
        w = words(x)
        n = min(window, len(w))
        for j in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[j : j + n])].add(str(i))
    out = {}
    for i, x in docs:
        w, hit, found = words(x), set(), set()
        for n in {len(t) for t in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found |= windows[tuple(w[j : j + n])]
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def repeats(texts, span=200):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        cover, end = bytearray(len(b)), 0
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                for j in range(max(i, end), i + span):
                    cover[j] = 1
                end = i + span
        kept = bytes(x for x, y in zip(b, cover) if not y)
        runs = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out.append((len(b), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


def licenses(rows, templates, declare, threshold=0.7, window=32):
    terms = lambda x: re.findall(r"[a-z0-9]+", (x or "").translate(LOW))
    df = Counter(t for _, _, x in rows for t in set(terms(x)))
    weigh = lambda x: {t: n * (1 + math.log((1 + len(rows)) / (1 + df[t]))) for t, n in Counter(x).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = [(name, weigh(terms(t))) for name, t in templates]

    def nearest(tokens):
        v = weigh(tokens)
        scores = [sum(v.get(t, 0) * x for t, x in k.items()) / (norm(v) * norm(k)) if v else 0 for _, k in known]
        best = max(range(len(known)), key=lambda i: (round(scores[i], 12), -i))
        return (scores[best], best) if scores[best] >= threshold else None

    own = []
    for i, path, text in rows:
        lines = [terms(x) for x in (text or "").split("\n")]
        units, blocks = [(True, [t for x in lines for t in x])] + [(False, x) for x in lines], []
        for a in range(len(lines)):
            for n in range(2, min(window, len(lines) - a) + 1):
                if all(lines[a : a + n]):
                    blocks.append((False, [t for x in lines[a : a + n] for t in x]))
        found, wide = ([(known[hit[1]][0] == "Proprietary", -round(hit[0], 9), hit[1], whole) for whole, u in us if (hit := nearest(u))] for us in (units, blocks))
        best = min(found)[:3] if found else None
        if wide and (best is None or min(wide)[:2] < best[:2]):
            best = min(wide)[:3]
        own.append((i, path, known[best[2]][0] if best else None, -best[1] if best else 0.0, any(f[3] for f in found)))
    speaks = {}
    for i, path, name, score, whole in own:
        if name and path is not None and (declare or whole or re.search(r"(?i)(^|/)(licen[cs]e|copying|unlicense)[^/]*$", path)):
            key = (-score, i is not None, i or 0, name)
            folder = path.rpartition("/")[0]
            speaks[folder] = min(speaks.get(folder, key), key)
    out = []
    for i, path, name, score, _ in own:
        told, where = name, None
        if name is None and path is not None:
            folder = path.rpartition("/")[0]
            up = [f for f in ("/".join(folder.split("/")[:k]) for k in range(len(folder.split("/")), -1, -1)) if f in speaks]
            told, where = (speaks[up[0]][3], up[0]) if up else (None, None)
        out.append((i, path, name, round(score, 6), told, where))
    return out


def hard_negatives(rows, scale, is_anchor, least=50, most=95):
    """(anchor, positive, rank, negative, scores) of rows (vec_id, vector, label), by all pairs."""
    good = [(i, c, [math.floor(scale * x) for x in v]) for i, v, c in rows if i is not None and c is not None and v and None not in v and all(map(math.isfinite, v))]
    out = []
    for a, label, v in good:
        if is_anchor(a):
            scored = sorted((-sum(x * y for x, y in zip(v, w)), i, c) for i, c, w in good if len(w) == len(v) and not (i == a and c == label))
            for p, i, _ in [s for s in scored if s[2] == label][:5]:
                fits = [s for s in scored if s[2] != label and least * -p <= 100 * -s[0] <= most * -p]
                out += [(a, i, k, n, -p, -s) for k, (s, n, _) in enumerate(fits[:3], 1)]
    return out


def fill_in_middle(doc_id, text, grammar, seed=7, percent=100, spm_percent=50):
    text = text or ""
    units = re.findall(grammar, text, re.ASCII)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, None, text, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_percent:
        return doc_id, n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}", text
