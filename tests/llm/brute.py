"""Plain versions of the operators, quadratic where that is simplest."""

import hashlib
import math
import re
import zlib

import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def words(text):
    return SPACE_WORD.findall(text or "")


def shingles(t, width=5):
    w = words((t or "").translate(ASCII))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_rows(rows, percent=75):
    """Component of each row where rows of one id with words are linked."""
    own = [(d, shingles(t)) for d, t in rows]
    group = list(range(len(rows)))
    for i, (a, s) in enumerate(own):
        for j, (b, t) in enumerate(own[:i]):
            both = len(s & t)
            if s and t and (a == b or (both and 100 * both >= percent * (len(s) + len(t) - both))):
                x, y = group[i], group[j]
                group = [min(x, y) if g in (x, y) else g for g in group]
    least = {g: min(own[k][0] for k in range(len(rows)) if group[k] == g) for g in group}
    return [(d, len(s), least[group[k]], least[group[k]] == d) for k, (d, s) in enumerate(own)]


def near(docs, width=5, percent=75):
    sets = {d: shingles(t, width) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            s, t = sets[a], sets[b]
            if s and t and 100 * min(len(s), len(t)) >= percent * max(len(s), len(t)):
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in ids}


def substrings(docs, width=13):
    """By id; of rows that repeat one the last."""
    return dict(zip((d for d, _ in docs), substring_rows(docs, width), strict=True))


def substring_rows(rows, width=13):
    first = {}
    split = [(d, words(t)) for d, t in rows]
    for d, w in sorted(split, key=lambda x: x[0]):
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def leaks(docs, items, width=10):
    windows = {}
    for item, t in items:
        w = BENCH_WORD.findall((t or "").translate(ASCII))
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    sizes = {len(k) for k in windows}
    out = {}
    for d, t in docs:
        w = BENCH_WORD.findall((t or "").translate(ASCII))
        hit, got = [False] * len(w), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                if (found := windows.get(tuple(w[i : i + m]))) is not None:
                    hit[i : i + m] = [True] * m
                    got |= found
        out[d] = (len(w), sum(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), any(hit))
    return out


def quality(text):
    t = text or ""
    w = words(t)
    lines = [x for x in t.split("\n") if words(x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = set()
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                hit.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def lines_kept(docs, width=3):
    first = {}
    split = {d: t.split("\n") for d, t in docs if t is not None}
    key = lambda x, i: tuple(y.rstrip(" ") for y in x[i : i + width])
    for d in sorted(split):
        for i in range(len(split[d]) - width + 1):
            first.setdefault(key(split[d], i), (d, i))
    out = {}
    for d, x in split.items():
        gone = set()
        for i in range(len(x) - width + 1):
            if "".join(key(x, i)).strip(" ") and first[key(x, i)] != (d, i):
                gone.update(range(i, i + width))
        out[d] = (len(x), len(gone), "\n".join(y for i, y in enumerate(x) if i not in gone))
    return out


def base_scores(docs):
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    split = {d: [*words((t or "").translate(ASCII)), None] for d, t in docs}
    counts = {}
    for d, w in split.items():
        if not held[d]:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return {d: (held[d], len(w), sum(x in counts for x in w), n, sum(math.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, w in split.items()}


def packed(docs, tokenizer, capacity=4096):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(tokenizer)
    out = {}
    for d, t in docs:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            out[d, p] = (s, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part)))
    return out


def tree_scores(docs, depth, least=2, discount=0.5, steps=1 << 16):
    """log10 probability of each text under a suffix tree, by plain counting of all sequences; states' scales are rounded to ``steps`` (0: not)."""
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    split = {d: (*words((t or "").translate(ASCII)), None) for d, t in docs}
    counts = {}
    for d, w in split.items():
        if not held[d]:
            for m in range(1, depth + 2):
                for i in range(len(w) - m + 1):
                    counts[w[i : i + m]] = counts.get(w[i : i + m], 0) + 1
    single = {k: c for k, c in counts.items() if len(k) == 1}
    floor = sum(single.values()) + 0.5 * (len(single) + 1)
    after = {}
    for k, c in counts.items():
        if len(k) > 1 and c >= least:
            after.setdefault(k[:-1], {})[k[-1]] = c
    states = {}

    def p(context, s):
        if not context:
            return (single.get((s,), 0) + 0.5) / floor
        parent = p(context[1:], s)
        if context not in states:
            return parent
        c = after[context].get(s)
        return (c - discount) / counts[context] if c else states[context] * parent

    for context in sorted(after, key=len):
        own, n = after[context], counts[context]
        theirs = {s: p(context[1:], s) for s in own}
        rest, rest_parent = 1 - sum(c - discount for c in own.values()) / n, 1 - min(sum(theirs.values()), 1 - 1e-9)
        left = n - sum(own.values())
        gain = sum(c * math.log(c / n / theirs[s]) for s, c in own.items()) + (left * math.log(left / n / rest_parent) if left else 0)
        if gain > len(own) * (1 + math.log(n)) / 2 + 4:
            states[context] = 10 ** (round(math.log10(rest / rest_parent) * steps) / steps) if steps else rest / rest_parent
    return {d: sum(math.log10(p(w[max(0, i - depth) : i], w[i])) for i in range(len(w))) for d, w in split.items()}, states, p, [k[0] for k in single]


def notices(text, model, templates, cues, passage):
    """Confirmed families of a text, how many passages have one, and how many with a cue are classified but not confirmed."""
    number = {g: k for k, g in enumerate(model.grams)}
    found, doubtful = [], 0
    for paragraph in re.split(r"\n[ \t\r\f]*\n", text or ""):
        w = re.findall("[a-z0-9]+", paragraph.lower())
        for start in range(0, max(1, -(-2 * len(w) // passage) - 1) * passage // 2, passage // 2):
            part = w[start : start + passage]
            own = {" ".join(part[i : i + n]) for n in (2, 3) for i in range(len(part) - n + 1)}
            p = model.probabilities([[number[g] for g in own if g in number]])[0]
            if 1 - p[-1] >= model.threshold:
                held = {f for f, all_, need, marks, need_marks in templates if len(all_ & own) >= need and len(marks & own) >= need_marks}
                found += [held] if held else []
                doubtful += not held and bool(set(part) & set(cues))
    return sorted(set().union(*found)), len(found), doubtful


def places(n, seed, rounds=4):
    """Place of each of n rows under a Feistel network with cycle walking, with Spark's xxhash64 as its round function."""
    a = math.isqrt(max(n - 1, 0)) + 1
    b = max(1, -(-n // a))
    signed = lambda h: h - (1 << 64) if h >> 63 else h

    def chain(*values):
        h = 42
        for size, v in values:
            h = xxhash.xxh64_intdigest((v % (1 << 8 * size)).to_bytes(size, "little"), seed=h)
        return signed(h)

    def once(v):
        left, right = (0, v) if a == 1 else divmod(v, b)
        for i in range(1, rounds + 1):
            left = (left + chain((4, seed), (4, i), (4, 0), (8, right)) % a) % a
            right = (right + chain((4, seed), (4, i), (4, 1), (8, left)) % b) % b
        return left * b + right

    out = []
    for x in range(n):
        v = once(x)
        while v >= n:
            v = once(v)
        out.append(v)
    return out
