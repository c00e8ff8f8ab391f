"""Plain versions of what the operators return, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


def kept_words(rows, size=35):
    texts = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + size]) for w in texts for i in range(len(w) - size + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        left = b" ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out.append((doc_id, len(w), sum(gone), hashlib.sha256(left).hexdigest()))
    return out


def kept_bytes(rows, size=100):
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - size + 1):
            part = data[i : i + size]
            if part in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(part)
        left = bytes(x for x, y in zip(data, gone, strict=True) if not y)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def fingerprint(text, size=3):
    own = [w.lower() for w in words(text)]  # bytes: A-Z only
    runs = [b" ".join(own[i : i + size]) for i in range(max(1, len(own) - size + 1))] if own else []
    ones = [0] * 64
    for run in runs:
        h = xxhash.xxh64_intdigest(run, 42)
        for i in range(64):
            ones[i] += h >> i & 1
    return sum(1 << i for i in range(64) if ones[i] * 2 > len(runs))


def components(values, near):
    """Least index reachable through near pairs, for each index."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def simhash_components(rows):
    rows = sorted(rows)
    fps = [fingerprint(t) for _, t in rows]
    root = components(fps, lambda a, b: (a ^ b).bit_count() <= 2)
    return [(d, f"{f:016x}", rows[r][0]) for (d, _), f, r in zip(rows, fps, root, strict=True)]


def shingles(text, size=5):
    own = [w.lower() for w in words(text)]
    return {tuple(own[i : i + size]) for i in range(max(1, len(own) - size + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def bag_similarity(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def leaks(docs, items, size=5):
    out = {}
    for doc_id, text in docs:
        own = [w.lower() for w in words(text)]
        for item_id, item in items:
            its = [w.lower() for w in words(item)]
            if not its or not own:
                continue
            k, n = min(size, len(its)), min(len(its), len(own))
            want = Counter(tuple(its[i : i + k]) for i in range(len(its) - k + 1))
            best = 0
            for a in range(len(own) - n + 1):
                window = own[a : a + n]
                if len(window) >= k:
                    best = max(best, bag_similarity(
                        Counter(tuple(window[i : i + k]) for i in range(len(window) - k + 1)), want))
            if best >= 0.8:
                out[doc_id, item_id] = best
    return out


def base_scores(rows):
    texts = {d: [w.lower() for w in words(t)] + [None] for d, t in rows}
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d in texts}
    counts = Counter(w for d, own in texts.items() if not held[d] for w in own)
    n, v = sum(counts.values()), len(counts)
    return {d: (held[d], len(own), sum(counts[w] > 0 for w in own), n,
                sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)) for d, own in texts.items()}


def random_rows(seed, n=40, vocabulary=400):
    """Texts with copies, near copies, shared and repeated passages, odd blanks and empties."""
    rng = np.random.default_rng(seed)
    name = [f"w{i}" if i % 7 else f"ñ{i}é" for i in range(vocabulary)]

    def text(k):
        return " ".join(name[i] for i in rng.integers(0, vocabulary, k))

    shared = [text(k) for k in (60, 45, 36, 30)]
    rows = []
    for i in range(n):
        parts = [text(rng.integers(0, 120))]
        for _ in range(rng.integers(0, 3)):
            parts += [shared[rng.integers(0, 4)], text(rng.integers(0, 30))]
        rows.append((i, ["\n", " ", "\t "][i % 3].join(parts)))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1]), (n + 2, rows[5][1] + " tail"), (n + 3, ""),
             (n + 4, None), (n + 5, " \n\t"), (n + 6, "aa " * 300), (n + 7, "x" * 500),
             (n + 8, rows[7][1].upper()), (n + 9, " ".join(shared) * 3)]
    return rows


def top_k(rows, every=50, k=5, scale=256):
    """rows: vec_id, vector; whole numbers of any size."""
    own = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows
           if v is not None and all(x is not None and math.isfinite(scale * float(x)) for x in v)]
    out = []
    for q, v in own:
        if q is None or q % every:
            continue
        found = [(max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=False)))), c)
                 for c, w in own if c is None or c != q]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(q, r, c, x) for r, (x, c) in enumerate(found[:k], 1)]
    return out


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def merkle(rows, fan=16):
    """rows: doc_id, source, lang, n_chars, text."""
    def leaf(row):
        return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))

    def lowered(text):
        return None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([digest(*below[i : i + fan]) for i in range(0, len(below), fan)])
        return levels

    sources, trees, out = defaultdict(list), {}, []
    for row in rows:
        sources[row[1]].append(row)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in sources[s]])
    top = tree([trees[s][-1][0] for s in names])
    for number, s in enumerate(names):
        for i, row in enumerate(sources[s]):
            node = own = leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = leaf((*row[:4], lowered(row[4])))
            proof = ""
            for levels, at in ((trees[s], i), (top, number)):
                for level in levels[:-1]:
                    run, j = level[at // fan * fan : at // fan * fan + fan], at % fan
                    proof += "".join(run[:j] + run[j + 1 :])
                    node = digest(*run[:j], node, *run[j + 1 :])
                    at //= fan
            root = top[-1][0]
            out.append((row[0], own, trees[s][-1][0], root, digest(proof), node, node == root))
    return out


def phrase_counts(rows):
    """Occurrences of phrases of one to five words, and of all words, by language."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", data):
            own = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(own)
            for k in range(1, 6):
                for i in range(len(own) - k + 1):
                    f[lang, tuple(own[i : i + k])] += 1
    return f, n


def collocations(rows, least=100, first=2000):
    f, n = phrase_counts(rows)
    candidates = {x for x, c in f.items() if c >= least and len(x[1]) > 1}
    inside = set()
    for lang, p in candidates:
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * f[lang, p] >= 100 * f[lang, p[i : i + k]]:
                    inside.add((lang, p[i : i + k]))
    found = defaultdict(list)
    for lang, p in candidates - inside:
        a = f[lang, p]
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        found[lang].append((-score, -a, b" ".join(p), f[lang, p[:k]], f[lang, p[k:]]))
    return [(lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, own in found.items()
            for i, (score, a, p, left, right) in enumerate(sorted(own)[:first], 1)]


def language_scores(training, texts, codebook, hashed, size, scale_to=4):
    """(language, score) of texts by the codewords' bits, one gram and one bit at a time.

    training: (text, lang); hashed: number of a text's grams, in order; size: how many numbers there are.
    """
    counts = defaultdict(Counter)
    for text, lang in training:
        counts[lang].update(hashed(text))
    langs = sorted(counts)
    code = codebook(len(langs))
    share = [[(counts[x][g] + 0.5) / (sum(counts[x].values()) + 0.5 * size) for g in range(size)] for x in langs]
    weight = []
    for bit in range(code.shape[1]):
        on, off = ([own for own, c in zip(share, code[:, bit], strict=True) if c == sign] for sign in (1, -1))
        weight.append([math.log((sum(a) / len(a)) / (sum(b) / len(b)))
                       for a, b in zip(zip(*on, strict=True), zip(*off, strict=True), strict=True)])
    margin = [[max(sum(s * w for s, w in zip(own, bit, strict=True)) * code[i][b], 1e-6) for b, bit in enumerate(weight)]
              for i, own in enumerate(share)]
    scale = scale_to / (sum(map(sum, margin)) / code.size)
    out = []
    for text in texts:
        own = hashed(text)
        sums = [sum(bit[g] for g in own) / max(len(own), 1) for bit in weight]
        loss = [sum(m / sum(margin[i]) * (max(-x * scale * c, 0) + math.log1p(math.exp(-abs(x * scale))))
                    for m, x, c in zip(margin[i], sums, code[i], strict=True)) for i in range(len(langs))]
        soft = [math.exp(-8 * (x - min(loss))) for x in loss]
        best = loss.index(min(loss))
        out.append((langs[best], soft[best] / sum(soft)))
    return out
