"""Plain Python versions of the operators, by definition and without their methods."""

import hashlib
import json
import re
import unicodedata

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def least(nodes, links):
    """node -> least node reachable."""
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text, k=3):
    words = WORD.findall((text or "").translate(LOW))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs):
    """docs: (id, text); id -> (fingerprint, component)."""
    prints = {i: fingerprint(t) for i, t in docs}
    ids = sorted(prints)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 2]
    root = least(ids, links)
    return {i: (prints[i], root[i]) for i in ids}


def line_dedup(docs, least_docs=2, chars=10):
    """docs: (id, text); list of (id, text, lines, dropped)."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = {}
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= chars and i is not None:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held.get(key(x), ())) < least_docs or min(held[key(x)]) == i]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def targets(sizes, weights=(5, 2, 1), limit=3):
    """sizes: source -> size; source -> target, by resharing the excess until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    fixed, open_ = {}, list(order)
    while open_:
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > limit * sizes[s] * (1 + 1e-12)]
        if not over:
            return fixed | share
        fixed |= {s: float(limit * sizes[s]) for s in over}
        open_ = [s for s in open_ if s not in fixed]
    return fixed


def chance(doc_id, text, seed="mix-1"):
    key = str(doc_id) if doc_id is not None else "text:" + hashlib.md5((text or "").encode()).hexdigest()
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:12], 16) / 2**48


def mix(docs):
    """docs: (id, source, text); list of (id, size, source_size, target, copies)."""
    sized = [(i, s, t, len(WORD.findall(t or ""))) for i, s, t in docs]
    total = {}
    for _, s, _, n in sized:
        total[s] = total.get(s, 0) + n
    aim = targets(total)
    out = []
    for i, s, t, n in sized:
        rate = aim[s] / total[s] if total[s] else 0.0
        out.append((i, n, total[s], aim[s], int(rate) + (chance(i, t) < rate - int(rate))))
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    """(start, kind, end, value) of the fixed kinds."""
    text = text or ""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    covered = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def _signed(h):
    return h - (1 << 64) if h >> 63 else h


def grams(text, count):
    """Buckets of the one- and two-token n-grams."""
    import regex

    tokens = [xxhash.xxh64_intdigest(t.encode(), 42) for t in regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+", text or "")]
    one = [_signed(h) % count for h in tokens]
    two = [_signed(xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))) % count for a, b in zip(tokens, tokens[1:])]  # noqa: B905
    return one + two


def quality(docs, trusted, count, threshold):
    """docs: (id, text); list of (id, score, kept)."""
    every, good = np.zeros(count), np.zeros(count)
    for i, t in docs:
        g = np.bincount(grams(t, count), minlength=count)
        every += g
        good += g if i in trusted else 0
    ratio = np.log((good + 1) / (good.sum() + count)) - np.log((every + 1) / (every.sum() + count)) if good.sum() else np.zeros(count)
    out = []
    for i, t in docs:
        g = grams(t, count)
        score = float(ratio[g].mean()) if g else 0.0
        out.append((i, score, not base_counts(t)[-1] and score >= threshold))
    return out


def held_out(i):
    return int(hashlib.md5(f"held:{i}".encode()).hexdigest()[:8], 16) % 5 == 0


def best_cut(scores):
    """(score, good) pairs; the middle of the widest of the gaps that tell both kinds apart best."""
    good, poor = [s for s, g in scores if g], [s for s, g in scores if not g]
    values, found = sorted({s for s, _ in scores}), []
    for a, b in zip(values, values[1:]):  # noqa: B905
        told = sum(s <= a for s in poor) / len(poor) - sum(s <= a for s in good) / len(good) if good and poor else None
        found += [(round(told, 12), b - a, (a + b) / 2)] if told is not None else []
    return max(found)[2] if found else None


def embedding_links(rows, threshold=0.93):
    """rows: (id, label, vector); id -> (links, component)."""
    good = {}
    for i, label, v in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = (label, x / np.abs(x).max())
    ids, links = sorted(good), []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            (la, x), (lb, y) = good[a], good[b]
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links.append((a, b))
    every = [r[0] for r in rows]
    root = least(every, links)
    return {i: (sum(i in link for link in links), root[i]) for i in every}


class Tokenizer:
    """The greedy definition: merge the pair of lowest rank, leftmost first, until none is left."""

    def __init__(self, path):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        self.vocab, self.rank = spec["model"]["vocab"], {tuple(m): r for r, m in enumerate(spec["model"]["merges"])}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in kept]
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(other)}

    def encode(self, text):
        out = []
        text = re.sub(r"\s+", " ", unicodedata.normalize("NFC", text or "")).lower()
        for word in self.pattern.findall(text):
            symbols = [self.letters[b] for b in word.encode()]
            symbols[-1] += "</w>"
            while len(symbols) > 1:
                rank, i = min((self.rank.get(p, 1 << 40), i) for i, p in enumerate(zip(symbols, symbols[1:])))  # noqa: B905
                if rank == 1 << 40:
                    break
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            out += [self.vocab[s] for s in symbols]
        return out
