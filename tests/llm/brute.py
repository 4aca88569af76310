"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def kept_lines(docs: list[tuple]) -> list[tuple]:
    """(doc_id, text) -> (doc_id, all lines, kept lines)."""
    key = lambda x: x.strip("\t\n\x0b\f\r ").translate(UP)
    top = float("inf")
    held = defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held[key(x)].add(top if i is None else i)
    out = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        out.append((i, all_, [x for x in all_ if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == (top if i is None else i)]))
    return out


def lines(docs: list[tuple]) -> list[tuple]:
    return [(i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()) for i, all_, kept in kept_lines(docs)]


def fingerprint(text: str | None) -> int:
    words = WORD.findall((text or "").translate(UP))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs: list[tuple], budget: int = 2) -> list[tuple]:
    prints = [fingerprint(t) for _, t in docs]
    own = sorted(set(prints))
    parent = {p: p for p in own}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for k, a in enumerate(own):
        for b in own[k + 1 :]:
            if (a ^ b).bit_count() <= budget:
                parent[root(b)] = root(a)
    least = {}
    for (i, _), p in zip(docs, prints):
        least[root(p)] = min(least.get(root(p), i), i)
    return [(i, f"{p:016x}", least[root(p)]) for (i, _), p in zip(docs, prints)]


def base_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    t = text or ""

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = lambda p, ok: [m.span() for m in re.finditer(p, t) if ok(m)]
    return {
        "email": found(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": found(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": found(r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": found(r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    }


def base_row(text: str | None) -> tuple:
    s = base_spans(text)
    joined = ",".join(f"{k}:{a}:{b}" for k, v in s.items() for a, b in v)
    return (*map(len, s.values()), hashlib.sha256(joined.encode()).hexdigest())


def quality(text: str | None) -> tuple:
    t = text or ""
    words = WORD.findall(t)
    rows = [x for x in t.split("\n") if WORD.search(x)]
    win = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    cover = {k + o for k in range(len(words) - 4) if win[tuple(words[k : k + 5])] > 1 for o in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(rows) - len(set(rows)), len(cover)


def lm_base(docs: list[tuple]) -> dict:
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*WORD.findall((t or "").translate(UP)), None]
    c = Counter(w for i, t in docs if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (held(i), len(w := tokens(t)), sum(c[x] > 0 for x in w), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in w)) for i, t in docs}


def spellings(word: bytes, weights: dict[bytes, float]) -> float:
    """Sum over all segmentations, by recursion over the first piece."""
    text = b" " + word
    memo = {len(text): 1.0}
    for i in range(len(text) - 1, -1, -1):
        memo[i] = sum(10 ** weights[text[i:j]] * memo[j] for j in range(i + 1, len(text) + 1) if text[i:j] in weights)
    return log10(memo[0])


def quality_kept(docs: list[tuple]) -> set:
    """(doc_id, text, lang, source, ...) -> the ids that the rules keep."""
    whole, groups, rows = defaultdict(list), defaultdict(lambda: defaultdict(list)), []
    for d in docs:
        n, chars, symbols, dup, repeat = quality(d[1])
        n_lines = sum(bool(WORD.search(x)) for x in (d[1] or "").split("\n"))
        share = lambda a, b: a // b if b else 0
        v = (share(10 * chars, n), share(1000 * symbols, chars), share(1000 * dup, n_lines), share(1000 * repeat, n))
        rows.append((d[0], d[2:4], v, n < 10 or 100 * repeat > 20 * n))
        for k, x in enumerate(v):
            x -= x % 10 ** max(len(str(x)) - 3, 0)
            whole[k].append(x)
            groups[d[2:4]][k].append(x)
    quarter = lambda xs, q: sorted(xs)[-(-len(xs) * q // 4) - 1]
    out = set()
    for i, g, v, failed in rows:
        fits = not failed
        for k, (up, down) in enumerate(((60, 15), (100, None), (300, None), (150, None))):
            n = len(groups[g][k])
            q1, q2, q3 = ((n * quarter(groups[g][k], q) + 200 * quarter(whole[k], q)) // (n + 200) for q in (1, 2, 3))
            fits &= v[k] <= max(q3 + 4 * (q3 - q1), q2 + up) and (down is None or v[k] >= min(q1 - 4 * (q3 - q1), q2 - down))
        if fits:
            out.add(i)
    return out


def copies(docs: list[tuple]) -> dict:
    """(doc_id, text, lang, source, ...) -> how often the mix takes each id."""
    sizes = defaultdict(int)
    for d in docs:
        sizes[d[3]] += len(WORD.findall(d[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    out = {}
    for d in docs:
        rate = target[d[3]] / sizes[d[3]] if sizes[d[3]] else 0.0
        u = int(hashlib.md5(f"8:{d[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[d[0]] = int(rate) + (u < rate - int(rate))
    return out


def near_kept(docs: list[tuple]) -> list[int]:
    """(doc_id, text, ...) by all pairs: the least id of each component of five-word Jaccard similarity >= 0.8."""

    def shingle_set(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()

    sets, root = [shingle_set(d[1]) for d in docs], list(range(len(docs)))

    def up(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[up(i)] = up(j)
    least = {}
    for i, d in enumerate(docs):
        least[up(i)] = min(least.get(up(i), d[0]), d[0])
    return sorted(least.values())


def lm_scores(docs: list[tuple], path: str, spelt: list, discount: float = 0.75) -> dict:
    """The marginal: each word's own arc and all its spellings, by recursion over the first piece.
    ``spelt``: the bytes of each piece of the vocabulary, None for those left out."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    words = lambda t: [w.encode() for w in WORD.findall((t or "").translate(UP))]
    c = Counter(w for i, t in docs if not held(i) for w in words(t))
    ends = sum(not held(i) for i, _ in docs)
    uses = Counter()
    for w, n in c.items():
        for k in sp.encode(w.decode()):
            uses[k] += n
    mass = defaultdict(float)
    for k, b in enumerate(spelt):
        if b is not None:
            mass[b] += uses[k] + 1.0
    for byte in range(256):
        mass[bytes([byte])] += 0.0 if bytes([byte]) in mass else 1.0
    whole = sum(mass.values())
    weights = {b: log10(m / whole) for b, m in mass.items()}
    total, kinds = sum(c.values()) + ends, len(c) + (ends > 0)
    freed = discount * kinds / total if total else 1.0
    memo = {}

    def word(w):
        if w not in memo:
            memo[w] = log10((max(c[w] - discount, 0) / total if total else 0) + freed * 10 ** spellings(w, weights))
        return memo[w]

    end = log10((ends - discount) / total if ends else freed)
    return {i: sum(map(word, words(t))) + end for i, t in docs}


def shards(docs: list[tuple], n: int = 8, seed: int = 7) -> dict:
    """(doc_id, text, lang, source, ...) -> doc_id: (shard, slot), by sorting."""
    import struct

    rows = []
    for d in docs:
        crc, h = zlib.crc32((d[1] or "").encode()), xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
        for v in (d[0], crc):
            h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
        rows.append(((d[3] is None, d[3] or ""), h, d[0]))
    by = defaultdict(list)
    for source, h, i in rows:
        by[source].append((h, i))
    order = sorted(((k + 0.5) / len(v), *source, k, i) for source, v in by.items() for k, (_, i) in enumerate(sorted(v)))
    out, seen = {}, Counter()
    for at, (*_, i) in enumerate(order):
        s = at * n // len(order)
        out[i] = (s, seen[s])
        seen[s] += 1
    return out
