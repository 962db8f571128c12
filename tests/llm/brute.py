"""Plain versions of what the operators return."""

import re

from xxhash import xxh64_intdigest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, most=3):
    """Set number of each position."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def alike(texts):
    """Set number of each position: linked are texts with a Jaccard similarity of 0.8 or more of five-word shingles."""
    from collections import Counter, defaultdict

    every, holders, root = [], defaultdict(list), list(range(len(texts)))
    for t in texts:
        w = lower(t).encode().split()
        every.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    pairs, wordless = [], None
    for j, s in enumerate(every):
        if not s:
            wordless = j if wordless is None else wordless
            pairs.append((wordless, j))
        for i, common in Counter(i for x in s for i in holders[x]).items():
            if 5 * common >= 4 * (len(s) + len(every[i]) - common):
                pairs.append((i, j))
        for x in s:
            holders[x].append(j)
    before = None
    while root != before:
        before = list(root)
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return root


def named(keys, sets):
    """Smallest key of each position's set, nulls last."""
    best = {}
    for k, s in zip(keys, sets):
        if k is not None and (s not in best or k < best[s]):
            best[s] = k
    return [best.get(s) for s in sets]


def benchmark_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contamination(text, items, n=10):
    """``(words, hit words, items)``"""
    w, hit, owners = benchmark_words(text), set(), set()
    for item, body in items:
        b = benchmark_words(body)
        size = min(n, len(b))
        for i in range(len(b) - size + 1 if b else 0):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == b[i : i + size]:
                    hit.update(range(p, p + size))
                    if item is not None:
                        owners.add(str(item))
    return len(w), len(hit), sorted(owners)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
)


def digits(m):
    return re.sub("[^0-9]", "", m)


def pii(text):
    found = [(m.start(), k, m.end()) for k, (p, ok) in enumerate(PII) for m in re.finditer(p, text or "") if ok(m[0])]
    return sorted(found)


SECRETS = (
    (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    (r"AKIA[A-Z0-9]+", 0, 18),
    (r"[0-9a-f]+", 0, 16),
)


def secrets(text):
    found = []
    for k, (p, group, least) in enumerate(SECRETS):
        found += [(m.start(), k, m.end()) for m in re.finditer(p, text or "", re.ASCII) if len(m[group]) >= least]
    return sorted(found)


def viterbi(word, pieces, floor):
    """Best segmentation by trying every start of every end; of equal scores the longest last piece."""
    best = [(0.0, [])] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            found = pieces.get(word[start:end])
            if found is None and end - start == 1:
                found = (floor, None)
            if found is not None and best[start] is not None:
                score = best[start][0] + found[0]
                if best[end] is None or score > best[end][0]:
                    best[end] = (score, best[start][1] + [word[start:end]])
    return best[-1][1]


def words_of(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 6))) for _ in range(n))
