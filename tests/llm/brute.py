"""Plain single-process versions of the operators that SQL cannot express, for small fixtures."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations

END = object()


def fold(doc_id, folds):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % folds


def turing(counts, top=5):
    n = Counter(counts.values())
    large = (top + 1) * n[top + 1] / n[1] if n[1] else 1.0

    def star(c):
        if c > top:
            return c - 0.5
        share = 0.0
        if n[c] and large != 1.0:
            share = ((c + 1) * n[c + 1] / n[c] / c - large) / (1 - large)
        return c * share if 0 < share < 1 else c - 0.5

    return star


class Katz:
    """The model of katz_lm, straight from its definition."""

    def __init__(self, texts):
        self.words, self.pairs, self.after = Counter(), Counter(), defaultdict(Counter)
        for text in texts:
            before = None
            for token in self.tokens(text):
                self.words[token] += 1
                self.pairs[before, token] += 1
                self.after[before][token] += 1
                before = token
        self.n = sum(self.words.values())
        self.star1, self.star2 = turing(self.words), turing(self.pairs)
        self.unknown = 1 - sum(map(self.star1, self.words.values())) / self.n if self.n else 1.0

    @staticmethod
    def tokens(text):
        return [*(text or "").encode().lower().split(), END]

    def single(self, word):
        return self.star1(self.words[word]) / self.n if word in self.words else self.unknown

    def chance(self, word, before):
        seen = self.after.get(before)
        if not seen:
            return self.single(word)
        total = sum(seen.values())
        if word in seen:
            return self.star2(seen[word]) / total
        left = 1 - sum(self.star2(c) for c in seen.values()) / total
        return left / (1 - sum(self.single(w) for w in seen)) * self.single(word)

    def score(self, text):
        total, before = 0.0, None
        for token in self.tokens(text):
            total += math.log10(self.chance(token, before))
            before = token
        return total

    def base(self, text):
        return sum(math.log10((self.words[t] + 0.5) / (self.n + 0.5 * (len(self.words) + 1))) for t in self.tokens(text))


def shingles(text, size=3):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    size = min(size, len(words))
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def near_components(texts, threshold=85, size=3):
    """Smallest reachable id by exact similarity of all pairs; texts: id -> text."""
    sets, parent = {k: shingles(t, size) for k, t in texts.items()}, {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= threshold * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= threshold * (len(x) + len(y) - both):
                a, b = root(a), root(b)
                parent[max(a, b)] = min(a, b)
    return {k: root(k) for k in texts}, {k: len(s) for k, s in sets.items()}
