"""Edit distances over Python's integers as bit vectors, and a BK-tree over them."""

from __future__ import annotations


def masks(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(text):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def levenshtein(pattern: str, peq: dict[str, int], text: str) -> int:
    """The Levenshtein distance, a metric; peq = masks(pattern). One step per character of text."""
    m = len(pattern)
    if not m:
        return len(text)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ((ph << 1) | 1) & full
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv
    return score


def typo_distance(a: str, b: str) -> int:
    """Edits with the swap of two neighbours as one (optimal string alignment)."""
    if a == b:
        return 0
    # what both begin and end with costs nothing
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < hi - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            row.append(v)
        before, last = last, row
    return last[-1]


class BKTree:
    """Words by their distance to their parent. A query within radius r visits a child at distance e
    from a node at distance d only if |e - d| <= r: the triangle inequality excludes all others."""

    def __init__(self, words):
        self.root: list | None = None
        for w in sorted(set(words)):
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = [word, {}]
            return
        node, peq = self.root, masks(word)
        while True:
            d = levenshtein(word, peq, node[0])
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = [word, {}]
                return
            node = child

    def within(self, word: str, radius: int) -> list[tuple[int, str]]:
        """Every word at a distance of at most radius, with its distance."""
        if self.root is None:
            return []
        peq, found, stack = masks(word), [], [self.root]
        while stack:
            entry, children = stack.pop()
            d = levenshtein(word, peq, entry)
            if d <= radius:
                found.append((d, entry))
            for e, child in children.items():
                if d - radius <= e <= d + radius:
                    stack.append(child)
        return sorted(found)


class ShardedBKTree:
    """BK-trees by word length, which bounds the distance from below; the winners of the shards merge to
    the same list that one tree gives.

    A shard is asked only if it can have an answer: r edits leave one of r + 1 parts of the word intact,
    so a shard none of whose words holds any of the parts has none."""

    def __init__(self, words):
        by: dict[int, list[str]] = {}
        for w in set(words):
            by.setdefault(len(w), []).append(w)
        self.trees = {n: BKTree(own) for n, own in by.items()}
        self.parts = {n: {w[i:j] for w in own for i in range(n) for j in range(i + 1, n + 1)} for n, own in by.items()}

    def within(self, word: str, radius: int) -> list[tuple[int, str]]:
        n = len(word)
        cuts = [k * n // (radius + 1) for k in range(radius + 2)]
        parts = [word[i:j] for i, j in zip(cuts, cuts[1:])]
        found = []
        for k in range(n - radius, n + radius + 1):
            if k in self.trees and ("" in parts or not self.parts[k].isdisjoint(parts)):
                found.extend(self.trees[k].within(word, radius))
        return sorted(found)
