"""A bounded block of short texts, searched for those similar to a text without asking the sequence ratio of each.

The words' postings give the overlaps of all texts at once. The ratio is 2 * M / (la + lb), where the M matched
characters are a common subsequence. So lengths bound it, then the characters that both texts have as often, then the length of the
longest common subsequence, which bit-parallel rows count for many texts together. Only texts whose bound may still decide are
compared, those of the highest bound first.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np

#: Score of a text that holds the other.
CONTAINED = 0.8
#: Characters that are counted apart; the others are counted together, which only loosens the bound.
COUNTED = 64
#: Texts of more characters have no subsequence bound, and a step of it takes so many characters of all texts.
LONG, STEP = 512, 1 << 21
#: Ratios that are asked before the bound is looked at again.
ASKED = 32


class TextBlock:
    """texts: distinct normal texts, in order. Indexes below are places in it."""

    def __init__(self, texts: list[str], ratio: bool = True) -> None:
        self.texts, self.ratio = texts, ratio
        self.length = np.array([len(t) for t in texts], np.int64)
        self.place = {t: i for i, t in enumerate(texts)}
        postings = defaultdict(list)
        self.n_words = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            words = set(t.split(" ")) - {""}
            self.n_words[i] = len(words)
            for w in words:
                postings[w].append(i)
        self.postings = {w: np.array(at) for w, at in postings.items()}
        chars = Counter(c for t in texts for c in t)
        self.code = {c: i for i, (c, _) in enumerate(chars.most_common())}
        flat = np.fromiter((self.code[c] for t in texts for c in t), np.int32, int(self.length.sum()))
        ends = np.cumsum(self.length)
        row = np.repeat(np.arange(len(texts)), self.length)
        self.counts = np.bincount(row * (COUNTED + 1) + np.minimum(flat, COUNTED), minlength=len(texts) * (COUNTED + 1)).reshape(-1, COUNTED + 1).astype(np.int32)
        self.flat, self.starts = flat, ends - self.length
        self.matcher = lru_cache(maxsize=2048)(lambda i: SequenceMatcher(None, "", self.texts[i]))

    def native(self, a: str, containment: bool) -> np.ndarray:
        """The similarity of each text to a without the ratio."""
        words = set(a.split(" ")) - {""}
        score = np.zeros(len(self.texts))
        for w in words & self.postings.keys():
            score[self.postings[w]] += 1
        score /= np.maximum(np.maximum(self.n_words, len(words)), 1)
        if containment:
            mine = self._counts(a)
            for i in np.flatnonzero((self.counts <= mine).all(axis=1) | (self.counts >= mine).all(axis=1)):
                if self.texts[i] in a or a in self.texts[i]:
                    score[i] = max(score[i], CONTAINED)
        if a in self.place:
            score[self.place[a]] = 1.0
        return score

    def bounds(self, a: str, native: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the texts whose ratio may reach floor and exceed native, and a bound of each one's ratio."""
        none = np.zeros(0, np.int64), np.zeros(0)
        if not self.ratio or not a:
            return none
        total = self.length + len(a)
        shared = 2.0 * np.minimum(self.length, len(a)) / total
        some = np.flatnonzero((shared >= floor) & (shared > native))
        shared = 2.0 * np.minimum(self.counts[some], self._counts(a)).sum(axis=1) / total[some]
        keep = (shared >= floor) & (shared > native[some])
        some, shared = some[keep], shared[keep]
        if len(a) <= LONG:
            short = self.length[some] <= LONG
            shared[short] = 2.0 * self._subsequence(a, some[short]) / total[some[short]]
        keep = (shared >= floor) & (shared > native[some])
        return some[keep], shared[keep]

    def ask(self, a: str, i: int) -> float:
        """SequenceMatcher(None, a, text i).ratio()."""
        matcher = self.matcher(int(i))
        matcher.set_seq1(a)
        return matcher.ratio()

    def best(self, a: str, floor: float, k: int, containment: bool) -> list[tuple[int, float]]:
        """The k texts of the highest score of floor or more, the first of equal ones."""
        score = self.native(a, containment)
        some, bound = self.bounds(a, score, floor)
        order = np.lexsort((some, -bound))
        some, bound = some[order], bound[order]
        at = 0
        while at < len(some):
            least = max(floor, np.partition(score, -k)[-k]) if k <= len(score) else floor
            if bound[at] < least:
                break
            for i in some[at : at + ASKED]:
                score[i] = max(score[i], self.ask(a, i))
            at += ASKED
        found = np.flatnonzero(score >= floor)
        return [(int(i), float(score[i])) for i in found[np.lexsort((found, -score[found]))][:k]]

    def first(self, a: str, floor: float) -> int | None:
        """The first text whose score reaches floor."""
        native = self.native(a, False)
        some, _ = self.bounds(a, native, floor)
        hit = np.flatnonzero(native >= floor)
        last = int(hit[0]) if len(hit) else None
        return next((int(i) for i in some if (last is None or i < last) and self.ask(a, i) >= floor), last)

    def every(self, a: str, floor: float, below: int) -> list[int]:
        """All texts of an index smaller than below whose score reaches floor."""
        native = self.native(a, False)
        native[below:] = -1
        some, _ = self.bounds(a, native, floor)
        hit = native >= floor
        for i in some:
            if i < below and not hit[i]:
                hit[i] = self.ask(a, i) >= floor
        return np.flatnonzero(hit).tolist()

    def _counts(self, a: str) -> np.ndarray:
        out = np.zeros(COUNTED + 1, np.int32)
        for c in a:
            out[min(self.code.get(c, COUNTED), COUNTED)] += 1
        return out

    def _subsequence(self, a: str, some: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of a and the texts, 64 characters of a in each machine word."""
        words = -(-len(a) // 64)
        masks = np.zeros((words, len(self.code) + 1), np.uint64)  # the last is that of no character
        for j, c in enumerate(a):
            if c in self.code:
                masks[j // 64, self.code[c]] |= np.uint64(1 << (j % 64))
        out = np.zeros(len(some), np.int64)
        order = np.argsort(self.length[some], kind="stable")
        width = np.maximum(self.length[some][order], 1)
        at = 0
        while at < len(order):
            n = max(1, int(np.searchsorted(width[at:] * np.arange(1, len(width) - at + 1), STEP, side="right")))
            part = order[at : at + n]
            out[part] = self._rows(masks, some[part], len(a))
            at += n
        return out

    def _rows(self, masks: np.ndarray, some: np.ndarray, size: int) -> np.ndarray:
        length, words = self.length[some], len(masks)
        j = np.arange(length.max(initial=0))[:, None]
        inside = j < length[None]
        codes = np.where(inside, self.flat[np.minimum(self.starts[some][None] + j, max(len(self.flat) - 1, 0))], len(self.code))
        rows = np.full((words, len(some)), np.iinfo(np.uint64).max, np.uint64)
        for column in codes:
            carry = np.zeros(len(some), np.uint64)
            for w in range(words):
                v = rows[w]
                u = v & masks[w, column]
                s = v + u
                over = s < v
                s += carry
                carry = (over | (s < carry)).astype(np.uint64)
                rows[w] = s | (v - u)
        last = np.full(words, np.iinfo(np.uint64).max, np.uint64)
        if size % 64:
            last[-1] = np.uint64((1 << (size % 64)) - 1)
        return np.bitwise_count(~rows & last[:, None]).astype(np.int64).sum(axis=0)
