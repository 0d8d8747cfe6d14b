"""Names of one document by the words they hold: lists of names that share words are looked up, not copied."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np

#: Names of a word up to which they are compared one by one; the lists of more frequent words are counted once for each set of them.
FEW = 64


def words(text: str | None) -> frozenset[str]:
    """Words in lower case, the empty one of a blank text, none of a missing one."""
    if text is None:
        return frozenset()
    return frozenset(text.lower().split()) or frozenset(("",))


class Names:
    """A list is what shares a word with one of two ends; names have numbers that grow from many words to few, then by name."""

    def __init__(self, names: Iterable[str]) -> None:
        size = lambda n: len(set(n.lower().split()))
        self.known = frozenset(names)
        self.names = sorted(self.known, key=lambda n: (-size(n), n))
        self.words = [words(n) for n in self.names]
        held = defaultdict(list)
        for i, ws in enumerate(self.words):
            for w in ws:
                held[w].append(i)
        self.held = dict(held)
        self.counted: dict[frozenset[str], tuple[int, int]] = {}

    def listed(self, a: str | None, b: str | None) -> list[str]:
        """The names that share a word with one of the ends, in order."""
        return sorted({self.names[i] for w in words(a) | words(b) for i in self.held.get(w, ())})

    def nearest(self, end: str | None, other: str | None) -> str | None:
        """Of the names listed for two ends the one that shares most words with `end`, of these the one of fewest words, then the last; `end` itself without any."""
        if end is None:
            return None
        own = words(end)
        frequent = frozenset(w for w in own if len(self.held.get(w, ())) > FEW)
        best = self._of_frequent(frequent) if frequent else (0, -1)
        for w in own - frequent:
            for i in self.held.get(w, ()):
                best = max(best, (len(self.words[i] & own), i))
        if best[0]:
            return self.names[best[1]]
        last = max((self.held[w][-1] for w in words(other) if w in self.held), default=None)
        return end if last is None else self.names[last]

    def _of_frequent(self, ws: frozenset[str]) -> tuple[int, int]:
        """The most of these words that a name holds, and the last such name; names that hold rarer words of the end too are compared apart."""
        if ws not in self.counted:
            ids, n = np.unique(np.concatenate([self.held[w] for w in ws]), return_counts=True)
            self.counted[ws] = (int(n.max()), int(ids[n == n.max()][-1]))
        return self.counted[ws]
