"""A minimal acyclic transducer: frequent words -> token ids, in flat arrays that can be memory-mapped.

The automaton shares prefixes and suffixes. Every edge carries how many words sort before it at its state, so the sum
along a path numbers the words in order; the number is the index of the word's ids. Looking words up walks all words of
a batch at once, one byte a step.
"""

from __future__ import annotations

import numpy as np

MAGIC = 0x5A17


def build(words: dict[bytes, list[int]]) -> np.ndarray:
    """The automaton of words (incremental minimisation over the sorted words) as one int64 array."""
    ordered = sorted(words)
    register: dict[tuple, int] = {}
    edges_of: list[tuple] = []  # by final state number: ((byte, target), ...)
    final_of: list[bool] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(edges_of)
            edges_of.append(key[1])
            final_of.append(node[0])
        return state

    path: list[list] = [[False, []]]
    last = b""
    for word in ordered:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) - 1 > common:
            done = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(done)))
        for _ in range(common, len(word)):
            path.append([False, []])
        path[-1][0] = True
        last = word
    while len(path) > 1:
        done = path.pop()
        path[-1][1].append((last[len(path) - 1], freeze(done)))
    root = freeze(path[0])

    counts = [0] * len(edges_of)
    keys, targets, skips = [], [], []
    for state, edges in enumerate(edges_of):  # children are frozen before their parents
        n = int(final_of[state])
        for byte, target in edges:
            keys.append(state * 256 + byte), targets.append(target), skips.append(n)
            n += counts[target]
        counts[state] = n
    offsets = np.cumsum([0, *[len(words[w]) for w in ordered]])
    ids = [i for w in ordered for i in words[w]]
    head = [MAGIC, root, len(edges_of), len(keys), len(ordered), len(ids)]
    return np.concatenate([np.array(x, np.int64) for x in (head, final_of, keys, targets, skips, offsets, ids)])


class Lexicon:
    """A reader of build()'s array, in memory or memory-mapped."""

    def __init__(self, flat: np.ndarray):
        _, self.root, states, edges, self.n_words, ids = (int(x) for x in flat[:6])
        at = 6
        parts = []
        for size in (states, edges, edges, edges, self.n_words + 1, ids):
            parts.append(flat[at : at + size])
            at += size
        self.final, self.keys, self.targets, self.skips, self.offsets, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that the lexicon lacks."""
        out = np.full(len(words), -1, np.int64)
        if not words or not self.n_words:
            return out
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        alive = np.arange(len(words))
        state, number = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            ended = lengths[alive] == step
            done = alive[ended]
            hit = done[self.final[state[done]] == 1]
            out[hit] = number[hit]
            alive = alive[~ended]
            if not len(alive):
                break
            wanted = state[alive] * 256 + flat[starts[alive] + step]
            at = np.minimum(np.searchsorted(self.keys, wanted), max(0, len(self.keys) - 1))
            ok = self.keys[at] == wanted if len(self.keys) else np.zeros(len(alive), bool)
            alive, at = alive[ok], at[ok]
            number[alive] += self.skips[at]
            state[alive] = self.targets[at]
            step += 1
        return out

    def ids_of(self, number: int) -> np.ndarray:
        return self.ids[self.offsets[number] : self.offsets[number + 1]]
