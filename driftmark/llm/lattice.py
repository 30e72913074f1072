"""Segmentation lattices of many words at once: which pieces of a vocabulary fit where.

Words of one length form a matrix of code points. A trie over the pieces, kept as one sorted array of
(state, code point) keys, is walked for all words together from every starting position; what has left
the trie drops out. :func:`arcs` hands out one group of arcs per (start, length), in the order in which
forward recursions need them.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_CODE = 21  # bits of a code point


class Trie:
    """Pieces as a trie; ``piece[state]`` is the index of the piece that ends there, or -1."""

    def __init__(self, pieces: Sequence[str]) -> None:
        states: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        for i, piece in enumerate(pieces):
            at = 0
            for char in piece:
                at = states.setdefault((at, char), len(states) + 1)
            ends[at] = i
        order = sorted(states.items(), key=lambda x: (x[0][0], ord(x[0][1])))
        self.keys = np.array([(s << _CODE) | ord(c) for (s, c), _ in order] + [np.iinfo(np.int64).max], np.int64)
        self.next = np.array([to for _, to in order] + [0], np.int64)
        self.piece = np.full(len(states) + 1, -1, np.int64)
        for at, i in ends.items():
            self.piece[at] = i
        # the first step, taken from every position of every word, by direct look-up
        self.first = np.zeros(1 << 16, np.int64)
        for (state, char), to in states.items():
            if not state and ord(char) < len(self.first):
                self.first[ord(char)] = to

    def enter(self, code: np.ndarray) -> np.ndarray:
        """States after the first code point."""
        state = self.first[np.minimum(code, len(self.first) - 1)]
        beyond = np.flatnonzero(code >= len(self.first))
        if len(beyond):
            state[beyond] = self.step(np.zeros(len(beyond), np.int64), code[beyond])
        return state

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Following states, 0 where the trie ends (nothing leads back to the root)."""
        key = (state << _CODE) | code
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.next[at], 0)


def by_length(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in ``words``, code point matrix) per length; empty words are left out."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(words)]):
        size = int(sizes[order[a]])
        if size:
            text = "".join([words[i] for i in order[a:b].tolist()])
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            yield order[a:b], codes.reshape(-1, size).astype(np.int64)


def arcs(codes: np.ndarray, trie: Trie) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, length, rows, pieces): all pieces that begin at ``start``, start by start.

    A single character without a piece comes as piece -1 of length 1, so that every word has a path.
    """
    rows, size = codes.shape
    for start in range(size):
        row, state = np.arange(rows), trie.enter(codes[:, start])
        for length in range(1, size - start + 1):
            if length > 1:
                state = trie.step(state, codes[row, start + length - 1])
            piece = trie.piece[state]
            if length == 1:
                yield start, 1, row, np.where(state > 0, piece, -1)
            else:
                found = piece >= 0
                if found.any():
                    yield start, length, row[found], piece[found]
            alive = state > 0
            row, state = row[alive], state[alive]
            if not len(row):
                break
