"""Minimal acyclic transducer: words to id lists, as one file that tasks map into memory.

Words that end alike share states.  Each edge carries the number of words that sort before its
branch; the sum along a path is the word's rank, and the rank selects its list of ids.  The file
holds a hash table of edges (state and byte to edge), so a step is one probe on average.
"""

from __future__ import annotations

import mmap
import struct
from array import array

MAGIC = b"ATL1"
_HEADER = struct.Struct("<4sIIII")  # magic, table bits, words, ids, first state


def _slot(state: int, byte: int, mask: int) -> int:
    return ((state << 8 | byte) * 2654435761 >> 7) & mask


def build(words: dict[bytes, list[int]]) -> bytes:
    """The file content for these words (not empty strings)."""
    order = sorted(words)
    # states: tuple of (final, edges); equal right languages become one state
    register: dict[tuple, int] = {}
    finals: list[bool] = []
    edges: list[tuple[tuple[int, int], ...]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = register.get(key)
        if state is None:
            state = register[key] = len(finals)
            finals.append(key[0])
            edges.append(key[1])
        return state

    path: list[list] = [[False, []]]  # open nodes of the last word; a node is [final, settled edges]
    last = b""
    for word in order:
        common = 0
        while common < min(len(last), len(word)) and last[common] == word[common]:
            common += 1
        for depth in range(len(last), common, -1):
            state = settle(path.pop())
            path[-1][1].append((last[depth - 1], state))
        for _ in word[common:]:
            path.append([False, []])
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        state = settle(path.pop())
        path[-1][1].append((last[depth - 1], state))
    root = settle(path[0])

    below = [0] * len(finals)  # words accepted from a state; children are settled before parents
    for s, out in enumerate(edges):
        below[s] = finals[s] + sum(below[t] for _, t in out)
    n_edges = sum(map(len, edges))
    bits = max(4, (2 * n_edges + 1).bit_length())
    mask = (1 << bits) - 1
    keys, targets, skips = (array("I", bytes(4 << bits)) for _ in range(3))
    for s, out in enumerate(edges):
        skip = int(finals[s])
        for byte, target in out:
            slot = _slot(s, byte, mask)
            while keys[slot]:
                slot = (slot + 1) & mask
            keys[slot] = (s << 8 | byte) + 1
            targets[slot] = target << 1 | finals[target]
            skips[slot] = skip
            skip += below[target]
    offsets, ids = array("I", [0]), array("I")
    for word in order:
        ids.extend(words[word])
        offsets.append(len(ids))
    header = _HEADER.pack(MAGIC, bits, len(order), len(ids), root)
    return header + b"".join(a.tobytes() for a in (keys, targets, skips, offsets, ids))


class Lexicon:
    """A transducer file mapped into memory; workers on one machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as handle:
            self._map = mmap.mmap(handle.fileno(), 0, access=mmap.ACCESS_READ)
        magic, bits, n_words, n_ids, self.root = _HEADER.unpack_from(self._map)
        if magic != MAGIC:
            raise ValueError(f"{path} is not a lexicon")
        view = memoryview(self._map)[_HEADER.size :].cast("I")
        size = 1 << bits
        self.mask = size - 1
        self.keys, self.targets, self.skips = view[:size], view[size : 2 * size], view[2 * size : 3 * size]
        self.offsets = view[3 * size : 3 * size + n_words + 1]
        self.ids = view[3 * size + n_words + 1 : 3 * size + n_words + 1 + n_ids]

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word, None if it is not in the lexicon."""
        keys, targets, mask = self.keys, self.targets, self.mask
        state, rank, final = self.root, 0, 0
        for byte in word:
            want = (state << 8 | byte) + 1
            slot = _slot(state, byte, mask)
            while (have := keys[slot]) != want:
                if not have:
                    return None
                slot = (slot + 1) & mask
            rank += self.skips[slot]
            state, final = targets[slot] >> 1, targets[slot] & 1
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist() if final else None
