"""Byte-level BPE rules read from a public vocabulary file, and the split of a text into words.

The vocabulary is a `tokenizers` JSON file whose path is a parameter.  Every task reads it from
that path once per Python worker, so nothing large travels from the driver.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import regex

# The published split rule of the byte-level vocabularies (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same rule in the faster standard module; equal for texts without the characters of RARE.
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Where the modules' tables may differ: separators 1C-1F, fraction and superscript digits, and
# everything past the blocks that all versions of the character tables agree on.
RARE = re.compile("[\x1c-\x1f²³¹¼-¾͸-\U0010ffff]")
# Entries of a worker's memos of chunks and of words; a full one takes no more.
MEMO_ENTRIES = 400_000
WORD_MEMO_ENTRIES = 800_000


def byte_symbols() -> list[str]:
    """Printable stand-ins of the 256 bytes, as the vocabulary files spell them."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in keep}
    spare = (chr(0x100 + i) for i in range(256))
    return [table[b] if b in table else next(spare) for b in range(256)]


class Vocabulary:
    """Merge ranks, ids and added strings of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as handle:
            spec = json.load(handle)
        ids: dict[str, int] = spec["model"]["vocab"]
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        self.byte_ids = [ids[s] for s in symbols]
        # left and right symbol (20 bits each) to rank and merged symbol (the lower 20 bits)
        self.merges: dict[int, int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            self.merges.setdefault(ids[left] << 20 | ids[right], rank << 20 | ids[left + right])
        self.token_bytes = {i: bytes(back[c] for c in s) for s, i in ids.items() if all(c in back for c in s)}
        self.added = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        self.token_bytes |= {i: s.encode() for s, i in self.added.items()}
        order = sorted(self.added, key=len, reverse=True)
        self.added_split = re.compile("(" + "|".join(map(re.escape, order)) + ")") if order else None
        self.path = path

    @functools.cached_property
    def full_split(self):
        """The split rule with the library's own classes for characters newer than its tables.

        Characters that the regex module and Python's tables class alike are left to the module;
        of the rest, those that the library does not count as letters or numbers are taken out.
        """
        import unicodedata

        from tokenizers import Tokenizer

        pre = Tokenizer.from_file(self.path).pre_tokenizer
        points = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
        every = "".join(points)
        classes = []
        for kind, probe in (("L", "a"), ("N", "1")):
            module = set(regex.findall(rf"\p{{{kind}}}", every))
            own = {c for c in points if unicodedata.category(c)[0] == kind}
            wrong, missing = [], []
            for c in sorted(module ^ own):
                together = len(pre.pre_tokenize_str(probe + c)) == 1
                if together != (c in module):
                    (missing if together else wrong).append(c)
            classes.append(rf"[\p{{{kind}}}{''.join(missing)}--[{''.join(wrong)}]]" if wrong else rf"[\p{{{kind}}}{''.join(missing)}]")
        letters, numbers = classes
        return regex.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{numbers}]").replace(r"\p{L}", letters).replace(r"\p{N}", numbers), regex.V1)

    def words(self, text: str) -> list[str]:
        return (self.full_split if RARE.search(text) else PLAIN_SPLIT).findall(text)

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text cut at added strings: (part, is an added string)."""
        if self.added_split is None or not self.added_split.search(text):
            return [(text, False)] if text else []
        return [(p, i % 2 == 1) for i, p in enumerate(self.added_split.split(text)) if p]

    def merge(self, word: bytes) -> tuple[list[int], int]:
        """Pop the lowest-rank adjacent pair (leftmost first) until none is left.

        Symbols form a linked list; merged ones are left behind as -1.  Returns the symbols and
        the number of merges.  O(n log n), so words of any length can be merged.
        """
        byte_ids = self.byte_ids
        symbols = [byte_ids[b] for b in word]
        n = len(symbols)
        find = self.merges.get
        # heap entries: rank, merged symbol, position, packed into one number
        heap = []
        last = symbols[0] if n else 0
        for i in range(1, n):
            this = symbols[i]
            found = find(last << 20 | this)
            if found is not None:
                heap.append(found << 32 | i - 1)
            last = this
        if not heap:
            return symbols, 0
        if len(heap) > 1:
            heapq.heapify(heap)
        push, pop = heapq.heappush, heapq.heappop
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        symbols.append(-1)
        done = 0
        while heap:
            entry = pop(heap)
            i = entry & 0xFFFFFFFF
            left = symbols[i]
            j = after[i]
            if left < 0 or symbols[j] < 0 or find(left << 20 | symbols[j]) != entry >> 32:
                continue  # one of the two has been merged since
            merged = symbols[i] = entry >> 32 & 0xFFFFF
            symbols[j] = -1
            done += 1
            k = after[i] = after[j]
            before[k] = i
            if symbols[k] >= 0:
                found = find(merged << 20 | symbols[k])
                if found is not None:
                    push(heap, found << 32 | i)
            h = before[i]
            if h >= 0:
                found = find(symbols[h] << 20 | merged)
                if found is not None:
                    push(heap, found << 32 | h)
        return symbols, done

    def count_word(self, word: str) -> int:
        raw = word.encode()
        return len(raw) - self.merge(raw)[1]

    def word_ids(self, raw: bytes) -> list[int]:
        return [s for s in self.merge(raw)[0] if s >= 0]


def chunks(text: str) -> list[str]:
    """Cut before every blank that a non-blank follows; no word of the split rule crosses such a cut.

    Chunks repeat far more often than texts, so work per chunk can be remembered.
    """
    first, *rest = text.split(" ")
    out = []
    current = first
    for piece in rest:
        if piece and not piece[0].isspace():
            if current:
                out.append(current)
            current = " " + piece
        else:
            current += " " + piece
    if current:
        out.append(current)
    return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
