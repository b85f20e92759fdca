"""The pre-token pattern of byte-level BPE, split with arrays instead of one match at a time.

Fixed rule, as the tokenizers state it: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+|
?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. Texts are laid end to end, characters get a class, and the
starts of matches follow from the classes of neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex

from assaylane.llm.common import mixed, worker_cache

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CHUNK_CHARS = 1 << 19


def _classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for begin in range(0, 0x110000, 0x8000):  # bit by bit, to hold little at a time
        every = "".join(chr(c) for c in range(begin, begin + 0x8000) if not 0xD800 <= c < 0xE000)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                first, last = ord(m[0][0]), ord(m[0][-1])
                table[first : last + 1] = kind
                if first < 0xD800 <= last:
                    table[0xD800:0xE000] = OTHER
    return table


def char_classes() -> np.ndarray:
    return worker_cache("classes", _classes)


def _weights() -> np.ndarray:
    return mixed(np.arange(1, 4097, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Split:
    text: str  # the texts, end to end
    starts: np.ndarray  # first character of each pre-token, and the end
    first: np.ndarray  # index of the first pre-token of each text, and their number

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.starts[i + 1]]

    def hashes(self) -> np.ndarray:
        """64 bits for each pre-token."""
        if len(self.starts) < 2:
            return np.zeros(0, np.uint64)
        points = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        lengths = np.diff(self.starts)
        inside = np.arange(len(points), dtype=np.int64) - np.repeat(self.starts[:-1], lengths)
        longest = int(lengths.max())
        weights = worker_cache("weights", _weights)
        if longest > len(weights):
            weights = mixed(np.arange(1, longest + 1, dtype=np.uint64)) | np.uint64(1)
        terms = (points.astype(np.uint64) + np.uint64(1)) * weights[inside]
        return mixed(np.add.reduceat(terms, self.starts[:-1]) + lengths.astype(np.uint64))


def split(texts: list[str]) -> Split:
    """All pre-tokens of the texts. A match never crosses the end of a text."""
    text = "".join(texts)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    n = len(text)
    if n == 0:
        return Split("", np.zeros(1, np.int64), np.zeros(len(texts) + 1, np.int64))
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kind = char_classes()[points]
    new_text = np.zeros(n + 1, bool)
    new_text[0] = True
    new_text[ends] = True
    start = new_text.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # the last blank before something else stands alone, or joins it if it is a plain space
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~new_text[1:n])
    start[last] = True
    plain = last[points[last] == 32]
    start[plain + 1] = False
    # contractions: an apostrophe that starts a match, before a letter
    quote = np.flatnonzero((points[:-1] == 39) & start[: n - 1] & (kind[1:] == LETTER) & ~new_text[1:n])
    if len(quote):
        one = points[quote + 1]
        inner = np.minimum(quote + 2, n - 1)
        two = np.where((quote + 2 < n) & ~new_text[quote + 2], points[inner], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 1] = False
        start[quote[long] + 3] = True
    starts = np.flatnonzero(start)
    if starts[-1] != n:
        starts = np.append(starts, n)
    first = np.searchsorted(starts, np.concatenate([[0], ends]))
    return Split(text, starts, first)
