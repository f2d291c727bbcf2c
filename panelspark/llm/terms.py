"""Terms of whole Arrow batches of texts, on their bytes.

A term is a maximal run of ASCII letters, digits and non-ASCII characters, A-Z
lower-cased. In UTF-8 that is a run of bytes, so no text becomes Python words.
Terms are told apart by their bytes: a key only proposes that two are equal.
"""

import numpy as np
import pyarrow as pa

from panelspark.llm.hashing import LOWEST, by_eight, lower_ascii, span_keys, text_bytes

_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LONG = 1024


class Terms:
    """The terms of several texts: their bytes, where each begins and ends, and the term at which each text begins."""

    def __init__(self, texts: pa.Array):
        raw, at = text_bytes(texts)
        raw = lower_ascii(raw)
        inside = _IN_TERM[raw]
        opens, closes = inside.copy(), inside.copy()
        opens[1:] &= ~inside[:-1]
        closes[:-1] &= ~inside[1:]
        # a text's end cuts a term even where the next text goes on with another
        begins, ends = at[:-1][at[:-1] < len(raw)], at[1:][at[1:] > 0] - 1
        opens[begins], closes[ends] = inside[begins], inside[ends]
        self.starts, self.ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, at)
        self.sizes = self.ends - self.starts
        self._padded, self.eight = by_eight(raw)

    def __len__(self):
        return len(self.starts)

    def text(self, i: int) -> bytes:
        return self._padded[self.starts[i] : self.ends[i]].tobytes()

    def keys(self, which: np.ndarray | slice = slice(None), seed: int = 0) -> np.ndarray:
        """A 64-bit key of each of the terms ``which``."""
        return span_keys(self._padded, self.eight, self.starts[which], self.sizes[which], seed)

    def equal(self, mine: np.ndarray, other: "Terms", theirs: np.ndarray) -> np.ndarray:
        """Whether the terms ``mine`` have the same bytes as the terms ``theirs`` of ``other``."""
        sizes = self.sizes[mine]
        same = sizes == other.sizes[theirs]
        left, step = np.flatnonzero(same), 0
        while len(left):
            if step >= _LONG:
                for i in left:
                    same[i] = self.text(mine[i]) == other.text(theirs[i])
                break
            a = self.eight[self.starts[mine[left]] + step]
            b = other.eight[other.starts[theirs[left]] + step]
            alike = ((a ^ b) & LOWEST[np.minimum(sizes[left] - step, 8)]) == 0
            same[left[~alike]] = False
            step += 8
            left = left[alike & (sizes[left] > step)]
        return same


def positions(counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of several runs one after the other, and the run of each."""
    run = np.repeat(np.arange(len(counts)), counts)
    skip = np.cumsum(counts) - counts
    return starts[run] + np.arange(len(run)) - skip[run], run
