"""Byte-level BPE of many texts at once: where their pieces begin, and the merges of the different pieces.

Both work on the bytes that Arrow hands over. The pieces are those of the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

which a comparison of neighbouring characters' classes finds: a piece begins where the class changes, at the last white
space before something else (a blank goes with what follows it), and around a contraction.
"""

import functools
import unicodedata

import numpy as np
import pandas as pd
import regex

from panelspark.llm.bpe import LAST_PLANES, WHITE_SPACE, byte_symbols

SYMBOL, LETTER, NUMBER, BLANK = range(4)
SLOTS = 64  # bytes of the longest piece that is merged here
NEVER = np.int32(2**31 - 1)  # behind every rank
_WIDTHS = (2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 16, 24, 40, SLOTS)  # pieces of up to so many bytes are merged together


@functools.cache
def newer_characters() -> tuple[frozenset[str], list[int]]:
    """What the pattern library calls letters or numbers and the tables of the running Python do not know.

    The tokenizers library does not know these either: they belong to no class there. The second value has their numbers.
    """
    every = "".join(chr(c) for c in range(LAST_PLANES) if not 0xD800 <= c < 0xE000)
    found = frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    return found, sorted(map(ord, found))


@functools.cache
def _classes() -> np.ndarray:
    """The class of every character up to the last planes, whose own have none."""
    every = "".join(chr(c) for c in range(LAST_PLANES) if not 0xD800 <= c < 0xE000)
    out = np.full(len(every), SYMBOL, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, f"[{WHITE_SPACE}]+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = kind
    out = np.insert(out, 0xD800, np.full(0x800, SYMBOL, dtype=np.uint8))
    out[newer_characters()[1]] = SYMBOL
    return out


def byte_classes(raw: np.ndarray) -> np.ndarray:
    """The class of the character that each byte of valid UTF-8 belongs to."""
    table = _classes()
    kind = table[:256][raw]
    lead = np.flatnonzero(raw >= 0xC0)
    for low, high, more in ((0xC0, 0xE0, 1), (0xE0, 0xF0, 2), (0xF0, 0x100, 3)):
        some = lead[(raw[lead] >= low) & (raw[lead] < high)]
        code = (raw[some] & (0x3F >> more)).astype(np.int32)
        for k in range(1, more + 1):
            code = code << 6 | raw[some + k] & 0x3F
        its = table[np.minimum(code, LAST_PLANES - 1)]  # the last one has no class
        for k in range(more + 1):
            kind[some + k] = its
    return kind


def piece_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first byte of every piece; ``at`` has where each text begins and ends."""
    n = len(raw)
    if not n:
        return np.empty(0, dtype=np.int64)
    kind = byte_classes(raw)
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    begin = edge[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    blank = kind == BLANK
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:-1])  # white space before something else
    joined = last[raw[last] == 32] + 1
    for _ in range(2):
        last -= (raw[last] & 0xC0) == 0x80
    begin[last] = True
    begin[joined] = False
    quote = np.flatnonzero((raw == 39) & begin & ~edge[1:])
    one, two = raw[quote + 1], raw[np.minimum(quote + 2, n - 1)]
    room = ~edge[np.minimum(quote + 2, n)]
    size = np.where(np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)), 2, 0)
    size[room & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))] = 3
    quote, size = quote[size > 0], size[size > 0]
    begin[quote + 1] = False
    after = quote + size
    begin[after[after < n]] = True
    return np.flatnonzero(begin)


class Merges:
    """The merges of a vocabulary file, for all different pieces in step: each round makes one merge in each piece.

    In every piece it is the one that comes first in the file, and of these the leftmost, as in the library. That needs a
    symbol for every byte and a different token from every merge; ``longest`` is 0 for a file without these.
    """

    def __init__(self, model: dict):
        ids = model["vocab"]
        pairs = {tuple(m.split(" ") if isinstance(m, str) else m): rank for rank, m in enumerate(model["merges"])}
        symbols = byte_symbols()
        made = {a + b for a, b in pairs}
        self.longest = SLOTS if len(made) == len(pairs) and ids.keys() >= {*symbols, *made} and len(model["merges"]) < 1 << 24 else 0
        if not self.longest:
            return
        self.none = max(ids.values()) + 1  # stands beside a piece
        self.symbol = np.array([ids[s] for s in symbols], dtype=np.int32)
        self.keys = pd.Index(np.array([ids[a] * (self.none + 1) + ids[b] for a, b in pairs], dtype=np.int64))
        # the last place answers for pairs that are not there, which the index calls -1
        self.rank = np.append(np.array(list(pairs.values()), dtype=np.int32), NEVER >> 6)
        self.made = np.zeros(len(model["merges"]), dtype=np.int32)
        self.made[self.rank[:-1]] = [ids[a + b] for a, b in pairs]
        left, right = np.divmod(np.arange(1 << 16), 256)
        self.first = self._ranks(self.symbol[left], self.symbol[right])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.rank[self.keys.get_indexer(left.astype(np.int64) * (self.none + 1) + right)]

    def __call__(self, raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces of at most ``longest`` bytes one after another, and how many each has."""
        count = np.ones(len(starts), dtype=np.int64)
        if not len(starts):
            return np.empty(0, dtype=np.int32), count
        low, single = 1, np.flatnonzero(sizes == 1)
        groups = [(single, self.symbol[raw[starts[single]]])]
        for width in _WIDTHS:
            some = np.flatnonzero((sizes > low) & (sizes <= width))
            low = width
            if len(some):
                ids, count[some] = self._merged(raw, starts[some], sizes[some], width)
                groups.append((some, ids))
        ends = np.cumsum(count)
        out = np.empty(int(ends[-1]), dtype=np.int32)
        for some, ids in groups:
            n = count[some]
            before = np.cumsum(n) - n
            out[np.repeat(ends[some] - n - before, n) + np.arange(len(ids))] = ids
        return out, count

    def _merged(self, every, starts, sizes, width):
        """A row for each byte of a piece and one that stands beside it, a column for each piece."""
        m = len(starts)
        place = np.arange(width, dtype=np.int64)[:, None]
        inside = place < sizes
        raw = every[np.where(inside, starts + place, 0)]
        now = np.full((width + 1, m), self.none, dtype=np.int32)
        now[:-1][inside] = self.symbol[raw[inside]]
        after = np.empty((width + 1, m), dtype=np.int32)
        after[:] = np.arange(1, width + 2, dtype=np.int32)[:, None]
        after[:-1][place == sizes - 1] = width
        before = np.empty((width + 1, m), dtype=np.int32)
        before[:] = np.arange(-1, width, dtype=np.int32)[:, None]
        before[0] = width
        rank = np.full((width + 1, m), NEVER, dtype=np.int32)
        pair = inside[1:]
        found = self.first[raw[:-1][pair].astype(np.int32) << 8 | raw[1:][pair]]
        # rank and place in one number, whose smallest is the leftmost of the first merge
        rank[:-2][pair] = found << 6 | np.nonzero(pair)[0].astype(np.int32)
        gone = np.zeros((width + 1, m), dtype=bool)
        piece = np.arange(m)
        flat_now, flat_after, flat_before, flat_gone = now.ravel(), after.ravel(), before.ravel(), gone.ravel()
        while len(piece):
            least = rank.min(axis=0)
            live = np.flatnonzero(least < NEVER >> 6 << 6)
            if len(live) < len(piece):
                rank, piece, least = np.take(rank, live, axis=1), piece[live], least[live]
            if not len(piece):
                break
            a, flat_rank, column = len(piece), rank.ravel(), np.arange(len(piece))
            here = least & 63
            new = self.made[least >> 6]
            at = here.astype(np.int64) * m + piece
            taken = flat_after[at]
            taken_at = taken.astype(np.int64) * m + piece
            follows, leads = flat_after[taken_at], flat_before[at]
            flat_now[at] = new
            flat_gone[taken_at] = True
            flat_after[at] = follows
            flat_before[follows.astype(np.int64) * m + piece] = here
            left = flat_now[leads.astype(np.int64) * m + piece]
            right = flat_now[follows.astype(np.int64) * m + piece]
            found = self._ranks(np.concatenate((left, new)), np.concatenate((new, right))) << 6
            flat_rank[taken.astype(np.int64) * a + column] = NEVER
            flat_rank[leads.astype(np.int64) * a + column] = found[:a] | leads & 63
            flat_rank[here.astype(np.int64) * a + column] = found[a:] | here
        kept = (inside & ~gone[:-1]).T
        return now[:-1].T[kept], kept.sum(axis=1)
