"""Word and word-window hashes of whole Arrow batches of texts.

A word is a run of bytes other than space and 0x09 to 0x0D, which in UTF-8 is
the same as a run of such characters. All hashes are computed on the buffers
that Arrow hands over; no text is turned into Python words.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPAN = 1 << 18
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int):
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers["up"]) < n:
        size = max(n, _SPAN + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def pieces(texts: pa.Array, size: int = 1 << 23):
    """The array in slices of a bounded number of bytes, or of one longer text."""
    sizes = np.asarray(pc.binary_length(texts.fill_null("")), dtype=np.int64)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(np.cumsum(sizes[low:]), size, side="right")) + low)
        yield texts.slice(low, high - low)
        low = high


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row and where each begins and ends; null is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and the word number at which each text begins."""
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    before = np.empty(len(raw), dtype=bool)
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + (((raw >= 65) & (raw <= 90)).astype(np.uint8) << np.uint8(5))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the word number at which each text begins (one more than texts)."""
    raw, at = text_bytes(texts)
    starts, ends, first = word_spans(raw, at)
    return span_hashes(lower_ascii(raw) if lower else raw, starts, ends), first


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in ascending order and do not overlap."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):  # a piece spans a bounded number of bytes, or one longer word
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        up, down = _power_tables(high - low + 1)
        total = np.empty(high - low + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


# the lowest 0 to 8 bytes of a word of eight
LOWEST = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_LONG = 1024
_AT_ONCE = 1 << 15


def by_eight(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with eight zeros behind them, and the eight bytes from each position on as one number."""
    padded = np.concatenate((raw, np.zeros(8, dtype=np.uint8)))
    return padded, np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def span_keys(padded: np.ndarray, eight: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit key of the bytes of each span; every eight bytes are scrambled before the next join.

    Unlike sums of powers it has no patterns of letters that collide whatever the base.
    Some ten thousand spans are worked on at a time, which bounds what stands beside them.
    """
    if len(starts) > _AT_ONCE:
        cuts = range(0, len(starts), _AT_ONCE)
        return np.concatenate([span_keys(padded, eight, starts[i : i + _AT_ONCE], sizes[i : i + _AT_ONCE], seed) for i in cuts])
    out = mix(sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
    out = mix(out ^ (eight[starts] & LOWEST[np.minimum(sizes, 8)]))
    more, step = np.flatnonzero(sizes > 8), 8
    while len(more) and step < _LONG:
        out[more] = mix(out[more] ^ (eight[starts[more] + step] & LOWEST[np.minimum(sizes[more] - step, 8)]))
        step += 8
        more = more[sizes[more] > step]
    for i in more:
        rest = padded[starts[i] + step : starts[i] + sizes[i]]
        out[i] ^= np.uint64(int.from_bytes(hashlib.blake2b(rest.tobytes(), digest_size=8).digest(), "little"))
    return out


def distinct_spans(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each span, spans of equal bytes sharing one, and a span of each class.

    Keys propose that spans are equal and their bytes decide: one that only shares the key is a class of its own.
    """
    padded, eight = by_eight(raw)
    name, distinct = pd.factorize(span_keys(padded, eight, starts, sizes))
    chosen = np.empty(len(distinct), dtype=np.int64)
    chosen[name] = np.arange(len(name))
    like = chosen[name]
    differs = sizes != sizes[like]
    left, step = np.flatnonzero(~differs & (like != np.arange(len(name)))), 0
    while len(left):
        unlike = ((eight[starts[left] + step] ^ eight[starts[like[left]] + step]) & LOWEST[np.minimum(sizes[left] - step, 8)]) != 0
        differs[left[unlike]] = True
        step += 8
        left = left[~unlike & (sizes[left] > step)]
    alone = np.flatnonzero(differs)
    name[alone] = len(chosen) + np.arange(len(alone))
    return name, np.concatenate((chosen, alone))


def word_keys(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """``span_keys`` of every word, and the word number at which each text begins (one more than texts)."""
    raw, at = text_bytes(texts)
    starts, ends, first = word_spans(raw, at)
    return span_keys(*by_eight(lower_ascii(raw) if lower else raw), starts, ends - starts), first


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """The hash of every run of ``width`` words; runs over a text's end are the caller's to leave out."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    factor = np.uint64((0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9 * 2 * seed) % (1 << 64) | 1)
    out = np.full(n, np.uint64(width + seed * 0x1F123BB5), dtype=np.uint64)
    for k in range(width):
        out *= factor
        out += words[k : k + n]
        if k % 4 == 3:
            out ^= out >> np.uint64(29)
    return mix(out)


def windows_by_text(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starting word of every window that lies within one text, and the number of windows by text."""
    size = np.diff(first)
    count = np.maximum(size - width + 1, 0)
    text = np.repeat(np.arange(len(size)), count)
    skip = np.concatenate(([0], np.cumsum(count)))[:-1]
    return first[:-1][text] + np.arange(int(count.sum())) - skip[text], count


def sequence_hash(words: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """One 64-bit hash of each text's whole word sequence: neighbours are scrambled into one until one is left."""
    sizes = np.diff(first)
    if len(words) > _AT_ONCE and len(sizes) > 1:
        # as many texts at a time as have so many words, or one longer text
        out, low = [], 0
        while low < len(sizes):
            high = max(low + 1, int(np.searchsorted(first, first[low] + _AT_ONCE, side="right")) - 1)
            out.append(sequence_hash(words[first[low] : first[high]], first[low : high + 1] - first[low], seed))
            low = high
        return np.concatenate(out)
    count, start = sizes.copy(), first[:-1].copy()
    now = mix(words ^ np.uint64(0xA0761D6478BD642F + seed))
    while count.max(initial=0) > 1:
        half = (count + 1) // 2
        after = np.cumsum(half) - half
        text = np.repeat(np.arange(len(half)), half)
        left = start[text] + 2 * (np.arange(len(text)) - after[text])
        paired = left + 1 < start[text] + count[text]
        right = np.where(paired, now[np.minimum(left + 1, len(now) - 1)], np.uint64(0x9FB21C651E98DF25))
        joined = mix(now[left] * np.uint64(_BASE) ^ right)
        now = np.where(count[text] == 1, now[left], joined)
        count, start = half, after
    out = np.zeros(len(sizes), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    out[full] = now[start[full]]
    return mix(out + sizes.astype(np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each lower-cased text, as hashes, and where each text's begin.

    A text of fewer than ``width`` words is one shingle, its whole sequence; one without words has none.
    """
    words, first = word_keys(texts, lower=True)
    at, count = windows_by_text(first, width)
    hashes = window_hashes(words, width)[at]
    sizes = np.diff(first)
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    text = np.concatenate((np.repeat(np.arange(len(sizes)), count), short))
    hashes = np.concatenate((hashes, sequence_hash(words, first, 7)[short]))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    text, hashes = text[new], hashes[new]
    return hashes, np.searchsorted(text, np.arange(len(sizes) + 1))
