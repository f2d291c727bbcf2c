"""Exact byte-pair encoding by dynamic programming over prefixes, and decoding.

Merging the lowest-ranked pair first has one result, and so has each prefix of a
word: its last token is unique. An automaton with suffix links over the vocabulary
reports every token that ends at a position. Such a token is the prefix's last one
exactly if it is compatible with the last token of what stands before it, that is,
if no merge ever crosses the border between the two. The table keeps this one token
for each prefix, and following it back from the end gives the ids.

Why borders decide: a merge makes a token of higher rank than its parts, so merges
happen in order of rank. Along the border only the right-most parts of the left
token and the left-most parts of the right token can meet. Each part exists from its
own rank until the rank of what swallows it, and a pair of them merges exactly if the
pair's rank comes while both are there.

Texts come in slices of some megabytes. Each different word of a slice is normalised
and split once, the table of all different pieces grows position by position in
arrays, and the ids are then put in place together.

Null and empty texts have no tokens; the decoding of none is the empty text, of null
null. Texts are encoded whole, of any length. Strings of special tokens in a text
become these tokens, as the file says. Words with characters that Unicode gained late
are normalised and split by the tokenizers library, whose tables are of another age. Each row is encoded by itself, so repeated rows
give equal ids, an empty table gives none, and no other column is looked at. A file
with another normaliser, splitting pattern or kind of model raises an error.
"""

import functools
import json
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm.hashing import distinct_spans, pieces, text_bytes, word_spans
from panelspark.llm.memo import give_back
from panelspark.llm.terms import positions

# Fixed values of the vocabulary's file format: bytes that stand for themselves in byte-level symbols,
# the pieces that the file's splitting pattern names, white space spelt out, and the steps before the model.
PLAIN_BYTES = (*range(33, 127), *range(161, 173), *range(174, 256))
WHITE_SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{WHITE_SPACE}\p{{L}}\p{{N}}]+"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ("NFC", "Replace", "Lowercase")
# end of the fixed values

END = 256  # closes a word inside the automaton, after the 256 bytes
SYMBOLS = 257
LAST_PLANES = 0x40000
SHORT = 64  # bytes of a piece whose table is worked out together with others
TEXT_BYTES = 1 << 21  # of texts encoded together
SLOTS = 20  # bits of a place in the memory of pairs
INFINITE = 1 << 60


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if plain, else the next from 256 on."""
    spare = iter(range(256, 512))
    plain = set(PLAIN_BYTES)
    return [chr(b if b in plain else next(spare)) for b in range(256)]


@functools.cache
def late_characters() -> frozenset[str]:
    """What Unicode has assigned after 3.2 or not at all: here the tables of two libraries may be of different age.

    Of the planes from LAST_PLANES on, no version has assigned letters, numbers or marks that combine.
    """
    then = unicodedata.ucd_3_2_0.category
    return frozenset(chr(c) for c in range(0x80, LAST_PLANES) if then(chr(c)) == "Cn")


def _checked(spec: dict) -> dict:
    steps = (spec["normalizer"] or {}).get("normalizers", [])
    split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    model = spec["model"]
    if (
        tuple(s["type"] for s in steps) != NORMALISERS or split.get("pattern") != {"Regex": SPLIT}
        or model["type"] != "BPE" or not model["end_of_word_suffix"] or spec["decoder"] is not None
        or model["dropout"] or model["continuing_subword_prefix"] or model["ignore_merges"]
    ):
        raise ValueError("not a word-level BPE file of the kind that this operator encodes")
    return spec


class Automaton:
    """The vocabulary's trie with suffix links, as arrays; a state is a number, 0 the root."""

    def __init__(self, words: list[tuple[list[int], int]]):
        to, depth, token, fail = {}, [0], [-1], [0]
        for symbols, i in words:
            state = 0
            for s in symbols:
                key = state * SYMBOLS + s
                following = to.get(key)
                if following is None:
                    following = to[key] = len(depth)
                    depth.append(depth[state] + 1)
                    token.append(-1)
                    fail.append(0)
                state = following
            token[state] = i
        # states by depth, so that a state's link is there before its children ask for it
        for key, state in sorted(to.items(), key=lambda e: depth[e[1]]):
            above, s = divmod(key, SYMBOLS)
            while above:
                above = fail[above]
                found = to.get(above * SYMBOLS + s)
                if found is not None:
                    fail[state] = found
                    break
        keys = np.array(sorted(to), dtype=np.int64)
        self.keys, self.to = keys, np.array([to[k] for k in keys.tolist()], dtype=np.int32)
        self.first = np.array([to.get(s, 0) for s in range(SYMBOLS)], dtype=np.int32)
        self.depth, self.token, self.fail = (np.array(a, dtype=np.int32) for a in (depth, token, fail))
        # the longest token that ends in a state, and the next shorter one after it, as states; 0 is none
        self.longest, self.shorter = np.zeros(len(depth), dtype=np.int32), np.zeros(len(depth), dtype=np.int32)
        for state in np.argsort(self.depth, kind="stable").tolist():
            below = self.longest[self.fail[state]]
            self.shorter[state] = below
            self.longest[state] = state if token[state] >= 0 else below

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The state of each text after one more symbol."""
        out = np.empty(len(state), dtype=np.int32)
        left = np.arange(len(state))
        while len(left):
            s = state[left]
            key = s * np.int64(SYMBOLS) + symbol[left]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            done = there | (s == 0)
            out[left[done]] = np.where(there, self.to[at], 0)[done]
            left = left[~done]
            state[left] = self.fail[s[~done]]
        return out


class Vocabulary:
    """A word-level BPE file, its automaton, and how each token is merged from two others."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = _checked(json.load(f))
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.name_of = np.full(max(self.names) + 1, "", dtype=object)
        for i, t in self.names.items():
            self.name_of[i] = t
        self.pair_rank, self.parts, self.rank = {}, {}, {}
        ids = model["vocab"]
        for r, (a, b) in enumerate(model["merges"]):
            whole = ids[a + b]
            self.pair_rank[ids[a], ids[b]] = r
            self.parts[whole], self.rank[whole] = (ids[a], ids[b]), r
        for whole, (a, b) in self.parts.items():
            if max(self.rank.get(a, -1), self.rank.get(b, -1)) >= self.rank[whole]:
                raise ValueError("a merge ranks before the parts that it needs")
        self.left_spines, self.right_spines = {}, {}
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        words = []
        for text, i in ids.items():
            if i in self.parts and not self.compatible(*self.parts[i], within=self.rank[i]):
                continue  # merging its own letters never gives this token
            closed = text.endswith(suffix) and len(text) > len(suffix)
            body = text[: -len(suffix)] if closed else text
            if all(c in byte_of for c in body):
                words.append(([byte_of[c] for c in body] + [END] * closed, i))
        self.automaton = Automaton(words)
        # one long piece at a time meets the same tokens in an automaton that takes one text
        self.one = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for symbols, i in words:
            self.one.add_word(tuple(symbols), (i, len(symbols)))
        self.one.make_automaton()
        # direct places for pairs of tokens asked about: twice the pair's number plus the answer
        self.asked = np.full(1 << SLOTS, -1, dtype=np.int64)
        self.find_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        library = Tokenizer.from_file(path)
        self.normalise, self.pre_tokenise = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The token and its outermost parts on one side, each with the rank of what swallows it."""
        known = self.left_spines if side == 0 else self.right_spines
        if token not in known:
            spine, until = [], INFINITE
            part = token
            while True:
                spine.append((part, until))
                if part not in self.parts:
                    break
                until, part = self.rank[part], self.parts[part][side]
            known[token] = spine
        return known[token]

    def compatible(self, left: int, right: int, within: int = INFINITE) -> bool:
        """No merge before rank ``within`` crosses the border between two tokens."""
        ranks = self.pair_rank
        for a, a_until in self._spine(left, 1):
            for b, b_until in self._spine(right, 0):
                r = ranks.get((a, b))
                # of equal ranks the left-most pair goes first
                if r is not None and r < within and r < a_until and r <= b_until:
                    return False
        return True

    def all_compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``compatible`` of many pairs; what was asked lately is remembered."""
        pair = left.astype(np.int64) << 20 | right
        slot = (pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOTS)).astype(np.int64)
        kept = self.asked[slot]
        fits = (kept & 1).astype(bool)
        unknown = np.flatnonzero(kept >> 1 != pair)
        if len(unknown):
            new, where, name = np.unique(pair[unknown], return_index=True, return_inverse=True)
            answer = np.fromiter((self.compatible(p >> 20, p & 0xFFFFF) for p in new.tolist()), dtype=bool, count=len(new))
            fits[unknown] = answer[name]
            self.asked[slot[unknown[where]]] = new << 1 | answer
        return fits

    def _long_piece(self, symbols: tuple[int, ...]) -> list[int]:
        """The ids of one piece of bytes closed by END."""
        n = len(symbols)
        last, back = [-1] * (n + 1), [0] * (n + 1)
        fits = {}
        for end, (token, length) in self.one.iter(symbols):
            start = end + 1 - length
            if last[end + 1] >= 0:
                continue
            if start:
                pair = last[start], token
                if pair not in fits:
                    fits[pair] = last[start] >= 0 and self.compatible(*pair)
                if not fits[pair]:
                    continue
            last[end + 1], back[end + 1] = token, start
        out, at = [], n
        while at:
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _short_pieces(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces that stand one after the other, longest first, and how many each has."""
        room = starts + np.arange(len(starts))  # a piece's prefixes are one more than its symbols
        last = np.full(len(symbols) + len(starts), -1, dtype=np.int32)
        back = np.zeros(len(last), dtype=np.int32)
        state = np.zeros(len(starts), dtype=np.int32)
        a = self.automaton
        for j in range(int(sizes.max(initial=0))):
            active = int(np.searchsorted(-sizes, -j, side="left"))
            state = a.step(state[:active], symbols[starts[:active] + j])
            found = a.longest[state]
            left = np.flatnonzero(found)
            found = found[left]
            while len(left):
                token, start = a.token[found], j + 1 - a.depth[found]
                before = last[room[left] + start]
                ok = start == 0
                ask = np.flatnonzero(~ok & (before >= 0))
                ok[ask] = self.all_compatible(before[ask], token[ask])
                here = room[left[ok]] + j + 1
                last[here], back[here] = token[ok], start[ok]
                found = a.shorter[found[~ok]]
                left = left[~ok][found > 0]
                found = found[found > 0]
        place, left, steps = sizes.copy(), np.arange(len(starts)), []
        while len(left):
            at = room[left] + place[left]
            steps.append((left, last[at]))
            place[left] = back[at]
            left = left[place[left] > 0]
        count = np.zeros(len(starts), dtype=np.int64)
        for some, _ in steps:
            count[some] += 1
        upto = np.cumsum(count)
        out = np.empty(int(count.sum()), dtype=np.uint32)
        for k, (some, tokens) in enumerate(steps):
            out[upto[some] - 1 - k] = tokens
        return out, count

    def encode_pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of each piece, not in their order: all ids, where each piece's begin, and how many they are."""
        raw, at = text_bytes(distinct)
        sizes = np.diff(at) + 1
        order = np.argsort(-sizes, kind="stable")
        n_long = int(np.searchsorted(-sizes[order], -SHORT, side="left"))
        long = [self._long_piece((*raw[at[i] : at[i + 1]].tolist(), END)) for i in order[:n_long].tolist()]
        short = order[n_long:]
        size = sizes[short]
        start = np.cumsum(size) - size
        symbols = np.full(int(size.sum()), END, dtype=np.int64)
        where, run = positions(size - 1, at[:-1][short])
        symbols[np.arange(len(run)) + run] = raw[where]
        ids, n_short = self._short_pieces(symbols, start, size)
        count = np.zeros(len(distinct), dtype=np.int64)
        count[order] = np.concatenate((np.array([len(p) for p in long], dtype=np.int64), n_short))
        begin = np.empty(len(distinct), dtype=np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return np.concatenate((np.array([i for p in long for i in p], dtype=np.uint32), ids)), begin, count

    def _late_pieces(self, lines: str) -> tuple[str, list[tuple[int, list[str]]]]:
        """The words, a line each, without those that hold late characters, and these words' pieces by the library."""
        late = late_characters()
        if lines.isascii() or late.isdisjoint(lines):
            return lines, []
        words, found = lines.split("\n"), []
        for i, word in enumerate(words):
            if not word.isascii() and not late.isdisjoint(word):
                plain = self.normalise(word)
                found.append((i, [plain[a:b] for _, (a, b) in self.pre_tokenise(plain)]))
                words[i] = ""
        return "\n".join(words), found

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without special tokens in a row, and how many each text has."""
        raw, at = text_bytes(texts)
        starts, ends, first = word_spans(raw, at)
        if not len(starts):
            return np.empty(0, dtype=np.uint32), np.zeros(len(texts), dtype=np.int64)
        name, chosen = distinct_spans(raw, starts, ends - starts)
        data = raw.tobytes()
        # no piece and no composed letter reaches over a line's end
        words = b"\n".join([data[i:j] for i, j in zip(starts[chosen].tolist(), ends[chosen].tolist())]).decode("utf-8")
        words, late = self._late_pieces(words)
        # each letter is lowered by itself: a sigma that ends a word gets no other form
        plain = unicodedata.normalize("NFC", words).replace("Σ", "σ").lower()
        found = _pieces(plain)
        words_of_late = np.repeat(np.array([w for w, _ in late], dtype=np.int64), [len(p) for _, p in late])
        every = [*found, "\n", *[p for _, some in late for p in some]]
        named = pa.array(every, type=pa.large_string()).dictionary_encode()
        code, distinct = np.asarray(named.indices), named.dictionary
        closes = code[: len(found)] == code[len(found)]
        word = np.concatenate((np.cumsum(closes)[~closes], words_of_late))
        code = np.concatenate((code[: len(found)][~closes], code[len(found) + 1 :]))
        if late:
            order = np.argsort(word, kind="stable")
            word, code = word[order], code[order]
        ids, begin, count = self.encode_pieces(distinct)
        of_words = ids[positions(count[code], begin[code])[0]]
        n_word = np.bincount(word, weights=count[code], minlength=len(chosen)).astype(np.int64)
        begin_word = np.cumsum(n_word) - n_word
        upto = np.concatenate(([0], np.cumsum(n_word[name])))
        return of_words[positions(n_word[name], begin_word[name])[0]], np.diff(upto[first])

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has; null has none."""
        texts = texts.fill_null("")
        marked = np.zeros(len(texts), dtype=bool)
        for content in self.special:
            marked |= np.asarray(pc.match_substring(texts, content))
        if not marked.any():
            return self._encode_plain(texts)
        parts, of_text, ids_between = [], [], []
        for i, (text, special) in enumerate(zip(texts.to_pylist(), marked.tolist())):
            cut = 0
            for m in self.find_special.finditer(text) if special else ():
                parts.append(text[cut : m.start()])
                ids_between.append(self.special[m[0]])
                of_text.append(i)
                cut = m.end()
            parts.append(text[cut:])
            ids_between.append(-1)
            of_text.append(i)
        ids, count = self._encode_plain(pa.array(parts, type=pa.large_string()))
        between = np.array(ids_between, dtype=np.int64)
        follows = np.flatnonzero(between >= 0)
        with_special = np.insert(ids, np.cumsum(count)[follows], between[follows].astype(np.uint32))
        total = np.bincount(of_text, weights=count + (between >= 0), minlength=len(texts))
        return with_special, total.astype(np.int64)

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian 32-bit numbers."""
        return self.encode_all(pa.array([text], type=pa.large_string()))[0].astype("<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The token strings with a blank between each two: the file names no decoder."""
        return " ".join(self.name_of[ids].tolist())


_pieces = regex.compile(PIECES + "|\n").findall


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    give_back()  # what earlier stages left, before the file's tables need it
    loaded = Vocabulary(path)
    give_back()
    return loaded


def _encoded(texts: pa.Array, path: str):
    """Ids and their ends by text, for each slice of the texts."""
    v = vocabulary(path)
    for some in pieces(texts, TEXT_BYTES):
        ids, count = v.encode_all(some)
        yield ids.astype("<u4", copy=False), np.concatenate(([0], np.cumsum(count)))
    give_back()


def encode_packed(text: Column, path: str) -> Column:
    """The ids of each text in one binary value, four little-endian bytes an id."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        parts = [
            pa.Array.from_buffers(pa.binary(), len(upto) - 1, [None, pa.py_buffer((4 * upto).astype(np.int32)), pa.py_buffer(ids)])
            for ids, upto in _encoded(texts, path)
        ]
        return pa.concat_arrays(parts) if parts else pa.array([], type=pa.binary())

    return packed(text)


def encode(text: Column, path: str) -> Column:
    """The ids of each text as an array of whole numbers."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        parts = [pa.ListArray.from_arrays(upto.astype(np.int32), ids.astype(np.int32)) for ids, upto in _encoded(texts, path)]
        return pa.concat_arrays(parts) if parts else pa.array([], type=pa.list_(pa.int32()))

    return ids(text)


def decode_packed(ids: Column, path: str) -> Column:
    """The text of each binary value that ``encode_packed`` made; null gives null."""

    @F.arrow_udf("string")
    def text(packed: pa.Array) -> pa.Array:
        v = vocabulary(path)
        return pa.array((None if (p := x.as_py()) is None else v.decode(np.frombuffer(p, dtype="<u4")) for x in packed), type=pa.string())

    return text(ids)
