"""Byte-pair merges of many words at once in numpy, with the tables of a public tokenizer file.

The symbols of all words lie in one flat array, with the first symbol of each word beside it (a ragged
array). In a round every word's lowest-ranked pair is found by a binary search of its pairs in the sorted
pair keys, and all its occurrences are merged from left to right; words without a pair are done. That is what
merging one pair after another gives, as a merge makes no pair of a lower rank than its own. Where a table
has such a pair (``unsafe``), only the first occurrence is merged in that round. A round costs as many steps as
symbols are left, and a word of very many letters has very many rounds; words of over ``LONG_WORD`` symbols
are therefore merged at linked places, lowest rank and then leftmost first, which costs steps by merges.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

NO_RANK = np.iinfo(np.int32).max
#: Words, and characters of words, kept with their results by a task; beyond either the store is emptied. It changes no result.
MAX_STORED_WORDS, MAX_STORED_CHARS = 150_000, 4_000_000
#: Symbols of a word from which on it is merged on its own.
LONG_WORD = 400
#: A text is cut up in pieces of about so many characters, at places where no word can cross.
PIECE_CHARS = 1 << 20

# The pattern of the byte-level files; the one of the files with word ends comes with the file.
BYTE_LEVEL_PATTERN = r" ?\p{L}+|'s|'t|'re|'ve|'m|'ll|'d| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Letters and numbers (first, last) that the pattern module knows and the library's older Unicode tables do not;
# the library takes them for symbols.
NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8),
    (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24),
    (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
# Capitals (first, last, first small letter) that the library lowers and Python's Unicode tables do not have.
NEWER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
#: Texts whose characters are all before this one are cut by a pattern that lists letters and numbers; all of NEWER come later.
LISTED = 0x530
_NEWER = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
_STAND_IN = "\u2603"  # a symbol
_CAPITALS = {c: small + c - a for a, b, small in NEWER_CAPITALS for c in range(a, b + 1)}
_CAPITAL = regex.compile("[" + "".join(map(chr, _CAPITALS)) + "]")


def listed(pattern: str) -> re.Pattern:
    """``pattern`` with its kinds of characters (letters, numbers, white space) written out up to ``LISTED``."""
    kinds = {r"\p{L}": "", r"\p{N}": "", r"\s": ""}
    for kind in kinds:
        of = [c for c in range(LISTED) if regex.match(kind, chr(c))]
        ends = [c for c in of if c + 1 not in of]
        kinds[kind] = "".join(f"{re.escape(chr(c))}-{re.escape(chr(e))}" for c, e in zip((c for c in of if c - 1 not in of), ends, strict=True))
    inside = False

    def one(m: re.Match) -> str:
        nonlocal inside
        if m[0] in ("[", "[^", "]"):
            inside = m[0] != "]"
            return m[0]
        chars = "^" + kinds[r"\s"] if m[0] == r"\S" else kinds[m[0]]
        return chars if inside else f"[{chars}]"

    return re.compile(re.sub(r"\\p\{[LN]\}|\\[sS]|\[\^?|\]", one, pattern))


def highest(text: str) -> int:
    """The last character of a text."""
    return int(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.dtype("<u4")).max(initial=0))


def byte_characters() -> list[str]:
    """The character that byte-level files write for each byte: itself if it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class Table:
    """Merges and ids of a tokenizer file of the kinds named in ``load``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids = model["vocab"]
        self.word_end = model["end_of_word_suffix"] or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.normalizes = spec["normalizer"] is not None
        split = (spec["pre_tokenizer"].get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.pattern = regex.compile(split or BYTE_LEVEL_PATTERN)
        self.listed = listed(split or BYTE_LEVEL_PATTERN)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        self.tokens = [""] * (1 + max([*ids.values(), *self.specials.values()]))
        for token, i in [*ids.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.size = len(self.tokens)
        chars = byte_characters()
        self.bytes = np.array([ids[c] for c in chars], np.int64)
        self.last_bytes = np.array([ids[c + self.word_end] for c in chars], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        # of a pair that is listed twice, the last rank counts
        _, last = np.unique(keys[::-1], return_index=True)
        at = len(keys) - 1 - last
        self.keys, self.ranks, self.made = keys[at], at.astype(np.int32), made[at]
        latest = np.full(self.size, -1)
        np.maximum.at(latest, self.made, self.ranks)
        earlier = (latest[self.keys // self.size] > self.ranks) | (latest[self.keys % self.size] > self.ranks)
        lowest = np.full(self.size, NO_RANK)  # of the pairs that use a symbol
        for half in (self.keys // self.size, self.keys % self.size):
            np.minimum.at(lowest, half[earlier], self.ranks[earlier])
        self.unsafe = np.zeros(len(keys), bool)
        self.unsafe[self.ranks] = lowest[self.made] < self.ranks

        self._pairs: dict[int, int] | None = None

    def pairs(self) -> dict[int, int]:
        """The place of each pair by its key."""
        if self._pairs is None:
            self._pairs = dict(zip(self.keys.tolist(), range(len(self.keys)), strict=True))
        return self._pairs

    def pair_places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Of each pair, its place in the sorted keys, or -1."""
        sought = left * self.size + right
        at = np.searchsorted(self.keys, sought)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == sought, at, -1)


@lru_cache(maxsize=4)
def load(path: str) -> Table:
    """The table of a ``.json`` file with byte-level BPE, with or without word ends; once for each worker."""
    return Table(path)


def first_symbols(words: list[str], table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets): a symbol for each byte of each word."""
    joined = "".join(words)
    if joined.isascii():
        sizes, data = list(map(len, words)), joined.encode()
    else:
        parts = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes, data = list(map(len, parts)), b"".join(parts)
    offsets = np.zeros(len(words) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    data = np.frombuffer(data, np.uint8)
    symbols = table.bytes[data]
    ends = offsets[1:] - 1
    symbols[ends] = table.last_bytes[data[ends]]
    return symbols, offsets


def merge_long(symbols: np.ndarray, table: Table) -> np.ndarray:
    """The symbols of one word when nothing can be merged any more: the lowest rank first, then the leftmost place."""
    pairs, ranks, made, size = table.pairs(), table.ranks, table.made, table.size
    n = len(symbols)
    place = table.pair_places(symbols[:-1], symbols[1:])
    at = np.flatnonzero(place >= 0)
    queue = (ranks[place[at]].astype(np.int64) << 40 | at).tolist()
    heapq.heapify(queue)
    of, left, right = symbols.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
    found = place.tolist() + [-1]  # the pair that begins at each place now
    rank_of, made_of = ranks.tolist(), made.tolist()
    while queue:
        top = heapq.heappop(queue)
        i = top & (1 << 40) - 1
        p = found[i]
        if p < 0 or rank_of[p] != top >> 40:
            continue
        j = right[i]
        of[i], of[j], found[j] = made_of[p], -1, -1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
        for a, b in ((left[i], i), (i, k)):
            if a >= 0 and b < n:
                found[a] = q = pairs.get(of[a] * size + of[b], -1)
                if q >= 0:
                    heapq.heappush(queue, rank_of[q] << 40 | a)
            elif a >= 0:
                found[a] = -1
    out = np.array(of, np.int64)
    return out[out >= 0]


def merge_words(symbols: np.ndarray, offsets: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) of words merged: long ones each on its own, all others in rounds."""
    sizes = np.diff(offsets)
    long = np.flatnonzero(sizes > LONG_WORD)
    if not len(long):
        return merge_rounds(symbols, offsets, table)
    short = sizes <= LONG_WORD
    some, where = merge_rounds(symbols[np.repeat(short, sizes)], np.concatenate(([0], np.cumsum(sizes[short]))), table)
    alone = [merge_long(symbols[offsets[w] : offsets[w + 1]], table) for w in long]
    word = np.concatenate((np.repeat(np.flatnonzero(short), np.diff(where)), np.repeat(long, [len(x) for x in alone])))
    return np.concatenate((some, *alone))[np.argsort(word, kind="stable")], np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(sizes)))))


def merge_rounds(symbols: np.ndarray, offsets: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, offsets) when nothing can be merged any more. Words have one symbol at least."""
    n_words = len(offsets) - 1
    done_symbols, done_words = [], []
    word = np.repeat(np.arange(n_words), np.diff(offsets))
    place = np.full(len(symbols), -1)  # of the pair that begins at each symbol
    inside = np.flatnonzero(word[:-1] == word[1:])
    place[inside] = table.pair_places(symbols[inside], symbols[inside + 1])
    while len(symbols):
        rank = np.where(place >= 0, table.ranks[place], NO_RANK)
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        sizes = np.diff(np.append(starts, len(symbols)))
        lowest = np.minimum.reduceat(rank, starts)
        over = lowest == NO_RANK
        if over.any():
            gone = np.repeat(over, sizes)
            done_symbols.append(symbols[gone])
            done_words.append(word[gone])
            stay = ~gone
            symbols, word, place, rank = symbols[stay], word[stay], place[stay], rank[stay]
            lowest, sizes = lowest[~over], sizes[~over]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, sizes))
        # of touching occurrences (aaa), every second from the left
        follows = np.concatenate(([False], np.diff(at) == 1))
        if follows.any():
            heads = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - heads) % 2 == 0]
        if table.unsafe[lowest].any():
            first = np.concatenate(([True], word[at][1:] != word[at][:-1]))
            at = at[first | ~table.unsafe[rank[at]]]
        symbols[at] = table.made[place[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, word, place = symbols[keep], word[keep], place[keep]
        # only pairs of a merged symbol are new
        at = at - np.arange(len(at))
        at = np.concatenate((at, at[at > 0] - 1))
        place[at] = -1
        at = at[at < len(word) - 1]
        at = at[word[at] == word[at + 1]]
        place[at] = table.pair_places(symbols[at], symbols[at + 1])
    if not done_symbols:
        return symbols, offsets
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    out = np.zeros(n_words + 1, np.int64)
    np.cumsum(np.bincount(word, minlength=n_words), out=out[1:])
    return symbols[order], out


def pieces(text: str) -> Iterator[str]:
    """A text in pieces, cut before white space that follows something else: no word of the patterns has that inside."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        m = _CUT.search(text, at + PIECE_CHARS)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


_CUT = regex.compile(r"(?<=\S)\s")


def lower(text: str) -> str:
    """Lower case character by character: a final sigma is as any other."""
    if text.isascii():
        return text.lower()
    if highest(text) >= NEWER_CAPITALS[0][0] and _CAPITAL.search(text):
        text = text.translate(_CAPITALS)
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


def cut(piece: str, table: Table) -> list[str]:
    """The words of a piece of text."""
    last = 0 if piece.isascii() else highest(piece)
    if last < LISTED:
        return table.listed.findall(piece)
    if last < NEWER[0][0] or not _NEWER.search(piece):
        return table.pattern.findall(piece)
    return [piece[m.start() : m.end()] for m in table.pattern.finditer(_NEWER.sub(_STAND_IN, piece))]


def words_of(text: str, table: Table) -> Iterator[list[str] | list[int]]:
    """Lists of the words of a text, and of the ids of special strings between them."""
    for part in table.special_pattern.split(text) if any(s in text for s in table.specials) else [text]:
        if part in table.specials:
            yield [table.specials[part]]
        elif part:
            if table.normalizes:
                part = lower(unicodedata.normalize("NFC", part))
            for piece in pieces(part):
                yield cut(piece, table)


class _Places(dict):
    """The place of each word; one that is not there gets the next place and is noted as new."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        self.new.append(word)
        return place


class WordStore:
    """The ids of words met before, as ragged arrays; merges the new words of many texts together. Special ids stand for themselves."""

    def __init__(self, table: Table):
        self.table = table
        self.clear()

    def clear(self) -> None:
        ids = list(self.table.specials.values())
        self.place, self.place.new = _Places(zip(ids, range(len(ids)), strict=True)), []
        self.chars = 0
        self.flat = np.array(ids, np.int32)
        self.starts = np.arange(len(ids) + 1)

    def look_up(self, lists: list[list]) -> np.ndarray:
        """The places of all words of ``lists``, one after another; they hold until the next call."""
        if len(self.place) > MAX_STORED_WORDS or self.chars > MAX_STORED_CHARS:
            self.clear()
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(lists)), np.int64, sum(map(len, lists)))
        new, self.place.new = self.place.new, []
        if new:
            symbols, offsets = merge_words(*first_symbols(new, self.table), self.table)
            self.chars += sum(map(len, new))
            self.flat = np.concatenate((self.flat, symbols.astype(np.int32)))
            self.starts = np.concatenate((self.starts, self.starts[-1] + offsets[1:]))
        return at

    def sizes(self, at: np.ndarray) -> np.ndarray:
        """How many ids the words at these places have."""
        return self.starts[at + 1] - self.starts[at]

    def ids(self, at: np.ndarray) -> np.ndarray:
        sizes = self.sizes(at)
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


GROUP_CHARS = 1 << 19


def word_groups(texts: pa.Array, table: Table) -> Iterator[tuple[list[int], list[list]]]:
    """(rows, lists of their words) of whole texts, in order, in groups of about ``GROUP_CHARS``; null is empty, a row can have several lists."""
    rows, lists, size = [], [], 0
    for row, text in enumerate(texts):
        for words in words_of(text.as_py() or "", table):
            rows.append(row)
            lists.append(words)
            size += sum(map(len, words[:100])) * max(1, len(words) // 100) if words and isinstance(words[0], str) else 1
            if size > GROUP_CHARS:
                yield rows, lists
                rows, lists, size = [], [], 0
    if rows:
        yield rows, lists


def counts_of(rows: list[int], lists: list[list], sizes: np.ndarray, n: int) -> np.ndarray:
    """The ids of each of ``n`` rows, by the ``sizes`` of the words in ``lists``."""
    sums = np.concatenate(([0], np.cumsum(sizes)))
    ends = np.cumsum(list(map(len, lists)))
    return np.bincount(rows, np.diff(sums[np.concatenate(([0], ends))]), n).astype(np.int64)
