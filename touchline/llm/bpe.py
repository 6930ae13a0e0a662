"""Token ids of the byte-level BPE library, with each distinct word piece encoded once a worker.

The library splits a text into pieces (letters, digits, other marks, white space; a space joins the piece
after it) and merges bytes within a piece only. So the ids of a text are those of its pieces, and a piece
that was met before needs no second encoding. Pieces are found with whole-array operations for texts of
Latin characters and looked up by a hash, after which their characters are compared with the known piece's; all others, and texts with contractions or special strings, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np

from .common import _ODD, _ODD_INVERSE, mixed, powers

#: Character classes are tabulated below this code point, where Unicode versions agree.
LATIN = 0x250
#: Longer pieces are looked up by their string, not by hash.
LONG = 64
#: Distinct pieces a worker keeps; beyond it starts anew.
KEEP = 1 << 21

SPACE, LETTER, DIGIT, OTHER, EDGE = range(5)
_EDGE = "￿"
#: Contractions that the library's pattern splits off (fixed values).
_CONTRACTION = re.compile(r"'(?:s|t|re|ve|m|ll|d)")
_NOT_LATIN = re.compile(r"[^\x00-ɏ]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def library(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _classes() -> np.ndarray:
    import regex

    kinds = np.full(0x10000, OTHER, dtype=np.uint8)
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (DIGIT, r"\p{N}")):
        found = regex.compile(pattern)
        for c in range(LATIN):
            if found.fullmatch(chr(c)):
                kinds[c] = kind
    kinds[ord(_EDGE)] = EDGE
    return kinds


def merger(path: str):
    """Ids of single pieces, by the same merges as the library and much faster; None where the file doesn't allow it.

    The file must hold byte-level merges in the order of their ids, so that the id is the merge's rank.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type") != "BPE" or model.get("unk_token") or model.get("end_of_word_suffix"):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = model["vocab"]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printed)]
    byte_of = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in piece): i for piece, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Encoder:
    """Ids or counts of whole texts, as the library gives them without added special tokens."""

    def __init__(self, path: str):
        self.library = library(path)
        self.single = merger(path)
        self.kinds = _classes()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.salts = np.random.default_rng(2027).integers(1, 1 << 63, 0x10000, dtype=np.uint64)
        self._empty()

    def _empty(self) -> None:
        """Forget all pieces. slot: open addressing of a piece's key to its number."""
        self.key = np.zeros(2 * KEEP, np.uint64)
        self.slot = np.zeros(2 * KEEP, np.int32)
        self.long: dict[str, int] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.spelt = np.zeros(1 << 16, np.int64)  # where a piece's characters begin in letters
        self.letters = np.zeros(1 << 18, np.uint16)
        self.n = self.used = self.written = 0

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Numbers of new pieces."""
        if self.single:
            got = [self.single(p) for p in pieces]
        else:
            got = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        m, more = len(got), int(lengths.sum())
        while self.n + m > len(self.start):
            self.start, self.length, self.spelt = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.spelt))
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.length[self.n : self.n + m] = lengths
        self.start[self.n : self.n + m] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + more] = np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=more)
        codes = np.frombuffer("".join(pieces).encode("utf-16-le"), dtype=np.uint16)
        while self.written + len(codes) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.letters[self.written : self.written + len(codes)] = codes
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=m)
        self.spelt[self.n : self.n + m] = self.written + np.cumsum(sizes) - sizes
        self.n, self.used, self.written = self.n + m, self.used + more, self.written + len(codes)
        return np.arange(self.n - m, self.n)

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of known keys, -1 for others."""
        mask, out = np.uint64(len(self.key) - 1), np.full(len(keys), -1, np.int64)
        todo, at = np.arange(len(keys)), keys & np.uint64(len(self.key) - 1)
        while len(todo):
            there = self.key[at]
            same = there == keys[todo]
            out[todo[same]] = self.slot[at[same]]
            on = ~same & (there != 0)
            todo, at = todo[on], (at[on] + np.uint64(1)) & mask
        return out

    def _store(self, keys: np.ndarray, numbers: np.ndarray) -> None:
        mask = np.uint64(len(self.key) - 1)
        todo, at = np.arange(len(keys)), keys & mask
        while len(todo):
            free = self.key[at] == 0
            self.key[at[free]] = keys[todo[free]]
            won = free & (self.key[at] == keys[todo])
            self.slot[at[won]] = numbers[todo[won]]
            todo, at = todo[~won], (at[~won] + np.uint64(1)) & mask

    def plain(self, text: str) -> bool:
        """Whether the pieces of text may be found by character class alone."""
        if not text.isascii() and _NOT_LATIN.search(text):
            return False
        if "'" in text and _CONTRACTION.search(text):
            return False
        return not any(x in text for x in self.special)

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The text and the known number of each piece, in order."""
        big = _EDGE + _EDGE.join(texts) + _EDGE
        codes = np.frombuffer(big.encode("utf-16-le"), dtype=np.uint16)
        kind = self.kinds[codes]
        start = np.empty(len(codes), dtype=bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == EDGE
        # The last white-space character before a piece stands alone, or joins the piece if it is a space.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != EDGE))
        start[last] = True
        start[last[codes[last] == 32] + 1] = False
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(codes))
        inner = kind[at] != EDGE
        doc = np.cumsum(~inner)[inner] - 1
        at, end = at[inner], end[inner]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.salts[codes] * powers(len(codes), _ODD))])
        keys = mixed((total[end] - total[at]) * powers(len(codes) + 1, _ODD_INVERSE)[at])
        keys = (keys & np.uint64(0xFFFFFFFFFFFFFF80)) | np.minimum(end - at, 127).astype(np.uint64)
        number, long = self._look(keys), end - at > LONG
        new = np.flatnonzero((number < 0) & ~long)
        if len(new):
            _, one = np.unique(keys[new], return_index=True)
            if self.n + len(one) > KEEP:  # a bound of memory; what is dropped is encoded again
                self._empty()
                new = np.flatnonzero(~long)
                _, one = np.unique(keys[new], return_index=True)
            one = new[one]
            self._store(keys[one], self._learn([big[a:b] for a, b in zip(at[one].tolist(), end[one].tolist())]))
            number[new] = self._look(keys[new])
        # What a hash found must be spelt like it; pieces tile the text, so their characters stand in order.
        number[long] = 0
        size, shown = end - at, codes[kind != EDGE]
        offset = np.repeat(self.spelt[number] - (np.cumsum(size) - size), size) + np.arange(len(shown))
        wrong = self.letters[np.minimum(offset, len(self.letters) - 1)] != shown
        if wrong.any():
            long[np.repeat(np.arange(len(at)), size)[wrong]] = True
        for i in np.flatnonzero(long).tolist():
            piece = big[at[i] : end[i]]
            if piece not in self.long:
                self.long[piece] = int(self._learn([piece])[0])
            number[i] = self.long[piece]
        return doc, number

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), dtype=np.int64)
        plain = [i for i, t in enumerate(texts) if self.plain(t)]
        if plain:
            doc, number = self._pieces([texts[i] for i in plain])
            out[plain] = np.bincount(doc, weights=self.length[number], minlength=len(plain)).astype(np.int64)
        for i in set(range(len(texts))) - set(plain):
            out[i] = len(self.library.encode(texts[i], add_special_tokens=False).ids)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.plain(t)]
        if plain:
            doc, number = self._pieces([texts[i] for i in plain])
            n = self.length[number]
            ends = np.cumsum(n)
            flat = self.flat[np.repeat(self.start[number] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
            per = np.bincount(doc, weights=n, minlength=len(plain)).astype(np.int64)
            for i, part in zip(plain, np.split(flat, np.cumsum(per)[:-1])):
                out[i] = part
        for i, x in enumerate(out):
            if x is None:
                out[i] = np.asarray(self.library.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
