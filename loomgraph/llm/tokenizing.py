"""Byte-level BPE ids of whole texts, exactly those of the `tokenizers` library.

A text is cut into pieces (optional space and letters, digits or signs; white
space; contractions) by array operations over all code points of a block, and only
pieces not seen before by this worker go to the library. Texts with characters for
which the library's classes might differ from ours go to it whole.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from loomgraph.llm.vectext import mix64

#: The last code point for which our classes are those of the library.
LAST = 0x24F
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The endings that stay with their apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(1)
def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other; 4 left to the library."""
    import unicodedata

    out = np.full(0x110000, 4, np.uint8)
    for c in range(LAST + 1):
        kind = unicodedata.category(chr(c))
        out[c] = 1 if kind[0] == "L" else 2 if kind[0] == "N" else 0 if c in (9, 10, 11, 12, 13, 32, 0xA0) else 3
    out[[0x1C, 0x1D, 0x1E, 0x1F, 0x85]] = 4
    for c in (0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2026, 0x2192, 0x20AC):
        out[c] = 3
    return out


class Encoder:
    """Ids of many texts at once, for one worker."""

    #: Pieces remembered; beyond, the memory is emptied and fills anew.
    REMEMBER = 1_500_000

    def __init__(self, path: str, literal: bool = False):
        """literal: names of special tokens in a text are text like any other; else they
        get the special ids, as the library does by itself."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = literal
        #: Texts that hold one of these go to the library whole.
        self.apart = [t.content for t in self.library.get_added_tokens_decoder().values() if not (literal and t.special)]
        self.forget()

    def forget(self) -> None:
        self.keys, self.begin, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the offsets of each text's."""
        ids, bounds, odd = self._pieces(texts)
        if odd:
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for i, own in zip(odd, self.plain([texts[i] for i in odd]), strict=True):
                parts[i] = own
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts) if parts else ids
        return ids, bounds

    def _pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        lengths = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        n = int(bounds[-1])
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64), []
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = _classes()[code]
        odd = []
        if (kind == 4).any():
            odd = np.unique(np.searchsorted(bounds, np.flatnonzero(kind == 4), "right") - 1).tolist()
        if any(t in whole for t in self.apart):
            odd = sorted({*odd, *[i for i, text in enumerate(texts) if any(t in text for t in self.apart)]})
        first = np.zeros(n + 1, bool)
        first[bounds] = True
        change = np.empty(n, bool)
        change[0], change[1:] = True, kind[1:] != kind[:-1]
        change |= first[:n]
        # white space: a run gives its last character to what follows, joined if a space
        space = kind == 0
        solid_next = np.zeros(n, bool)
        solid_next[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
        start = change & ~space
        start |= change & space
        start |= solid_next
        joined = np.zeros(n, bool)
        joined[1:] = solid_next[:-1] & (code[:-1] == 32)
        start &= ~joined
        # contractions: an apostrophe that starts a piece, and one of the endings
        ticks = np.flatnonzero((code == 39) & start)
        for i in ticks.tolist():
            room = int(bounds[np.searchsorted(bounds, i, "right")])
            tail = code[i + 1 : min(i + 3, room)]
            two = "".join(map(chr, tail))
            end = next((e for e in ENDINGS if two.startswith(e)), None)
            if end:
                start[i + 1] = False
                if i + 1 + len(end) < room and kind[i + 1 + len(end)] == 1:
                    start[i + 1 + len(end)] = True
        begins = np.flatnonzero(start)
        ends = np.append(begins[1:], n)
        # a hash of each piece
        power = np.full(n + 1, _ODD, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        sums = np.zeros(n + 1, np.uint64)
        # the weights of a text's characters fall from its end, so no inverse is needed
        np.cumsum(mix64(code.astype(np.uint64) + np.uint64(7)) * power[:n], out=sums[1:])
        keys = mix64((sums[ends] - sums[begins]) * self._inverse(n)[begins] + (ends - begins).astype(np.uint64))
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.empty(len(ordered), bool)
        new[0], new[1:] = True, ordered[1:] != ordered[:-1]
        distinct, example = ordered[new], order[new]
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        self._learn(distinct, example, begins, ends, texts, bounds)
        at = np.searchsorted(self.keys, distinct)
        count = self.count[at][which]
        begin = self.begin[at][which]
        total = np.concatenate([[0], np.cumsum(count)])
        ids = self.ids[np.repeat(begin - total[:-1], count) + np.arange(total[-1])]
        return ids, total[np.searchsorted(begins, bounds)], odd

    _inv = np.ones(1, np.uint64)

    def _inverse(self, n: int) -> np.ndarray:
        if len(self._inv) < n:
            self._inv = np.full(n + n // 4, np.uint64(pow(int(_ODD), -1, 1 << 64)), np.uint64)
            self._inv[0] = 1
            np.multiply.accumulate(self._inv, out=self._inv)
        return self._inv

    def _learn(self, distinct, example, begins, ends, texts, bounds) -> None:
        if len(self.keys) > self.REMEMBER:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        fresh = np.flatnonzero(~known)
        if not len(fresh):
            return
        a, b = begins[example[fresh]], ends[example[fresh]]
        own = np.searchsorted(bounds, a, "right") - 1
        off = bounds[own]
        pieces = [texts[t][i:j] for t, i, j in zip(own.tolist(), (a - off).tolist(), (b - off).tolist(), strict=True)]
        found = [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        count = np.array([len(f) for f in found], np.int64)
        begin = len(self.ids) + np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
        self.ids = np.concatenate([self.ids, np.array([i for f in found for i in f], np.uint32)])
        keys = np.concatenate([self.keys, distinct[fresh]])
        order = np.argsort(keys)
        self.keys, self.begin, self.count = keys[order], np.concatenate([self.begin, begin])[order], np.concatenate([self.count, count])[order]


@lru_cache(2)
def encoder(path: str, literal: bool = False) -> Encoder:
    """The encoder of this worker process, kept from task to task."""
    return Encoder(path, literal)


def text_blocks(texts: list[str], size: int = 2_000_000):
    """Ranges of texts of about `size` characters; a longer one is alone."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        if i > first and held + len(t) > size:
            yield first, i
            first, held = i, 0
        held += len(t)
    if first < len(texts):
        yield first, len(texts)
