"""Exact token counts of texts by a public byte-level BPE vocabulary.

The vocabulary file's path is a parameter; ranks are read once per worker. The
pattern that cuts text before merging never joins a word to what stands before
its blank, nor ASCII figures to letters, so counts add up over such pieces. The
pieces of many texts are found and hashed at once in numpy and only those not
seen before are encoded. A piece is known only if its bytes are those of the
piece it was hashed with: up to 16 bytes are held as two words and a length,
longer ones are looked up whole. The sums equal the counts of the whole texts.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that belongs to the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of a piece that two words hold.
LONGEST = 16
REMEMBERED = 1 << 20
BATCH_BYTES = 4 << 20
FRONT_BITS = 17

_RNG = np.random.default_rng(5)
VALUE = _RNG.integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
POWER = _RNG.integers(1, 1 << 62, LONGEST + 1, dtype=np.uint64) | np.uint64(1)
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[48:58] = 2


#: Bytes that may begin white space or figures outside ASCII; common quotes, dashes, notes and marks are none.
_MAY_JOIN = re.compile(rb"\xc2[\x85\xa0\xb2\xb3\xb9\xbc-\xbe]|[\xd9-\xdf\xe0\xe1\xe3-\xee\xf0-\xff]|\xe2(?!\x80[\x93-\xa6]|\x84\xa2|\x99)|\xef(?!\xbf\xbd|\xbb\xbf)")


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """White space and figures outside ASCII, which the byte-wise cuts don't know."""
    return frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c)[0] in "NZ" or c == "\x85")


@lru_cache(maxsize=4)
def encoding(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        self.encode = encoding(vocabulary).encode_ordinary
        self.keys = np.zeros(0, np.uint64)
        self.sizes = np.zeros(0, np.int64)
        # the first place to look: one known piece per slot of the key's top bits
        self.front_sizes = np.zeros(1 << FRONT_BITS, np.int64)
        # the bytes behind the keys: two words and a length each
        self.bytes = np.zeros((3, 0), np.uint64)
        self.front_bytes = np.zeros((3, 1 << FRONT_BITS), np.uint64)
        self.long: dict[bytes, int] = {}

    def __getstate__(self):
        raise TypeError("a counter belongs to its worker; send the vocabulary's path")

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(texts), np.int64)
        at: list[int] = []
        raw: list[bytes] = []
        size = 0
        for i, text in enumerate(texts):
            data = text.encode("utf-8", "replace")
            if len(data) > len(text) and _MAY_JOIN.search(data) and not joining().isdisjoint(text):
                out[i] = len(self.encode(text))
                continue
            at.append(i)
            raw.append(data)
            size += len(raw[-1])
            if size > BATCH_BYTES:
                out[at] = self._batch(raw)
                at, raw, size = [], [], 0
        if at:
            out[at] = self._batch(raw)
        return out

    def _batch(self, raw: list[bytes]) -> np.ndarray:
        lengths = np.array([len(r) for r in raw])
        flat = b"".join(raw)
        a = np.frombuffer(flat, np.uint8)
        if not len(a):
            return np.zeros(len(raw), np.int64)
        opens = np.zeros(len(a) + 1, bool)
        opens[np.cumsum(lengths)] = opens[0] = True
        kind = _KIND[a]
        blank = kind == 1
        before = np.r_[np.uint8(255), kind[:-1]]
        # a new kind begins a piece, unless the blank before it does
        start = opens[:-1] | ((kind != before) & ~(~blank & (np.r_[np.uint8(0), a[:-1]] == 32)))
        # the last white space before something else stands apart from the rest
        start |= blank & np.r_[~blank[1:], False] & ~opens[1:]
        first = np.flatnonzero(start)
        inside = np.zeros(len(a), np.int32)
        inside[first] = first
        np.maximum.accumulate(inside, out=inside)
        np.subtract(np.arange(len(a), dtype=np.int32), inside, out=inside)
        np.minimum(inside, LONGEST, out=inside)
        with np.errstate(over="ignore"):
            keys = np.add.reduceat(VALUE[a] * POWER[inside], first)
        end = np.r_[first[1:], len(a)]
        wide, shift = a.astype(np.uint64), (inside & 7).astype(np.uint64) << np.uint64(3)
        wide <<= shift
        held = np.stack([np.add.reduceat(np.where(inside < 8, wide, 0), first), np.add.reduceat(np.where((inside >= 8) & (inside < 16), wide, 0), first), (end - first).astype(np.uint64)])
        sizes = self._sizes(keys, held, first, end, flat)
        return np.bincount(np.searchsorted(np.cumsum(lengths), first, side="right"), weights=sizes, minlength=len(raw)).astype(np.int64)

    def _size(self, piece: bytes) -> int:
        return len(self.encode(piece.decode("utf-8")))

    def _sizes(self, keys: np.ndarray, held: np.ndarray, first: np.ndarray, end: np.ndarray, flat: bytes) -> np.ndarray:
        long = end - first > LONGEST
        front = (keys >> np.uint64(64 - FRONT_BITS)).astype(np.int64)
        sizes = self.front_sizes[front]
        rest = np.flatnonzero((self.front_bytes[:, front] != held).any(axis=0) & ~long)
        if len(rest):
            fresh, where, back = np.unique(keys[rest], return_index=True, return_inverse=True)
            mine = held[:, rest[where]]
            slot = np.searchsorted(self.keys, fresh)
            slot[slot == len(self.keys)] = 0
            known = (self.bytes[:, slot] == mine).all(axis=0) if len(self.keys) else np.zeros(len(fresh), bool)
            size = self.sizes[slot] if len(self.keys) else np.zeros(len(fresh), np.int64)
            new = np.flatnonzero(~known)
            if len(new):
                size = size.copy()
                for k in new:
                    i = rest[where[k]]
                    size[k] = self._size(flat[first[i] : end[i]])
                if len(self.keys) > REMEMBERED:
                    self.keys, self.sizes, self.bytes = self.keys[:0], self.sizes[:0], self.bytes[:, :0]
                keys_now = np.concatenate([self.keys, fresh[new]])
                order = np.argsort(keys_now, kind="stable")
                self.keys, self.sizes = keys_now[order], np.concatenate([self.sizes, size[new]])[order]
                self.bytes = np.concatenate([self.bytes, mine[:, new]], axis=1)[:, order]
            at = (fresh >> np.uint64(64 - FRONT_BITS)).astype(np.int64)
            free = self.front_bytes[2, at] == 0
            self.front_bytes[:, at[free]], self.front_sizes[at[free]] = mine[:, free], size[free]
            sizes[rest] = size[back]
            # another piece of the same key
            for i in rest[(mine[:, back] != held[:, rest]).any(axis=0)]:
                sizes[i] = self._size(flat[first[i] : end[i]])
        if len(self.long) > REMEMBERED:
            self.long.clear()
        for i in np.flatnonzero(long):
            piece = flat[first[i] : end[i]]
            size = self.long.get(piece)
            if size is None:
                size = self._size(piece)
                if len(piece) <= 256:
                    self.long[piece] = size
            sizes[i] = size
        return sizes
