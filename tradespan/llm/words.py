"""Robust words of subtitle text, vectorised over many documents.

Two writings of a word get one key when they differ by letter case,
punctuation, accents, encoding damage (however often applied, or lossy) or the
usual misreadings of characters: what is outside ASCII in words of Western
scripts is dropped, so are i, l, 1 and doubled s; 0, 5, c, f, b are read as o,
s, e, t, h; rn and vv as m and w. Words of which nothing is left are skipped.

Letters of other scripts are compared without case, marks and width; each
becomes a fixed run of plain letters. Signs of scripts written without blanks
are words of their own.

Beside its key a word has a loose one, which also holds for letter pairs
misread as one (cl as d, li as h).

Cue numbers, times, markup and sound descriptions in brackets are removed
first; a bracket is closed within its cue, however long it is.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

TIMES = re.compile(rb"(?:\n[^\w\n]{0,8}[0-9]{1,7}[^\S\n]*)?\n[^\n>]*->[^\n]*")
#: Stands where a time line was, so that no bracket reaches over it.
CUE = b"\x02"
MARKUP = re.compile(rb"<[^<>\n]*>|\{[^{}\n]*\}|\[[^\[\]\x02]*\]|\([^()\x02]*\)")

ENTITY = re.compile(rb"&(?:#[0-9]{1,6}|#x[0-9a-fA-F]{1,5}|[A-Za-z]{2,8});")

_SPLIT = b" \t\v\f-/,;:.=~*_+&|\x00\x02"
_FOLD = {b"0": b"o", b"5": b"s", b"c": b"e", b"f": b"t", b"b": b"h"}


def _tables() -> tuple[bytes, bytes]:
    table, drop = bytearray(range(256)), bytearray()
    for code in range(256):
        char = bytes([code]).lower()
        if bytes([code]) == b"\n":
            continue
        if bytes([code]) in [bytes([s]) for s in _SPLIT]:
            table[code] = 32
        elif code < 128 and char.isalnum() and char not in (b"i", b"l", b"1"):
            table[code] = _FOLD.get(char, char)[0]
        else:
            drop.append(code)
    return bytes(table), bytes(drop)


TABLE, DROP = _tables()
_RNG = np.random.default_rng(20240101)
VALUE = _RNG.integers(1, 1 << 62, 256, dtype=np.uint64) | np.uint64(1)
VALUE[:33] = 0
POWER = _RNG.integers(1, 1 << 62, 64, dtype=np.uint64) | np.uint64(1)
LOOSE_DROP = ord("h")
LOOSE = VALUE.copy()
LOOSE[LOOSE_DROP], LOOSE[ord("d")] = 0, VALUE[ord("e")]
NONE = np.zeros(0, np.uint64)


#: First bytes of letters of other than Western scripts.
FOREIGN = re.compile(rb"[\xcd-\xdf\xe0\xe3-\xed\xf0]|\xe1[\x80-\xb7]|\xef[\xa4-\xba\xbc-\xbe]")
_PLAIN = "adegjkopquxyz236"  # letters that folding leaves alone


@lru_cache(maxsize=1 << 16)
def transliterated(c: str) -> str:
    """Plain letters for a letter of another script, blanks for its points; Western letters and signs as they are."""
    code = ord(c)
    if code < 0x370 or 0x1E00 <= code < 0x1F00 or 0x2000 <= code < 0x2C00 or code in (0xFEFF, 0xFFFD):
        return c
    if unicodedata.category(c)[0] == "M":
        return ""
    out = []
    for x in unicodedata.normalize("NFKD", c).casefold():
        kind = unicodedata.category(x)
        if kind[0] == "M":
            continue
        if ord(x) < 128:
            out.append(x)
        elif kind == "Nd":
            out.append(str(unicodedata.digit(x)))
        elif kind[0] in "LN":
            n = ord(x) % 4093
            out.append(_PLAIN[n >> 8] + _PLAIN[n >> 4 & 15] + _PLAIN[n & 15])
        else:
            out.append(" ")
    word = "".join(out)
    return f" {word} " if single(c) else word


def single(c: str) -> bool:
    """Whether a sign is a word of its own: scripts written without blanks."""
    n = ord(c)
    return 0x0E00 <= n < 0x0F00 or 0x1000 <= n < 0x10A0 or 0x1780 <= n < 0x1800 or 0x3040 <= n < 0x3100 or 0x3400 <= n < 0xA000 or 0xF900 <= n < 0xFB00 or 0x20000 <= n < 0x32000


#: Runs of other scripts that no Western letter touches; one that is touched is damage of an accent.
_RUN = re.compile("(?<![0-9A-Za-z\u00c0-\u024f])[\u0370-\u1dff\u1f00-\u1fff\u2c00-\ufefe\uff00-\uffef\U00010000-\U0003ffff]+(?![0-9A-Za-z\u00c0-\u024f])")


def is_foreign(raw: bytes) -> bool:
    return FOREIGN.search(raw) is not None


def plain_parts(text: str) -> list[str]:
    """What stands for each character: plain letters for words of other scripts, the rest as it is.

    A single letter of another script is as often a damaged accent as a word,
    so it has no key in any text, unless its script is written without blanks.
    """
    parts = list(text)
    for run in _RUN.finditer(text):
        told = [transliterated(c) for c in run.group()]
        if sum(t.strip() != "" for t in told) > 1 or any(single(c) for c in run.group()):
            parts[run.start() : run.end()] = told
    return parts


def unify(raw: bytes) -> bytes:
    """Plain line ends; non-breaking blanks, also damaged ones, out of the way; other scripts in plain letters."""
    if is_foreign(raw):
        raw = "".join(plain_parts(raw.decode("utf-8", "surrogatepass"))).encode("utf-8", "surrogatepass")
    return raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n").replace(b"\xc3\x83\xc2\xa0", b"\xc3\x83").replace(b"\xc2\xa0", b" ")


def fold(raw: bytes) -> bytes:
    """Folded words apart by blanks; line feeds stay."""
    return raw.translate(TABLE, DROP).replace(b"rn", b"m").replace(b"vv", b"w").replace(b"ss", b"")


def word_keys(texts: list[bytes], cleaned: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(key, loose key, text number, start, end, folded bytes) of the words of all texts, in order."""
    raw = (b"\n" + CUE + b"\x01" + CUE + b"\n").join(unify(t).replace(b"\x01", b" ").replace(CUE, b" ") for t in texts)
    if cleaned:
        raw = MARKUP.sub(b" ", ENTITY.sub(b"'", TIMES.sub(b"\n" + CUE, b"\n" + raw)))
    parts = raw.split(b"\x01")
    flat = b"\n".join(fold(p.replace(b"\n", b" ")) for p in parts)
    a = np.frombuffer(flat, np.uint8)
    if not len(a):
        return NONE, NONE, *[np.zeros(0, np.int64)] * 3, flat
    blank = a <= 32
    opens = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    closes = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    if not len(opens):
        return NONE, NONE, *[np.zeros(0, np.int64)] * 3, flat
    inside = np.arange(len(a), dtype=np.int32)
    origin = np.zeros(len(a), np.int32)
    origin[opens] = opens
    np.maximum.accumulate(origin, out=origin)
    inside -= origin
    # the loose key passes over h, at whatever place, and reads d as e
    behind = np.cumsum(a == LOOSE_DROP, dtype=np.int32)
    loose = np.maximum(inside - (behind - behind[origin] + (a[origin] == LOOSE_DROP)), 0)
    np.minimum(inside, 63, out=inside)
    np.minimum(loose, 63, out=loose)
    with np.errstate(over="ignore"):
        keys = np.add.reduceat(VALUE[a] * POWER[inside], opens)
        loose_keys = np.add.reduceat(LOOSE[a] * POWER[loose], opens)
    text = np.searchsorted(np.flatnonzero(a == 10), opens)
    return keys, loose_keys, text, opens, closes, flat


def word_places(text: str) -> list[tuple[int, int]]:
    """(start, end) in characters of each word that ``word_keys`` gives for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    if not is_foreign(raw):
        return _places(text)
    # where each character of the transliterated text comes from
    parts = plain_parts(text)
    at = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    out = []
    for a, b in _places("".join(parts)):
        end = int(at[b - 1]) + 1
        while end < len(parts) and not parts[end]:
            end += 1  # marks belong to the letter before them
        out.append((int(at[a]), end))
    return out


def _places(text: str) -> list[tuple[int, int]]:
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    wide = raw.replace(b"\r\n", b" \n").replace(b"\r", b"\n").replace(b"\xc3\x83\xc2\xa0", b"\xc3\x83  ").replace(b"\xc2\xa0", b"  ")
    wide = wide.replace(b"\x01", b" ").replace(b"\x00", b" ").replace(CUE, b" ")
    keep = lambda m: bytes(10 if c == 10 else 32 for c in m.group())
    # a time line has room for the sign that stands for it
    wide = TIMES.sub(lambda m: keep(m)[:-1] + CUE, b"\n" + wide)
    wide = MARKUP.sub(keep, ENTITY.sub(lambda m: b"'" * len(m.group()), wide))[1:]
    assert len(wide) == n
    out = []
    split = re.escape(_SPLIT)
    char_at = None
    for m in re.finditer(rb"[^\n" + split + rb"]+", wide):
        if fold(m.group()).strip():
            if char_at is None:
                lead = np.frombuffer(raw, np.uint8)
                char_at = np.r_[0, np.cumsum((lead & 0xC0) != 0x80)]
            out.append((int(char_at[m.start()]), int(char_at[m.end()])))
    return out
