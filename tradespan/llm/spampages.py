"""Pages of keywords, links and product tags instead of sentences.

Every cue is reduced to a shape: how many words and segments it has, its
capitals, separators and links, and marks for what its words do (stand alone
beside links, carry tags, come again in pairs, list what other cues list).
Shapes are grouped by page; those with a mark of keywords, lists, links, tags
or offers are no sentences, and a page is flagged when they make up more than
half of its cues. ``shape_figures`` groups the shapes over the whole corpus.

Nothing is bound to a script: words are letters of any script with their
marks, signs of scripts without blanks count as words of their own, and hosts
are told by their form. A page is judged by itself as it is read, so the
corpus is not shuffled.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIME_LINE = re.compile(r"(?:\n[^\w\n]{0,8}[0-9]{1,7}[^\S\n]*)?\n[^\n>]*->[^\n]*")
ANCHOR = re.compile(r"<a\s[^>]*>", re.I)
TAGS = re.compile(r"<[^<>\n]{0,200}>|\{[^{}\n]{0,80}\}")
SOUND = re.compile(r"\[[^\[\]]{0,160}\]|\([^()]{0,160}\)")
DOT = re.compile(r"\s*[\[(]\s*d[o0]t\s*[\])]\s*", re.I)
#: A host by its form: labels without blanks, the last of two letters or more and not capitalised like a word behind a full stop.
HOST = r"\b[\w-]+(?:\.[\w-]+)*\.(?:[a-z]{2,24}|[A-Z]{2,24})\b(?:\s?/\s?\S+)?"
LINK = re.compile(rf"(?:[Hh][Tt][Tt][Pp][Ss]?://|[Ww][Ww][Ww]\.)\S+|{HOST}")
SUSPECT = re.compile(r"[#|/♪♫™\x99[({<、，；،]|www\.|dot|\w\.\w\w|,[^,]*,", re.I)
SONG = ("♪", "♫", "â™ª", "â™«", "â\x99ª", "â\x99«", "Ã¢â„¢Âª")
WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
SEGMENT = re.compile(r"[,;|•·、，；،؛]|\s/\s")
SENTENCE_END = re.compile(r"[.!?…:。！？؟۔।][\"'”’»)\]」』]*$")
CASES = (("lower", str.islower), ("upper", str.isupper), ("title", str.istitle))
NO_POINTS = str.maketrans("", "", ".,;:!?\"'-")

#: What a mark of a shape says of its cue; the first that a shape has is its kind.
KINDS = {"e": "empty", "q": "sound", "s": "song", "b": "links", "h": "tags", "p": "offers", "r": "keywords", "k": "terms"}
NON_SENTENCE = ("keywords", "terms", "links", "tags", "offers")


@dataclass(frozen=True)
class PageRule:
    """``share``: part of the cues that must be non-sentences, exceeded. ``few``: of how many shapes the share is reported besides.
    ``link_words``: most words beside a link. ``covered``: least part of a keyword run's words within repeated pairs.
    ``known``: least part of a list's words that stand in other cues."""

    share: float = 0.5
    few: int = 64
    link_words: int = 3
    covered: float = 0.4
    known: float = 0.5


@lru_cache(maxsize=1)
def any_word() -> re.Pattern:
    """Words of any script: letters and figures with combining marks; signs of scripts written without blanks one by one."""
    marks = "".join(re.escape(c) for c in map(chr, range(0x300, sys.maxunicode + 1)) if unicodedata.category(c) in ("Mn", "Mc"))
    single = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
    letter = rf"(?:(?![{single}])[^\W_]|[{marks}])"
    return re.compile(rf"[{single}]|{letter}+(?:['’\-]{letter}+)*")


def repaired(text: str) -> str:
    """Text of another script that was decoded as a Western one, put right; any other as it is."""
    for wrong in ("cp1252", "latin-1"):
        try:
            return text.encode(wrong).decode("utf-8")
        except UnicodeError:
            pass
    return text


def words_of(rest: str) -> tuple[re.Pattern, str]:
    """The pattern of words for a cue and the text to apply it to."""
    if rest.isascii():
        return WORD, rest
    plain = rest.encode("ascii", "ignore").decode()
    if 2 * len(plain.replace(" ", "")) < len(rest.replace(" ", "")):
        return any_word(), repaired(rest)
    # encoding damage tears words of Western scripts; what is ASCII of a word stands for it
    return WORD, plain


def cue_texts(text: str) -> list[str]:
    """Bodies of the cues, line ends unified; what stands before the first time is none."""
    text = "\n" + text.replace("\r\n", "\n").replace("\r", "\n")
    return TIME_LINE.split(text)[1:]


def _bucket(n: int) -> str:
    return str(n) if n < 4 else "4-6" if n < 7 else "7-12" if n < 13 else "13+"


def kind_of(shape: str) -> str:
    """Kind of the cues of a shape, by its marks."""
    marks = shape.rsplit(":", 1)[1]
    return next((kind for mark, kind in KINDS.items() if mark in marks), "sentence")


def page_cues(text: str, rule: PageRule = PageRule()) -> list[str]:
    """Shape of every cue of a page: words, segments, case, separators, links, end and marks."""
    out: list[str] = []
    lists: list[tuple[int, bool, list[list[str]]]] = []
    seen: Counter[str] = Counter()
    listed: Counter[str] = Counter()
    told: set[tuple[str, ...]] = set()
    for body in cue_texts(text):
        tail = body.rstrip()
        if tail and tail[-1] in ".!?" and not SUSPECT.search(body):
            plain_words = body.translate(NO_POINTS).lower().split()
            # a run of repeated pairs has few different words
            if len(plain_words) < 4 or 5 * len(set(plain_words)) > 4 * len(plain_words):
                out.append(f"{_bucket(len(plain_words))}w1s:::0l.:")
                continue
        anchors = len(ANCHOR.findall(body)) if "<a" in body or "<A" in body else 0
        plain = TAGS.sub(" ", body) if "<" in body or "{" in body else body
        song = any(mark in plain for mark in SONG)
        plain = " ".join(plain.split()).lstrip("->*# " if plain.lstrip().startswith(("- ", "> ", "* ")) else " ")
        if "d" in plain and ("dot" in plain or "d0t" in plain or "DOT" in plain):
            plain = DOT.sub(".", plain)
        links = LINK.findall(plain) if "." in plain or "/" in plain else []
        rest = LINK.sub(" ", plain) if links else plain
        pattern, rest = words_of(rest)
        segments = [w for w in (pattern.findall(s.lower()) for s in SEGMENT.split(rest)) if w]
        words = [w for s in segments for w in s]
        bare = SOUND.sub(" ", plain).strip() if "[" in plain or "(" in plain else plain
        ended = SENTENCE_END.search(bare) is not None
        hashed = plain.count("#") if "#" in plain else 0
        marks = ""
        if not bare:
            marks = "q" if plain else "e"
        elif song or (len(plain) > 2 and plain[0] == plain[-1] and plain[0] in "\ufffd?"):
            marks = "s"
        elif (links or anchors) and len(words) <= rule.link_words * max(1, len(links)) and len(words) <= rule.link_words + len(links):
            marks = "b"
        elif hashed >= 2 and 2 * hashed >= len(plain.split()):
            marks = "h"
        elif " | " in plain:
            marks = "p"
        elif len(words) >= 4:
            pairs = Counter(pair for s in segments for pair in zip(s, s[1:]) if pair[0] != pair[1])
            again = sum(2 * n for n in pairs.values() if n > 1)
            if again >= rule.covered * len(words):
                marks = "r"
            elif len(segments) >= 3 and all(len(s) <= 5 for s in segments):
                lists.append((len(out), ended, segments))
        if marks in ("r", "") and not ended:
            seen.update(set(words))
        if (marks == "r" or (lists and lists[-1][0] == len(out))) and (key := tuple(words)) not in told:
            # a cue said again is no other list
            told.add(key)
            listed.update(set(words))
        case = next((name for name, test in CASES if test(rest.strip())), "mixed")
        apart = "".join(m for m in ",|/#" if m in rest)
        out.append(f"{_bucket(len(words))}w{_bucket(len(segments))}s:{case}:{apart}:{_bucket(len(links))}l{'.' if ended else ''}:{marks}")
    # lists of different terms: most words stand in other cues of the page, those of lists that end like sentences in other lists
    for at, ended, segments in lists:
        words = [w for s in segments for w in s]
        known = listed if ended else seen
        if sum(known[w] > 1 for w in words) >= rule.known * len(words):
            out[at] += "k"
    return out


def cue_shapes(text: str, rule: PageRule = PageRule()) -> list[tuple[str, str]]:
    """(kind, shape) of every cue of a page."""
    return [(kind_of(shape), shape) for shape in page_cues(text, rule)]


def spam_share(shapes: list[tuple[str, str]], few: int | None = None) -> float:
    """Part of a page's cues that are non-sentences, or that its ``few`` most frequent non-sentence shapes make up."""
    if not shapes:
        return 0.0
    found = Counter(shape for kind, shape in shapes if kind in NON_SENTENCE)
    return sum(n for _, n in found.most_common(few)) / len(shapes)


def page_shapes(documents: DataFrame, rule: PageRule = PageRule()) -> DataFrame:
    """(doc_id, cues, spam_share, few_share, top_shape) of every page.

    spam_share counts all non-sentences, few_share those of the page's
    ``rule.few`` most frequent shapes. A null or empty text, or one without
    cues, has no cues and shares 0. Repeated rows are each given; extra
    columns are ignored.
    """
    schema = "doc_id bigint, cues int, spam_share double, few_share double, top_shape string"

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc, text in zip(part["doc_id"], part["text"]):
                shapes = cue_shapes(text, rule) if isinstance(text, str) else []
                top = Counter(s for _, s in shapes).most_common(1)
                out.append((doc, len(shapes), spam_share(shapes), spam_share(shapes, rule.few), top[0][0] if top else None))
            yield pd.DataFrame(out, columns=["doc_id", "cues", "spam_share", "few_share", "top_shape"])

    return documents.select("doc_id", "text").mapInPandas(judge, schema)


def shape_figures(documents: DataFrame, rule: PageRule = PageRule()) -> DataFrame:
    """(shape, kind, pages, cues, flagged_pages, flagged_cues) of every shape of the corpus.

    ``pages`` and ``cues`` have the shape; ``flagged`` are those of flagged
    pages. One row per page and shape is grouped by shape, counted before it is
    shuffled; the number of shapes is bounded by their make.
    """
    schema = "shape string, kind string, cues int, flagged boolean"

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for text in part["text"]:
                shapes = cue_shapes(text, rule) if isinstance(text, str) else []
                flagged = spam_share(shapes) > rule.share
                out += [(shape, kind, n, flagged) for (kind, shape), n in Counter(shapes).items()]
            yield pd.DataFrame(out, columns=["shape", "kind", "cues", "flagged"])

    rows = documents.select("text").mapInPandas(count, schema)
    return rows.groupBy("shape", "kind").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("cues").alias("cues"), F.count(F.when(F.col("flagged"), 1)).alias("flagged_pages"), F.coalesce(F.sum(F.when(F.col("flagged"), F.col("cues"))), F.lit(0)).alias("flagged_cues")
    )


def spam_pages(documents: DataFrame, rule: PageRule = PageRule()) -> DataFrame:
    """(doc_id) of pages of which non-sentences make up more than ``rule.share``."""
    return page_shapes(documents, rule).where(F.col("spam_share") > rule.share).select("doc_id")
