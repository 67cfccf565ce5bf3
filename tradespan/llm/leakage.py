"""Held-out items that leaked into a corpus.

The corpus is cut into shards as it is read; nothing of it is shuffled. Words
of a shard that occur in no item cannot be part of a match, so the shard's
FM-index holds the phrases between them. It is built on loose word keys, which
hold for every misreading that is passed over, so that no run can lack a seed:
every phrase of ``seed`` words of the items is looked up by backward search, all
at once; located occurrences are verified and extended word by word, and runs
of at least ``least_words`` words of the item are kept.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradespan.llm.fmindex import FMIndex
from tradespan.llm.words import single, word_keys, word_places

ITEM_BLOCK = 4096
SHARD_BYTES = 4 << 20


@dataclass
class Items:
    """A block of items as word keys, with the vocabulary and the seeds."""

    seed: int
    ids: list[int]
    keys: list[np.ndarray] = field(default_factory=list)
    loose: list[np.ndarray] = field(default_factory=list)
    words: list[list[bytes]] = field(default_factory=list)
    numbers: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def build(cls, rows: list[tuple[int, str, str]], seed: int) -> Items:
        """``rows``: (id, text, instruction that the text begins with)."""
        out = cls(seed, [])
        for item, text, instruction in rows:
            body = text[len(instruction) :] if instruction and text.startswith(instruction) else text
            raw = body.encode("utf-8", "surrogatepass")
            keys, loose, _, opens, closes, flat = word_keys([raw])
            out.ids.append(item)
            out.keys.append(keys)
            out.loose.append(loose)
            out.words.append([flat[a:b] for a, b in zip(opens, closes)])
            # number of each word among all blank-separated words, so words of which no key is left count too
            if any(map(single, body)):
                # words of scripts written without blanks are not blank-separated
                out.numbers.append(np.arange(len(keys)))
                continue
            places = word_places(body)
            starts = np.array([i for i, c in enumerate(body) if not c.isspace() and (i == 0 or body[i - 1].isspace())] or [0])
            real = np.array([any(ch.isalnum() for ch in body[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(body)])])
            nth = np.cumsum(real) - 1
            at = [nth[np.searchsorted(starts, p, side="right") - 1] for p, _ in places]
            out.numbers.append(np.array(at if len(at) == len(keys) else range(len(keys)), np.int64))
        out.vocabulary = np.unique(np.concatenate([*out.loose, np.zeros(0, np.uint64)]))
        seeds: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for n, keys in enumerate(out.loose):
            ids = np.searchsorted(out.vocabulary, keys) + 1
            for p in range(len(ids) - seed + 1):
                seeds[tuple(ids[p : p + seed])].append((n, p))
        out.patterns = np.array(list(seeds), np.int64).reshape(-1, seed)
        places = list(seeds.values())
        out.seed_start = np.cumsum([0] + [len(p) for p in places])
        out.seed_item = np.array([i for p in places for i, _ in p], np.int64)
        out.seed_at = np.array([w for p in places for _, w in p], np.int64)
        return out


def nearly(a: bytes, b: bytes) -> bool:
    """Alike but for letter pairs misread as one (cl as d, li as h)."""
    return a == b or (min(len(a), len(b)) >= 4 and a.replace(b"h", b"").replace(b"d", b"e") == b.replace(b"h", b"").replace(b"d", b"e"))


def shard_matches(texts: list[bytes], items: Items, least_words: int) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, words, first word, last word) of the runs found in one shard."""
    return block_matches(word_keys(texts), len(texts), items, least_words)


def block_matches(words: tuple, n_texts: int, items: Items, least_words: int) -> list[tuple[int, int, int, int, int]]:
    """``shard_matches`` for the words of a shard and one block of items."""
    keys, loose, owner, opens, closes, flat = words
    if not len(keys) or not len(items.patterns):
        return []
    slot = np.searchsorted(items.vocabulary, loose)
    slot[slot == len(items.vocabulary)] = 0
    ids = np.where(items.vocabulary[slot] == loose, slot + 1, 0)
    # phrases of in-vocabulary words of one text, at least a seed long
    breaks = np.r_[True, (ids[1:] == 0) | (ids[:-1] == 0) | (owner[1:] != owner[:-1])]
    starts = np.flatnonzero(breaks)
    lengths = np.diff(np.r_[starts, len(ids)])
    kept = (ids[starts] > 0) & (lengths >= items.seed)
    starts, lengths = starts[kept], lengths[kept]
    if not len(starts):
        return []
    text = np.zeros(int(lengths.sum()) + len(starts), np.int64)
    offset = np.cumsum(lengths + 1) - (lengths + 1)
    place = np.repeat(offset, lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    token = np.repeat(starts, lengths) + (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    text[place] = ids[token]
    token_at = np.zeros(len(text), np.int64)
    token_at[place] = token
    index = FMIndex(text, len(items.vocabulary))
    pattern, position = index.occurrences(items.patterns)
    if not len(pattern):
        return []
    # one row per occurrence and place of the seed in the items
    fan = items.seed_start[pattern + 1] - items.seed_start[pattern]
    which = np.repeat(np.arange(len(pattern)), fan)
    at = np.repeat(items.seed_start[pattern], fan) + np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
    item, where = items.seed_item[at], items.seed_at[at]
    tok = token_at[position[which]]
    diagonal = tok - where
    order = np.lexsort((tok, diagonal, item, owner[tok]))
    doc, item, diagonal, tok = owner[tok][order], item[order], diagonal[order], tok[order]
    group = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])])
    ends = np.r_[group[1:], len(doc)]
    first_of = np.searchsorted(owner, np.arange(n_texts))
    last_of = np.searchsorted(owner, np.arange(n_texts), side="right")
    runs: dict[tuple[int, int], list[tuple[int, int, int]]] = defaultdict(list)
    for lo, hi in zip(group, ends):
        d, n, diag = int(doc[lo]), int(item[lo]), int(diagonal[lo])
        ikeys, iwords = items.keys[n], items.words[n]
        begin, stop = max(first_of[d], diag), min(last_of[d], diag + len(ikeys))
        done = -1
        for s in tok[lo:hi]:
            if s < done:
                continue
            a = b = int(s)

            def alike(t: int) -> bool:
                return keys[t] == ikeys[t - diag] or nearly(flat[opens[t] : closes[t]], iwords[t - diag])

            if not alike(a):
                continue
            while a > begin and alike(a - 1):
                a -= 1
            while b < stop and alike(b):
                b += 1
            done = b
            runs[d, n].append((a - diag, a, b))
    out = []
    for (d, n), found in runs.items():
        numbers = items.numbers[n]
        best: dict[int, tuple[int, int, int]] = {}
        joined: list[list[int]] = []
        ends: dict[tuple[int, int], list[int]] = {}
        # by place in the document, so that no other run of the item stands between the halves
        for p, a, b in sorted(found, key=lambda r: (r[1], r[0])):
            # a word torn in two, or two run together, moves the alignment by one
            near = ((q, e) for q in (p - 1, p - 2) for e in (a - 1, a - 2) if (q, e) in ends)
            at = next((x for x in near if nearly(b"".join(flat[opens[t] : closes[t]] for t in range(x[1], a)), b"".join(items.words[n][x[0] : p]))), None)
            if at is not None:
                last = ends.pop(at)
                last[1], last[3] = p + b - a, b
            else:
                last = [p, p + b - a, a, b]
                joined.append(last)
            ends[last[1], last[3]] = last
        for p, q, a, b in joined:
            words = int(numbers[q - 1] - numbers[p] + 1)
            if words >= least_words:
                best[a] = max(best.get(a, (0, 0, 0)), (words, a - int(first_of[d]), b - int(first_of[d])))
        out += [(d, n, *v) for v in best.values()]
    return out


def suite_instructions(items: DataFrame) -> dict[str, str]:
    """The sentence(s) with which all items of a suite begin; nothing where a suite has one item."""
    ends = items.where(F.col("suite").isNotNull() & F.col("text").isNotNull()).groupBy("suite").agg(F.min("text").alias("a"), F.max("text").alias("b"), F.count(F.lit(1)).alias("n"))
    out = {}
    for row in ends.where("n > 1 and a <> b").toLocalIterator():
        same = 0
        while same < min(len(row.a), len(row.b)) and row.a[same] == row.b[same]:
            same += 1
        cut = max((row.a.rfind(mark, 0, same) for mark in (". ", "! ", "? ", ": ", "\n")), default=-1)
        if cut >= 0:
            out[row.suite] = row.a[: cut + 2] if row.a[cut] != "\n" else row.a[: cut + 1]
    return out


def _scan(documents: DataFrame, items: DataFrame, least_words: int, seed: int, item_block: int, shard_bytes: int, schema: str, give: Callable[[object, list[tuple]], list[tuple]]) -> DataFrame:
    """One pass over the corpus: the passages of each document go through ``give`` (id, [(item, words, start, end)])."""
    sc = documents.sparkSession.sparkContext
    instructions = suite_instructions(items)
    wanted = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "suite", "text").sort("item_id")
    blocks = []
    block: list[tuple[int, str, str]] = []
    for row in wanted.toLocalIterator():
        block.append((row.item_id, row.text, instructions.get(row.suite, "")))
        if len(block) == item_block:
            blocks.append(sc.broadcast(Items.build(block, seed)))
            block = []
    if block:
        blocks.append(sc.broadcast(Items.build(block, seed)))
    columns = [f.split()[0] for f in schema.split(", ")]

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids, texts = part["doc_id"].to_numpy(), part["text"].tolist()
            out: list[tuple] = []
            raw: list[bytes] = []
            size = begin = 0
            for k, text in enumerate([*texts, None]):
                if raw and (text is None or size > shard_bytes):
                    words = word_keys(raw)
                    found: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
                    for each in blocks:
                        for d, n, count, a, b in block_matches(words, len(raw), each.value, least_words):
                            found[d].append((each.value.ids[n], count, a, b))
                    for d, passages in found.items():
                        places = word_places(texts[begin + d])
                        out += give(ids[begin + d], [(item, count, places[a][0], places[b - 1][1]) for item, count, a, b in passages])
                    raw, size, begin = [], 0, k
                if text is not None:
                    raw.append(text.encode("utf-8", "surrogatepass"))
                    size += len(raw[-1])
            yield pd.DataFrame(out, columns=columns)

    return documents.where(F.col("text").isNotNull()).select("doc_id", "text").mapInPandas(scan, schema)


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    least_words: int = 12,
    seed: int = 4,
    item_block: int = ITEM_BLOCK,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, item_id, words, start, end): passages of items within documents.

    ``words`` counts the item's words, ``start`` and ``end`` are characters of
    the document's text. The instruction shared by a suite is left out of its
    items. The items are the stated query set, smaller than a shard's index
    may be; they are prepared in blocks of ``item_block``, and every block is
    searched for in a shard while it is at hand, so the corpus is read once.
    Null or empty texts and items without id match nothing; repeated documents
    are each given; a passage found twice in a document gives two rows; extra
    columns are ignored.
    """
    schema = "doc_id bigint, item_id bigint, words int, start int, end int"
    return _scan(documents, items, least_words, seed, item_block, shard_bytes, schema, lambda doc, found: [(doc, *f) for f in found])


def leaked_pairs(documents: DataFrame, items: DataFrame, least_words: int = 12) -> DataFrame:
    """(doc_id, item_id), each pair once."""
    return leaked_passages(documents, items, least_words).select("doc_id", "item_id").distinct()


def merged_spans(doc: object, found: list[tuple[int, int, int, int]]) -> list[tuple]:
    """(doc, start, end, items): overlapping passages of one document merged."""
    spans: list[list] = []
    for item, _, start, end in sorted(found, key=lambda f: f[2:]):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
            spans[-1][2].add(item)
        else:
            spans.append([start, end, {item}])
    return [(doc, a, b, len(items)) for a, b, items in spans]


def removal_spans(documents: DataFrame, items: DataFrame, least_words: int = 12) -> DataFrame:
    """(doc_id, start, end, items): overlapping passages of a document merged into spans to cut out.

    They are merged where the document is read, so nothing is shuffled; rows
    that repeat a document give its spans again.
    """
    return _scan(documents, items, least_words, 4, ITEM_BLOCK, SHARD_BYTES, "doc_id bigint, start int, end int, items int", merged_spans)
