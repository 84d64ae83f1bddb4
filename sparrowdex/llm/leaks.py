"""Evaluation texts inside training texts: pigeonhole pieces and bit-parallel edit distance over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+").findall
MIX = 0x9E3779B97F4A7C15
#: Items are broadcast up to this many UTF-8 bytes together; beyond, they are taken in blocks of this size.
BLOCK_BYTES = 32 << 20
#: Documents, hits of pieces and passages that are taken at once.
DOCUMENTS, HITS, ROWS = 256, 1 << 18, 1 << 14


def words(text: str | None) -> list[str]:
    """Maximal runs of letters or digits, lower-cased; none for null."""
    return WORDS(text.lower()) if text else []


class WordCodes(dict):
    """64-bit codes of words, computed once each; emptied when large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h

    def of(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def runs(codes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k successive words."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = (h ^ codes[i : i + n]) * np.uint64(MIX)
            h ^= h >> np.uint64(29)
    return h


def myers(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Least edit distance of each row of `patterns` (m symbols, 64 at most) to any part of the same row of `texts`.

    Myers' bit-parallel algorithm with a row's state in one 64-bit number, all rows at once.
    """
    n, m = patterns.shape
    one, top = np.uint64(1), np.uint64(m - 1)
    bits = one << np.arange(m, dtype=np.uint64)
    pv, mv = np.full(n, (1 << m) - 1, np.uint64), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    with np.errstate(over="ignore"):
        for j in range(texts.shape[1]):
            eq = ((patterns == texts[:, j : j + 1]) * bits).sum(1, dtype=np.uint64)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            score += (ph >> top & one).astype(np.int64) - (mh >> top & one).astype(np.int64)
            ph, mh = ph << one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
            np.minimum(best, score, out=best)
    return best


class Items:
    """The test items with an index of their pieces.

    A passage is `window` successive words. With an error budget of e word edits it is cut into e + 1 pieces; e edits
    leave at least one whole. So the runs of window // (e + 1) successive words of an item, at every place, are looked
    up in a document: none of its passages with at most e edits is missed. Every hit is verified by Myers' distance of
    the passages that hold the piece.
    """

    def __init__(self, ids: list[int], texts: list[str | None], window: int, budget: int) -> None:
        if window > 64:
            raise ValueError("a passage has 64 words at most")
        self.window, self.budget, self.piece = window, budget, window // (budget + 1)
        self.ids = np.array(ids, np.int64)
        known = WordCodes()
        codes = [c if len(c) >= window else c[:0] for c in (known.of(words(t)) for t in texts)]
        size = np.fromiter(map(len, codes), np.int64, len(codes))
        self.begin = np.r_[0, np.cumsum(size)]
        self.codes = np.concatenate([np.zeros(0, np.uint64), *codes])
        h, place = runs(self.codes, self.piece), np.arange(max(0, len(self.codes) - self.piece + 1))
        owner = np.repeat(np.arange(len(codes)), size)[: len(h)]
        whole = place + self.piece <= self.begin[owner + 1] if len(h) else np.zeros(0, bool)
        order = np.argsort(h[whole], kind="stable")
        self.hashes, self.owner, self.place = h[whole][order], owner[whole][order], place[whole][order]

    def search(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item index, longest exact run of words, least distance of a passage) of documents that are
        codes[begin[i]:begin[i + 1]], for distances within the budget."""
        out = [np.zeros(0, np.int64)] * 4
        if not len(self.hashes) or len(codes) < self.piece:
            return tuple(out)
        h = runs(codes, self.piece)
        lo = np.searchsorted(self.hashes, h)
        at = np.flatnonzero(self.hashes[np.minimum(lo, len(self.hashes) - 1)] == h)
        doc = np.searchsorted(begin, at, "right") - 1
        inside = at + self.piece <= begin[doc + 1]
        at, doc = at[inside], doc[inside]
        lo = lo[at]
        count = np.searchsorted(self.hashes, h[at], "right") - lo
        found, first = [], 0
        ends = np.cumsum(count)
        while first < len(at):  # whole documents, HITS hits or so at once
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + HITS, "right")))
            last = int(np.searchsorted(doc, doc[last - 1], "right"))
            c = count[first:last]
            hit = np.repeat(np.arange(first, last), c)
            entry = np.arange(len(hit)) - np.repeat(np.cumsum(c) - c, c) + lo[hit]
            found.append(self._verified(codes, begin, doc[hit], at[hit], self.owner[entry], self.place[entry]))
            first = last
        return tuple(np.concatenate(x) for x in zip(*found)) if found else tuple(out)

    def _verified(self, codes, begin, doc, p, item, q):
        """Longest runs and least distances of pieces that stand at p in a document and at q in an item."""
        w, e, k = self.window, self.budget, self.piece
        pair = doc * (len(self.ids) + 1) + item
        order = np.lexsort((p, p - q, pair))
        doc, p, item, q, pair = (x[order] for x in (doc, p, item, q, pair))
        # pieces on one diagonal that follow each other are one exact run
        new = np.r_[True, (pair[1:] != pair[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1)][: len(p)]
        start = np.flatnonzero(new)
        longest = np.diff(np.r_[start, len(p)]) + k - 1
        pairs, one = np.unique(pair[start], return_inverse=True)
        run = np.zeros(len(pairs), np.int64)
        np.maximum.at(run, one, longest)
        # the passages that hold a run's pieces: those of its places in the item, each once
        length = np.diff(np.r_[start, len(p)])
        lowest = np.maximum(self.begin[item[start]], q[start] + k - w)
        highest = np.minimum(q[start] + length - 1, self.begin[item[start] + 1] - w)
        many = np.maximum(0, highest - lowest + 1)
        own = np.repeat(np.arange(len(start)), many)
        s = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many) + lowest[own]
        a = s + (p[start] - q[start])[own] - e
        best = np.full(len(pairs), w + 1, np.int64)
        for x in range(0, len(own), ROWS):
            o, sx, ax = own[x : x + ROWS], s[x : x + ROWS], a[x : x + ROWS]
            place = ax[:, None] + np.arange(w + 2 * e)
            d = doc[start[o]]
            good = (place >= begin[d][:, None]) & (place < begin[d + 1][:, None])
            text = np.where(good, codes[np.clip(place, 0, len(codes) - 1)], np.uint64(0))
            pattern = np.maximum(self.codes[sx[:, None] + np.arange(w)], np.uint64(1))  # 0 stands for no word
            np.minimum.at(best, one[o], myers(pattern, text))
        kept = np.flatnonzero(best <= e)
        return pairs[kept] // (len(self.ids) + 1), pairs[kept] % (len(self.ids) + 1), run[kept], best[kept]


@lru_cache(4)
def _items(ids: tuple, texts: tuple, window: int, budget: int) -> Items:
    return Items(list(ids), list(texts), window, budget)


def leaked_items(documents: DataFrame, items: DataFrame, window: int = 12, budget: int = 1) -> DataFrame:
    """(doc_id, item_id, exact_words, distance) for each document that holds a passage of an item.

    A passage is `window` successive words of the item, anywhere in the document, across line and sentence ends, with at
    most `budget` word edits; distance is the least number of edits, exact_words the longest run found unchanged (0 if
    shorter than a piece). Items shorter than `window` words have no passage. Null and empty texts match nothing;
    repeated items and documents each have their own rows. The documents are read once for each block of items of at
    most BLOCK_BYTES, the bound on what is sent to every task; no shuffle.
    """
    out = None
    for block in _blocks(items):
        part = documents.select("doc_id", "text").mapInArrow(_task(*block, window, budget), "doc_id long, item_id long, exact_words int, distance int")
        out = part if out is None else out.unionByName(part)
    return out


def _blocks(items: DataFrame) -> list[tuple[tuple, tuple]]:
    """The items, a stated query set that doesn't grow with the corpus, in blocks of bounded size, streamed one by one."""
    blocks, ids, texts, size = [], [], [], 0
    for r in items.select("item_id", "text").where("item_id IS NOT NULL").orderBy("item_id", "text").toLocalIterator():
        n = len((r.text or "").encode())
        if ids and size + n > BLOCK_BYTES:
            blocks.append((tuple(ids), tuple(texts)))
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.text)
        size += n
    return [*blocks, (tuple(ids), tuple(texts))]


def _task(ids: tuple, texts: tuple, window: int, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, known = _items(ids, texts, window, budget), WordCodes()
        for whole in batches:
            for first in range(0, whole.num_rows, DOCUMENTS):
                batch = whole.slice(first, DOCUMENTS)
                ws = [words(t) for t in batch.column(1).to_pylist()]
                codes = known.of([w for x in ws for w in x])
                doc, item, exact, distance = found.search(codes, np.r_[0, np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array(found.ids[item]), pa.array(exact.astype(np.int32)), pa.array(distance.astype(np.int32))], ["doc_id", "item_id", "exact_words", "distance"]
                )

    return run


def leak_report(documents: DataFrame, items: DataFrame, window: int = 12, budget: int = 1) -> DataFrame:
    """(item_id, split, docs, exact_docs) of every item: in how many documents it leaked, changed or not."""
    found = leaked_items(documents, items, window, budget).groupBy("item_id").agg(F.count("*").alias("docs"), F.count_if(F.col("distance") == 0).alias("exact_docs"))
    left = items.where("item_id IS NOT NULL").select("item_id", "split").distinct()
    return left.join(found, "item_id", "left").na.fill(0, ["docs", "exact_docs"])
