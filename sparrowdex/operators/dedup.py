"""Exact and near duplicates by fingerprints; Bloom filters as relations."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import md5
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowdex.session import through_table

BITS = 64
#: Of near duplicates: bits of a block that tell its cells, rows in a part of a cell, and candidates that are looked at at once.
PARTED, CELL, PAIRS = 10, 1 << 17, 1 << 20


def simhash(text: str | None) -> int | None:
    """The fingerprint of a text as a signed 64-bit number; none below three words."""
    ws = re.sub(r"[^a-z0-9_\s]", " ", (text or "").lower(), flags=re.A).split()
    if len(ws) < 3:
        return None
    count: dict[str, int] = {}
    for i in range(len(ws) - 2):
        s = " ".join(ws[i : i + 3])
        count[s] = count.get(s, 0) + 1
    digests = np.frombuffer(b"".join(md5(s.encode()).digest()[:8] for s in count), np.uint8).reshape(-1, 8)
    w = np.fromiter(count.values(), np.int64, len(count)) ** 2
    votes = (w[:, None] * (2 * np.unpackbits(digests, axis=1, bitorder="little").astype(np.int64) - 1)).sum(0)
    return int(np.packbits(votes >= 0, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) by SimHash: for each distinct 3-word shingle with count f, bit i gains f * f if the bit of its MD5 is set,
    else loses it; a bit of the fingerprint is 1 if its sum isn't negative.

    Texts of fewer than three words (null, empty) have no fingerprint, so they aren't taken for equal. One pass over
    Arrow batches without a shuffle, as a document's votes need no other document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([simhash(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], [key, "fp"]).filter(fp.is_valid())

    return docs.select(key, text).mapInArrow(run, f"{key} long, fp long")


def bands(fp: DataFrame, count: int = 16, key: str = "doc_id") -> DataFrame:
    """(key, band, value, fp): the fingerprint's `count` bands."""
    width = math.ceil(BITS / count)
    value = lambda b: F.shiftrightunsigned("fp", b * width).bitwiseAND(F.lit((1 << width) - 1))
    parts = F.array(*[F.struct(F.lit(b).alias("band"), value(b).alias("value")) for b in range(count)])
    return fp.select(key, "fp", F.explode(parts).alias("p")).select(key, "p.band", "p.value", "fp")


def _masks(start: int, parts: int) -> list[np.uint64]:
    """Masks of the bits from `start` on, cut into parts of nearly equal width."""
    cuts = [start + round((BITS - start) * i / parts) for i in range(parts + 1)]
    return [np.uint64((1 << hi) - (1 << lo)) for lo, hi in pairwise(cuts)]


def _meeting(fp: np.ndarray, side: np.ndarray, mask: np.uint64, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, bits that differ) of the positions that agree under the mask and differ in at most `most` bits, PAIRS candidates
    at a time. If there are two sides, only pairs across them."""
    n, key = len(fp), fp & mask
    order = np.lexsort((side, key)) if side.any() else np.argsort(key)
    f, k = fp[order], key[order]
    starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    lengths = np.diff(np.r_[starts, n])
    ends = np.repeat(starts + lengths, lengths)
    if side.any():  # in a run of equal keys those of side 0 come first and meet those of side 1
        s = side[order]
        begins = np.repeat(starts + np.add.reduceat(1 - s, starts), lengths)
        count = np.where(s == 1, 0, ends - begins)
    else:
        begins = np.arange(1, n + 1)
        count = ends - begins
    total = np.cumsum(count)
    at, done = 0, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, done + PAIRS, "right")))
        c, upto = count[at:to], total[at:to] - done
        y = np.arange(upto[-1]) + np.repeat(begins[at:to] - (upto - c), c)
        differ = np.repeat(f[at:to], c) ^ f[y]
        hit = np.flatnonzero(np.bitwise_count(differ) <= most)
        if len(hit):
            yield order[at + np.searchsorted(upto, hit, "right")], order[y[hit]], differ[hit]
        at, done = to, int(total[to - 1])


def near_pairs(fp: np.ndarray, side: np.ndarray, shared: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(x, y, distance) of positions at most `most` bits apart, for which block `shared` of the most + 2 is the first they share.

    The blocks before it differ in a bit each, so the bits behind it differ in most - shared at most: cut into r blocks more
    than that, they share at least r. All choices of r blocks are keys; r is the one that costs least at this number of rows.
    A pair is kept at the first key that it shares only.
    """
    outer = _masks(0, most + 2)
    start = round(BITS * (shared + 1) / (most + 2))
    left, n = most - shared, len(fp)
    met = lambda r: n * n / 2 ** (1 + r * (BITS - start) / max(1, left + r))
    keys = min(range(5), key=lambda r: math.comb(left + r, r) * (30_000 + 60 * n + 10 * met(r)))  # nanoseconds
    inner = _masks(start, max(1, left + keys))
    for chosen in combinations(range(left + keys), keys):
        mask = np.bitwise_or.reduce([outer[shared], *(inner[i] for i in chosen)])
        unshared = outer[:shared] + [inner[i] for i in range(chosen[-1] if chosen else 0) if i not in chosen]
        for x, y, differ in _meeting(fp, side, mask, most):
            first = np.all([differ & m != 0 for m in unshared], axis=0) if unshared else np.ones(len(x), bool)
            yield x[first], y[first], np.bitwise_count(differ[first]).astype(np.int32)


def near_duplicates(fp: DataFrame, most: int = 3, key: str = "doc_id") -> DataFrame:
    """(a, b, distance) of different fingerprints at most `most` bits apart, each standing for all documents that have it.

    Equal fingerprints are one row first, so copies aren't paired; these rows go through a table. The 64 bits are cut into
    most + 2 blocks, of which two such fingerprints share at least two. A fingerprint is sent to a cell for each block but the
    last, by PARTED bits of its value, and the pairs whose first shared block this is are looked for in arrays (`near_pairs`).
    That is most + 1 rows a fingerprint and no join, so nothing is broadcast whose size Spark misjudges (it takes exploded
    rows for as many as there were before). Cells of more than CELL rows are split into parts of which any two meet
    in a cell of their own; to tell them at most (most + 1) * 2 ** PARTED counts come to the driver.
    """
    one = through_table(fp.where(F.col(key).isNotNull() & F.col("fp").isNotNull()).groupBy("fp").agg(F.min(key).alias(key)), "fingerprints")
    cuts = [round(BITS * i / (most + 2)) for i in range(most + 3)]
    value = lambda i: F.shiftrightunsigned("fp", cuts[i]).bitwiseAND(F.lit((1 << min(PARTED, cuts[i + 1] - cuts[i])) - 1))
    rows = one.select("fp", key, F.explode(F.array(*[value(i) + F.lit(i << PARTED) for i in range(most + 1)])).alias("v"))
    large = [(r.v, -(-r["count"] // CELL)) for r in rows.groupBy("v").count().where(F.col("count") > CELL).collect()]
    if large:
        rows = rows.join(F.broadcast(fp.sparkSession.createDataFrame(large, "v long, parts long")), "v", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        rows = rows.withColumn("p", F.pmod(F.xxhash64("fp"), "parts")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    else:
        rows = rows.withColumn("p", F.lit(0)).withColumn("q", F.lit(0))
    cell = F.shiftleft(F.shiftleft("v", 20) + F.least("p", "q"), 20) + F.greatest("p", "q")
    cells = rows.select(cell.alias("cell"), (F.col("p") > F.col("q")).cast("long").alias("side"), "fp", key).repartition("cell").sortWithinPartitions("cell")

    def near(held: list[pa.RecordBatch], cell: int) -> Iterator[pa.RecordBatch]:
        """The pairs of a cell."""
        t = pa.Table.from_batches(held)
        ids = t.column(3).to_numpy()
        for x, y, d in near_pairs(t.column(2).to_numpy().view(np.uint64), t.column(1).to_numpy(), cell >> 40 + PARTED, most):
            x, y = ids[x], ids[y]
            less, other = x < y, x != y
            yield pa.RecordBatch.from_arrays([pa.array(np.where(less, x, y)[other], t.schema.field(3).type), pa.array(np.where(less, y, x)[other], t.schema.field(3).type), pa.array(d[other])], ["a", "b", "distance"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = -1
        for b in batches:
            c = b.column(0).to_numpy()
            for lo, hi in pairwise([0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]):
                if lo < hi and c[lo] != last:
                    if held:
                        yield from near(held, last)
                    held, last = [], int(c[lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from near(held, last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[pa.RecordBatch] = []
        for b in found(batches):
            small.append(b)
            if sum(map(len, small)) >= 10_000 or len(small) > 1000:
                yield from pa.Table.from_batches(small).combine_chunks().to_batches(10_000)
                small = []
        if small:
            yield from pa.Table.from_batches(small).combine_chunks().to_batches(10_000)

    kind = fp.schema[key].dataType.simpleString()
    return cells.mapInArrow(run, f"a {kind}, b {kind}, distance int")


def near_copies(new: DataFrame, known: DataFrame, most: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of new documents whose fingerprint is at most `most` bits from one of `known` (key, fp): copies, edited or not."""
    asked = through_table(fingerprints(new, key, text), "asked")
    both = asked.select("fp", F.lit(1).alias("new")).unionByName(known.select("fp", F.lit(0).alias("new"))).groupBy("fp").agg(F.max("new").alias("asked"), F.min("new").alias("own"))
    marked = through_table(both.select(F.col("fp").alias(key), "fp", "asked", (F.col("own") == 0).alias("known")), "marked")
    pairs = near_duplicates(marked.select(key, "fp"), most, key)
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    hit = ends.join(marked.where("known").select(F.col(key).alias("y")), "y", "left_semi").select("x").union(marked.where("known AND asked = 1").select("fp")).distinct()
    return asked.join(hit.select(F.col("x").alias("fp")), "fp", "left_semi").select(key)


def fingerprint_classes(docs: DataFrame, fp: DataFrame, most: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, class, links) of every document: the least id with its fingerprint, and how many other classes are at most `most` bits from it.

    Different texts with one fingerprint have one class; `near_duplicates` has the links between classes. Documents without
    a fingerprint are their own class, without links.
    """
    members = fp.join(fp.groupBy("fp").agg(F.min(key).alias("class")), "fp").select(key, "class")
    degree = near_duplicates(fp, most, key).select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return docs.select(key).join(members.join(degree, "class", "left"), key, "left").select(key, F.coalesce("class", key).alias("class"), F.coalesce("links", F.lit(0)).alias("links"))


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class): the least id with the same text. Null texts are no one's copies and have no row; empty ones are equal."""
    d = docs.where(F.col(text).isNotNull()).select(key, F.md5(F.col(text).cast("binary")).alias("h"), F.length(text).alias("n"))
    first = d.groupBy("h", "n").agg(F.min(key).alias("class"))
    return d.join(first, ["h", "n"]).select(key, "class")


def bloom_shape(n: int, p: float = 0.01) -> tuple[int, int]:
    """Bits and hashes of a filter for n values with false-positive rate p."""
    m = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return m, max(1, math.ceil(m / n * math.log(2)))


def bloom_positions(value: Column, m: int, k: int) -> Column:
    """The k bits of a value by double hashing of two halves of its MD5."""
    h = F.md5(value.cast("binary"))
    h1, h2 = (F.conv(F.substring(h, a, 8), 16, 10).cast("long") for a in (1, 9))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (h1 + i * h2) % m)


def bloom_words(values: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """(word, bits): a Bloom filter as 32-bit words of set bits; null values aren't added. Filters merge by bit_or."""
    b = values.where(F.col(column).isNotNull()).select(F.explode(bloom_positions(F.col(column), m, k)).alias("b"))
    return b.groupBy(F.shiftright("b", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 32 as int))")).alias("bits"))


def bloom_union(*filters: DataFrame) -> DataFrame:
    """(word, bits): the union of filters of one shape."""
    rows = filters[0]
    for f in filters[1:]:
        rows = rows.unionByName(f)
    return rows.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def bloom_json(words: DataFrame, m: int, k: int) -> DataFrame:
    """(line): a filter as lines of JSON, a word each, that `bloom_from_json` reads."""
    return words.select(F.to_json(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k"), "word", "bits")).alias("line"))


def bloom_from_json(lines: DataFrame) -> DataFrame:
    """(word, bits) of lines of JSON."""
    return lines.select(F.from_json("line", "m long, k int, word long, bits long").alias("w")).select("w.word", "w.bits")


def fnv1a(text: Column | str) -> Column:
    """FNV-1a in 32 bits over the UTF-8 bytes of a text; null stays null."""
    return _bytes_hash(text, 2166136261, lambda h, b: (h.bitwiseXOR(b) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF)))


def _bytes_hash(text: Column | str, seed: int, step) -> Column:
    hexed = F.hex(F.encode(text, "UTF-8"))
    data = F.when(F.length(hexed) > 0, F.transform(F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.when(hexed.isNotNull(), F.aggregate(data, F.lit(seed).cast("long"), step))


def maybe_known(values: DataFrame, column: str, words: DataFrame, m: int, k: int) -> DataFrame:
    """Rows of `values` all of whose bits are set: a superset of those added. Null values are never known."""
    asked = values.where(F.col(column).isNotNull()).select(column).distinct().select(column, F.explode(bloom_positions(F.col(column), m, k)).alias("b"))
    hit = asked.join(words, F.shiftright(asked.b, 5) == words.word).where("shiftright(bits, cast(b % 32 as int)) & 1 = 1")
    return values.join(hit.groupBy(column).agg(F.countDistinct("b").alias("n")).join(asked.groupBy(column).agg(F.countDistinct("b").alias("m")), column).where("n = m").select(column), column, "left_semi")
