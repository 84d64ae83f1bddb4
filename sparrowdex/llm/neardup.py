"""Near-duplicate records: exact set-similarity join over word shingles by a token-group matrix."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.session import through_table

WORDS = re.compile(r"[^\W_]+").findall
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Counters of the frequency sketch; one byte each is broadcast, whatever the size of the collection.
SKETCH = 1 << 22
BLOCK = 1 << 14
#: Bits for each candidate, and most bits, of the filter that keeps the texts of candidates: 64 MB are broadcast at most.
FILTER_SHARE, FILTER_BITS = 32, 1 << 29
#: Tokens of one part, sets of one token that may ask in one task, and rows that meet at once.
PART_TOKENS, HOT, PIECE = 1 << 22, 1 << 14, 1 << 20
#: Common first tokens that open a group: this share of the query set's size, from 1 to LEAST. Ratio of sizes in one class.
OPENING, LEAST, RATIO = 0.04, 10, 1.05


class _Codes(dict):
    """64-bit codes of words, emptied when large."""

    def __missing__(self, w: str) -> int:
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


class Shingler:
    """Texts to their sets of hashed sequences of k successive words, a whole batch at once."""

    def __init__(self, k: int) -> None:
        self.k, self.codes = k, _Codes()

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, offsets): those of text i are hashes[offsets[i]:offsets[i + 1]], ascending and each once."""
        words = [WORDS(t.lower()) if t else () for t in texts]
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        if len(self.codes) > 1 << 20:
            self.codes.clear()
        a = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(words)), np.uint64, int(ends[-1]) if len(ends) else 0)
        n = max(0, len(a) - self.k + 1)
        with np.errstate(over="ignore"):
            h = a[:n].copy()
            for i in range(1, self.k):
                h = (h ^ (h >> np.uint64(31))) * MIX + a[i : i + n]
            h *= MIX
            h ^= h >> np.uint64(29)
        begins = np.r_[0, ends[:-1]] if len(ends) else ends
        lasts = np.minimum(np.maximum(begins, ends - self.k + 1), n)
        begins = np.minimum(begins, n)
        keep = np.zeros(n, bool)
        for x, y in zip(begins.tolist(), lasts.tolist()):
            if x < y:
                own = h[x:y]
                own.sort()
                keep[x] = True
                np.not_equal(own[1:], own[:-1], out=keep[x + 1 : y])
        before = np.r_[0, np.cumsum(keep)]
        sizes = before[lasts] - before[begins] if len(ends) else ends
        return h[keep], np.r_[0, np.cumsum(sizes)].astype(np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.batch([text])[0]


def _counter(h: np.ndarray) -> np.ndarray:
    """The counter of the sketch that hashes fall on; it is told by their first 32 bits alone."""
    return (h >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)


def _slices(column: pa.Array, rows: int = 1024) -> Iterator[tuple[int, list]]:
    """A column of texts in pieces of so many rows, with the place where each begins."""
    for at in range(0, len(column), rows):
        yield at, column.slice(at, rows).to_pylist()


def _sketch(texts: DataFrame, k: int) -> np.ndarray:
    """Of each counter the number of tokens of all texts that fall on it, as 8 * log2(1 + n) in a byte.

    Each task counts its texts and passes on blocks of counters (a count beyond 2 ** 31 in one task stays there), which are
    summed by block. It only sets the order in which tokens are looked at: any order gives the same result.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, total = Shingler(k), np.zeros(SKETCH, np.int32)
        for batch in batches:
            for _, some in _slices(batch.column(0)):
                h = np.sort(_counter(shingle.batch(some)[0]))
                new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][: len(h)])
                total[h[new]] += np.diff(np.r_[new, len(h)]).astype(np.int32)
        small = total.reshape(-1, BLOCK)
        for i in np.flatnonzero(small.any(1)).tolist():
            at = np.flatnonzero(small[i])
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()), pa.array([small[i][at].tobytes()], pa.binary())], ["block", "places", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, at, c in zip(*(x.to_pylist() for x in batch.columns)):
                if b not in total:
                    total[b] = np.zeros(BLOCK, np.int64)
                total[b][np.frombuffer(at, np.uint16)] += np.frombuffer(c, np.int32)
        levels = [np.minimum(8 * np.log2(1 + t), 255).astype(np.uint8).tobytes() for t in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], ["block", "levels"])

    parts = texts.select("text").mapInArrow(count, "block int, places binary, counts binary").repartition("block").mapInArrow(add, "block int, levels binary")
    out = np.zeros((SKETCH // BLOCK, BLOCK), np.uint8)
    for row in parts.toLocalIterator():  # SKETCH bytes at most
        out[row.block] = np.frombuffer(row.levels, np.uint8)
    return out.reshape(-1)


def _signatures(texts: DataFrame, k: int, sent, share: float) -> DataFrame:
    """Per text with a shingle: (id, n, d1, d2, low, x, at).

    n is the size of its set, (d1, d2) 128 bits of it; x are its rarest tokens, as far as a common one must
    be among them (see `similar_pairs`), in 32 bits, `at` their places from rare to frequent, and low the least of them.
    Tokens that no other text has are left out. `sent` is the broadcast sketch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, levels = Shingler(k), sent.value
        for batch in batches:
            for first, some in _slices(batch.column(1)):
                h, offsets = shingle.batch(some)
                n = np.diff(offsets)
                raw, ends = h.tobytes(), (8 * offsets).tolist()
                held = np.flatnonzero(n)
                d = [xxhash.xxh3_128_intdigest(raw[ends[i] : ends[i + 1]]) for i in held.tolist()]
                order = levels[_counter(h)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
                for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    order[x:y].sort()
                place = np.arange(len(h)) - np.repeat(offsets[:-1], n)
                kept = (place < np.repeat(n - np.ceil(share * n - 1e-9).astype(np.int64) + LEAST, n)) & (order >> np.uint64(56) > 8)  # 8: counted once
                x = (order[kept] >> np.uint64(24)).astype(np.uint32)
                ends = np.r_[0, np.cumsum(kept)][offsets]
                low = np.zeros(len(n), np.int64)
                full = np.flatnonzero(np.diff(ends))
                if len(full):
                    low[full] = np.minimum.reduceat(x, ends[full])
                cut = pa.array(np.r_[ends[held], ends[-1]].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(some)).take(pa.array(held)), pa.array(n[held].astype(np.int32)), pa.array([v & (1 << 63) - 1 for v in d], pa.int64()), pa.array([v >> 65 for v in d], pa.int64()),
                        pa.array(low[held]), pa.ListArray.from_arrays(cut, pa.array(x.view(np.int32))), pa.ListArray.from_arrays(cut, pa.array(place[kept].astype(np.int32))),
                    ],
                    ["id", "n", "d1", "d2", "low", "x", "at"],
                )

    return texts.select("id", "text").mapInArrow(run, "id long, n int, d1 long, d2 long, low long, x array<int>, at array<int>")


def similar_pairs(texts: DataFrame, k: int = 5, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Pairs of different shingle sets with a Jaccard similarity of at least `share`, and the members of each set.

    texts: (id, text) with unique ids. Returns (a, b, similarity) with a < b, the least ids of two different sets, and
    (id, class) of every text, class being the least id with the same set. Texts with fewer than k words (null, empty)
    have no set and are in neither. The result is exact, whatever the sizes of groups:

    Equal sets are collapsed. Tokens are ordered from rare to frequent. With J >= t, sets of n >= m tokens share
    o >= t / (1 + t) * (n + m) of them, so the first l common ones are among the first n - o + l of the one and m - o + l
    of the other. Sets are partitioned into groups by size class and least rare token (equal for similar sets in
    most cases); the matrix holds for each token the groups in whose union of such first tokens it is. A query set meets it
    with its own first tokens, and a group is opened if at least l of them meet it within those bounds, l being OPENING of
    its size. Opened groups give pairs, which are compared by their whole texts.
    """
    texts = texts.select("id", "text")
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(_sketch(texts, k))
    marks = through_table(_signatures(texts, k, sent, share), "signatures")
    members = _members(marks)
    reps = marks.groupBy("d1", "d2").agg(F.min(F.struct("id", "n", "low", "x", "at")).alias("r")).select("r.*")
    size_class = F.floor(F.ln(F.col("n")) / math.log(RATIO) + 1e-9).cast("long")
    reps = reps.withColumn("g", size_class * F.lit(1 << 40) + F.pmod("low", F.lit(1 << 40)))
    tokens = marks.agg(F.coalesce(F.sum(F.size("x")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(tokens / PART_TOKENS))
    laid = reps.select("id", "n", "g", "x", "at").mapInArrow(_by_part(_even_labels(spark, parts), sent), "part int, role int, q long, n int, g long, x array<int>, at array<int>")
    met = laid.repartition(parts, "part").mapInArrow(_meet(share), "q long, n int, g long, c int")
    opened = met.groupBy("q", "g").agg(F.sum("c").alias("c"), F.first("n").alias("n")).where(F.col("c") >= F.greatest(F.lit(1), F.least(F.lit(LEAST), F.floor(OPENING * F.col("n")))))
    inside = reps.select(F.col("id").alias("s"), F.col("n").alias("m"), "g")
    pairs = opened.select("q", "n", "g").join(inside, "g").where("m < n OR (m = n AND s < q)").where(F.col("m") >= F.lit(share) * F.col("n") - 1e-9).select("q", "s")
    pairs = through_table(pairs, "candidates")
    return _verified(pairs, texts, k, share), members


def _even_labels(spark, parts: int) -> np.ndarray:
    """A label for each part such that every partition gets one label when rows are laid out by its hash."""
    some = spark.range(32 * parts).select(F.col("id").cast("int").alias("label")).select("label", F.pmod(F.hash("label"), F.lit(parts)).alias("p"))
    first = {r.p: r.label for r in some.groupBy("p").agg(F.min("label").alias("label")).collect()}
    return np.array([first.get(p, p) for p in range(parts)], np.int32)


def _by_part(labels: np.ndarray, sent):
    """Rows of sets, cut into one row for each part of the tokens: a token's rows meet, at a few bytes a token.

    role: 0 for tokens that both ask and are in the matrix, 1 that only ask, 2 that are in the matrix only. A token that by
    the sketch more than HOT sets may have is split: its asking rows are spread by set over as many parts as it has times HOT,
    and its rows of the matrix are repeated there.
    """

    def cut(batch: pa.RecordBatch, row: np.ndarray, part: np.ndarray, tokens: np.ndarray, places: np.ndarray, role: int) -> pa.RecordBatch:
        order = np.lexsort((places, part, row))
        row, part = row[order], part[order]
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (part[1:] != part[:-1])][: len(row)])
        offsets = pa.array(np.r_[new, len(row)].astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v[order].astype(np.int32))) for v in (tokens, places)]
        own = pa.array(row[new])
        return pa.RecordBatch.from_arrays(
            [pa.array(labels[part[new]]), pa.array(np.full(len(new), role, np.int32)), *[batch.column(c).take(own) for c in (0, 1, 2)], *lists], ["part", "role", "q", "n", "g", "x", "at"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = sent.value
        for batch in batches:
            x, at = batch.column(3), batch.column(4)
            size = np.diff(x.offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            tokens, places = x.flatten().to_numpy(), at.flatten().to_numpy()
            u = tokens.view(np.uint32).astype(np.int64)
            level = levels[u >> (32 - SKETCH.bit_length() + 1)].astype(float)
            copies = np.ceil((2 ** (level / 8) - 1) / HOT).astype(np.int64)
            plain = copies <= 1
            yield cut(batch, row[plain], u[plain] % len(labels), tokens[plain], places[plain], 0)
            if not plain.all():
                r, v, t, p, c = row[~plain], u[~plain], tokens[~plain], places[~plain], copies[~plain]
                own = (batch.column(0).to_numpy(zero_copy_only=False)[r].view(np.uint64) * MIX >> np.uint64(33)).astype(np.int64) % c
                yield cut(batch, r, (v + own) % len(labels), t, p, 1)
                again = np.repeat(np.arange(len(c)), np.minimum(c, len(labels)))
                step = np.arange(len(again)) - np.repeat(np.cumsum(np.minimum(c, len(labels))) - np.minimum(c, len(labels)), np.minimum(c, len(labels)))
                yield cut(batch, r[again], (v[again] + step) % len(labels), t[again], p[again], 2)

    return run


def _meet(share: float):
    """Tokens of one part: (q, n, g, c) of each query set and group with c of its tokens in the group's matrix, within the bounds.

    With n - i >= h * (n + m) - l + 1 for the one and m - j >= h * (n + m) - l + 1 for the other, what depends on a set and a
    place is its slack, n * (1 - h) - i; a group's is that of its best member. A part is held as arrays, PART_TOKENS or so
    by the choice of the number of parts; what meets is taken in pieces of PIECE, so a hot token needs no more memory.
    """
    h = share / (1 + share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) if i < 4 else (np.diff(c.offsets.to_numpy()), c.flatten().to_numpy()) for i, c in enumerate(b.columns[1:])] for b in batches if b.num_rows]
        if not held:
            return
        role, q, n, g = (np.concatenate([b[i] for b in held]) for i in range(4))
        size, x = (np.concatenate([b[4][i] for b in held]) for i in range(2))
        at = np.concatenate([b[5][1] for b in held])
        del held
        row = np.repeat(np.arange(len(q), dtype=np.int32), size)
        x = x.view(np.uint32)
        wanted = np.maximum(1, np.minimum(LEAST, np.floor(OPENING * n)))
        slack = n[row] * (1 - h) - at
        groups, own_group = np.unique(g, return_inverse=True)
        lows = RATIO ** (groups >> 40).astype(float) * (1 - 1e-6)
        # the matrix: by token and group the best slack
        some = np.flatnonzero((role != 1)[row] & (slack >= (h * n / RATIO - wanted + 0.98)[row]))
        key = x[some].astype(np.uint64) << np.uint64(32) | own_group[row[some]].astype(np.uint64)
        order = np.argsort(key)
        key, best = key[order], slack[some[order]]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        best = np.maximum.reduceat(best, new) if len(new) else best
        token, group = (key[new] >> np.uint64(32)).astype(np.uint32), (key[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ask = np.flatnonzero((role != 2)[row])
        ask = ask[np.argsort(x[ask])]
        begin, end = np.searchsorted(token, x[ask]), np.searchsorted(token, x[ask], "right")
        meets = np.cumsum(end - begin)
        low_of, need, floor = lows[group], (h * n - wanted + 0.99), share * n
        found, waiting, at = [], 0, 0
        while at < len(ask):
            done = meets[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(meets, done + PIECE, "right")))
            count = (end - begin)[at:to]
            for a in range(0, int(count.max(initial=0)) if to == at + 1 else 1, PIECE):  # a single hot row is taken in pieces too
                c = np.minimum(np.maximum(count - a, 0), PIECE) if to == at + 1 else count
                who = np.repeat(ask[at:to], c)
                place = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[at:to] + a, c)
                r, low = row[who], low_of[place]
                ok = (low <= n[r]) & (low * RATIO * (1 + 1e-5) >= floor[r]) & (best[place] >= need[r]) & (slack[who] >= h * np.maximum(low, floor[r]) - wanted[r] + 0.99)
                found.append(r[ok].astype(np.uint64) << np.uint64(32) | group[place[ok]].astype(np.uint64))
                waiting += len(found[-1])
            at = to
            if waiting > 4 * PIECE or at == len(ask):
                pair, c = np.unique(np.concatenate(found), return_counts=True)
                r = (pair >> np.uint64(32)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array(n[r]), pa.array(groups[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]), pa.array(c.astype(np.int32))], ["q", "n", "g", "c"])
                found, waiting = [], 0

    return run


def _members(marks: DataFrame) -> DataFrame:
    """(id, class): a join with the least id of the set, so that a set with very many copies is no hot window."""
    first = marks.groupBy("d1", "d2").agg(F.min("id").alias("class"), F.count("*").alias("copies"))
    several = first.where("copies > 1").select("d1", "d2", "class")
    return marks.select("id", "d1", "d2").join(several, ["d1", "d2"], "left").select("id", F.coalesce("class", "id").alias("class"))


def _filter_of(ids: DataFrame, bits: int) -> np.ndarray:
    """A filter of `bits` bits in which those of all ids (column i) are set; built in blocks, bits / 8 bytes at most come to the driver."""
    block = min(bits, 1 << 16)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            b = batch.column(0).to_numpy(zero_copy_only=False)
            for w in np.unique(b // block).tolist():
                own.setdefault(w, np.zeros(block, bool))[b[b // block == w] % block] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int64()), pa.array([np.packbits(v, bitorder="little").tobytes() for v in own.values()], pa.binary())], ["w", "bits"])

    slot = F.pmod(F.xxhash64("i"), F.lit(bits))
    out = np.zeros(bits // 8, np.uint8)
    for r in ids.select(slot.alias("b")).distinct().repartition(F.floor(F.col("b") / block)).mapInArrow(fill, "w long, bits binary").toLocalIterator():
        out[r.w * block // 8 : (r.w + 1) * block // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, k: int, share: float) -> DataFrame:
    """Compare the whole texts of candidate pairs; only texts that a filter of their ids, of bounded size, lets pass are moved."""
    bits = min(FILTER_BITS, 1 << max(16, (FILTER_SHARE * pairs.count()).bit_length()))
    sent = texts.sparkSession.sparkContext.broadcast(_filter_of(pairs.select(F.explode(F.array("q", "s")).alias("i")), bits))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = batch.column(2).to_numpy(zero_copy_only=False)
            hit = (sent.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1
            yield batch.filter(pa.array(hit.astype(bool))).select([0, 1])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                q, s, tq, ts = (c.slice(first, 512).to_pylist() for c in whole.columns)
                of = dict(zip(q + s, tq + ts))
                place = {i: j for j, i in enumerate(of)}
                h, cut = shingle.batch(list(of.values()))
                a, b, j = [], [], []
                for i, o in zip(q, s):
                    x, y = (h[cut[place[v]] : cut[place[v] + 1]] for v in (i, o))
                    if not len(x) or not len(y):
                        continue
                    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                    union = len(x) + len(y) - common
                    if common >= share * union - 1e-9:
                        a.append(min(i, o))
                        b.append(max(i, o))
                        j.append(common / union)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(j, pa.float64())], ["a", "b", "similarity"])

    held = texts.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(bits)).alias("b")).mapInArrow(keep, "id long, text string")
    held = through_table(held, "texts")
    one = pairs.join(held.select(F.col("id").alias("q"), F.col("text").alias("tq")), "q")
    both = one.join(held.select(F.col("id").alias("s"), F.col("text").alias("ts")), "s")
    return both.select("q", "s", "tq", "ts").mapInArrow(compare, "a long, b long, similarity double")


def all_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b) of all similar texts: links between sets times their members, and the pairs within each set."""
    m = members.select(F.col("id").alias("x"), F.col("class").alias("a"))
    o = members.select(F.col("id").alias("y"), F.col("class").alias("b"))
    across = links.select("a", "b").join(m, "a").join(o, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    many = members.groupBy("class").agg(F.count("*").alias("c")).where("c > 1").select("class")
    held = members.join(many, "class")
    within = held.select(F.col("id").alias("id_a"), "class").join(held.select(F.col("id").alias("id_b"), "class"), "class").where("id_a < id_b").select("id_a", "id_b")
    return across.unionByName(within)


def linked_records(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, class, links): every text with its set's least id and the number of other sets similar to its own."""
    degree = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    return members.join(degree, "class", "left").select("id", "class", F.coalesce("links", F.lit(0)).alias("links"))
