"""Vector search: exact top-k, inverted-file index, text encoder."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays as doubles; null if one is null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; 0 if one of them is 0 or null."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def _normed(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def top_similar(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding", block: int = 4096) -> DataFrame:
    """(query, key, score, rank): the k vectors of largest cosine for each query vector, itself left out, ties by key.

    Queries are a stated set: they are sent in blocks of `block`, the vectors being read once a block. Each task takes
    matrix products of its batches with the block and keeps k a query, so k rows a query and task are shuffled.
    Null vectors match nothing. Vectors must have one length.
    """
    out, held = None, []
    for r in queries.where(F.col(column).isNotNull()).select(key, column).orderBy(key).toLocalIterator():
        held.append((r[0], list(r[1])))
        if len(held) == block:
            out, held = _union(out, _top_block(vectors, held, k, key, column)), []
    if held or out is None:
        out = _union(out, _top_block(vectors, held, k, key, column))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _top_block(vectors: DataFrame, queries: list, k: int, key: str, column: str) -> DataFrame:
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = _normed(np.array([v for _, v in queries], float)) if queries else np.zeros((0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows or not len(ids):
                continue
            own = b.column(0).to_numpy(zero_copy_only=False)
            score = np.round(matrix @ _normed(np.array(b.column(1).to_pylist(), float)).T, 6)
            for q in range(len(ids)):
                other = own != ids[q]
                s, i = np.r_[best[q][0], score[q][other]], np.r_[best[q][1], own[other]]
                o = np.lexsort((i, -s))[:k]
                best[q] = s[o], i[o]
        n = [len(s) for s, _ in best]
        cat = lambda j, t: np.concatenate([x[j] for x in best]) if best else np.zeros(0, t)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(cat(1, np.int64)), pa.array(cat(0, float))], ["query", key, "score"])

    return vectors.select(key, column).mapInArrow(run, f"query long, {key} long, score double")


def similarities(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", block: int = 4096) -> DataFrame:
    """(query, key, score): the cosine of every vector with every query vector, itself included; 0 if one is 0 or null.

    Queries are sent in blocks as in `top_similar`; nothing is shuffled. Vectors must have one length.
    """
    out, held = None, []
    for r in queries.select(key, column).orderBy(key).toLocalIterator():
        held.append((r[0], None if r[1] is None else list(r[1])))
        if len(held) == block:
            out, held = _union(out, _all_block(vectors, held, key, column)), []
    return _union(out, _all_block(vectors, held, key, column)) if held or out is None else out


def _all_block(vectors: DataFrame, queries: list, key: str, column: str) -> DataFrame:
    ids = np.array([q for q, _ in queries], np.int64)
    dim = next((len(v) for _, v in queries if v is not None), 0)
    matrix = _normed(np.array([v or [0.0] * dim for _, v in queries], float).reshape(len(ids), dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = max(1, (1 << 20) // max(1, len(ids)))  # rows at once, for 2 ** 20 scores
        for batch in batches:
            for at in range(0, batch.num_rows, some):
                b = batch.slice(at, some)
                x = np.array([v or [0.0] * dim for v in b.column(1).to_pylist()], float) if dim else np.zeros((b.num_rows, 0))
                own = np.tile(b.column(0).to_numpy(zero_copy_only=False), len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, b.num_rows)), pa.array(own), pa.array((matrix @ _normed(x).T).ravel())], ["query", key, "score"])

    return vectors.select(key, column).mapInArrow(run, f"query long, {key} long, score double")


def fit_centroids(vectors: DataFrame, count: int, sample: int = 20000, rounds: int = 8, key: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """Centroids of a bounded sample (the `sample` vectors of least hash) by spherical k-means; deterministic."""
    rows = vectors.where(F.col(column).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select(column).collect()
    x = _normed(np.array([list(r[0]) for r in rows], float)) if rows else np.zeros((1, 1))
    c = x[: max(1, min(count, len(x)))].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for i in range(len(c)):
            if (near == i).any():
                c[i] = x[near == i].mean(0)
        c = _normed(c)
    return c


def ivf_search(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int | None = None, share: float = 0.65, key: str = "vec_id", column: str = "embedding", block: int = 4096) -> DataFrame:
    """(query, key, score, rank) by an inverted file: every vector is in the list of its nearest centroid, a query looks into the
    share `share` of the lists, nearest first. Approximate: a neighbour in another list is missed; the recall is tested.

    lists is the square root of the number of vectors unless given, fitted on a bounded sample; all vectors are indexed. Queries, a stated set, are
    sent in blocks with their lists; each task scores its vectors against the queries that probe their lists, and keeps k a query.
    Null vectors are in no list.
    """
    n = vectors.count() if lists is None else 0
    c = fit_centroids(vectors, lists or max(1, math.isqrt(n)), key=key, column=column)
    probes = max(1, math.ceil(share * len(c)))
    out, held = None, []
    for r in queries.where(F.col(column).isNotNull()).select(key, column).orderBy(key).toLocalIterator():
        held.append((r[0], list(r[1])))
        if len(held) == block:
            out, held = _union(out, _probed(vectors, held, c, probes, k, key, column)), []
    if held or out is None:
        out = _union(out, _probed(vectors, held, c, probes, k, key, column))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), key))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def _probed(vectors: DataFrame, queries: list, c: np.ndarray, probes: int, k: int, key: str, column: str) -> DataFrame:
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = _normed(np.array([v for _, v in queries], float)) if queries else np.zeros((0, c.shape[1]))
    near = np.argsort(-(matrix @ c.T), axis=1, kind="stable")[:, :probes]
    asked: list[list[int]] = [[] for _ in c]
    for q, row in enumerate(near.tolist()):
        for x in row:
            asked[x].append(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            if not b.num_rows or not len(ids):
                continue
            own, x = b.column(0).to_numpy(zero_copy_only=False), _normed(np.array(b.column(1).to_pylist(), float))
            place = (x @ c.T).argmax(1)
            order = np.argsort(place, kind="stable")
            cuts = np.searchsorted(place[order], np.arange(len(c) + 1))
            for at in range(len(c)):
                rows = order[cuts[at] : cuts[at + 1]]
                if not len(rows) or not asked[at]:
                    continue
                score = np.round(matrix[asked[at]] @ x[rows].T, 6)
                for q, s in zip(asked[at], score):
                    other = own[rows] != ids[q]
                    s, i = np.r_[best[q][0], s[other]], np.r_[best[q][1], own[rows][other]]
                    o = np.lexsort((i, -s))[:k]
                    best[q] = s[o], i[o]
        n = [len(s) for s, _ in best]
        cat = lambda j, t: np.concatenate([x[j] for x in best]) if best else np.zeros(0, t)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(cat(1, np.int64)), pa.array(cat(0, float))], ["query", key, "score"])

    return vectors.select(key, column).mapInArrow(run, f"query long, {key} long, score double")


def residuals(vectors: DataFrame, centroids: np.ndarray, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, list, residual): each vector's nearest centroid and what it differs from it by; null vectors have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            x = _normed(np.array(b.column(1).to_pylist(), float)) if b.num_rows else np.zeros((0, centroids.shape[1]))
            near = (x @ centroids.T).argmax(1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(near.astype(np.int32)), pa.array(list(x - centroids[near]), pa.list_(pa.float64()))], [key, "list", "residual"])

    return vectors.select(key, column).mapInArrow(run, f"{key} long, list int, residual array<double>")


def merged_vectors(a: Column | str, b: Column | str, n_a: Column | str, n_b: Column | str) -> Column:
    """The mean of two vectors by their counts; one of them if the other is null or both counts are 0."""
    f = lambda x: F.col(x) if isinstance(x, str) else x
    total = f(n_a) + f(n_b)
    mean = F.zip_with(f(a), f(b), lambda x, y: (x.cast("double") * f(n_a) + y.cast("double") * f(n_b)) / total)
    return F.coalesce(F.when(total > 0, mean), f(a).cast("array<double>"), f(b).cast("array<double>"))


BINS, SHIFTS = 300, 10


@lru_cache(4)
def projection(dim: int) -> np.ndarray:
    """Entries uniform in +-0.5 * sqrt(2 / BINS), from MD5 of 'row:column'."""
    u = np.array([[int(md5(f"{r}:{c}".encode()).hexdigest()[:8], 16) / 2**32 for c in range(BINS)] for r in range(dim)])
    return (u - 0.5) * math.sqrt(2 / BINS)


def token_bins(token: str) -> list[int]:
    """The ten bins of a token: its 31-polynomial hash as a signed 32-bit number, shifted by 5 bits each."""
    h = 0
    for c in np.frombuffer(token.encode("utf-16-le", "surrogatepass"), np.uint16).tolist():  # UTF-16 units
        h = (h * 31 + c) & 0xFFFFFFFF
    h -= (h >> 31) << 32
    return [abs(int(math.fmod(h >> (5 * i % 32), BINS))) for i in range(SHIFTS)]


def encode_text(terms_per_doc: DataFrame, dim: int = 256, key: str = "doc_id") -> DataFrame:
    """(key, vector) of (key, terms array): ln(1 + tf) into ten bins a term, scaled, projected, scaled.

    Documents without terms have the zero vector; null terms count as none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        p = projection(dim)
        for b in batches:
            x = np.zeros((b.num_rows, BINS))
            for i, ts in enumerate(b.column(1).to_pylist()):
                count: dict[str, int] = {}
                for t in ts or ():
                    count[t] = count.get(t, 0) + 1
                for t, f in count.items():
                    if t not in known:
                        if len(known) > 1 << 18:
                            known.clear()
                        known[t] = token_bins(t)
                    for j in known[t]:
                        x[i, j] += math.log1p(f)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(_normed(_normed(x) @ p.T)), pa.list_(pa.float64()))], [key, "vector"])

    return terms_per_doc.mapInArrow(run, f"{key} long, vector array<double>")
