"""Has this key been seen before? Partitioned cuckoo tables over keys in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparrowdex.llm.common import BLANKS
from sparrowdex.session import written

SLOTS = 4
#: Default ports of schemes.
PORTS = {"http": ":80", "https": ":443"}
MIX = np.uint64(0x9E3779B97F4A7C15)


def url_key(url: str) -> str:
    """The key of one URL, see `with_url_key`."""
    u = url.strip(BLANKS).split("#", 1)[0]
    scheme, parted, rest = u.partition("://")
    if not parted or not scheme or ":" in scheme or "/" in scheme or "?" in scheme:
        return u
    scheme = scheme.lower()
    path, mark, query = rest.partition("?")
    place, slash, tail = path.rstrip("/").partition("/")
    user, at, host = place.rpartition("@")
    host = host.lower()
    port = PORTS.get(scheme)
    if port and host.endswith(port):
        host = host[: -len(port)]
    return f"{scheme}://{user}{at}{host}{slash}{tail}{mark}{query}"


def with_url_key(rows: DataFrame, url: str = "url", key: str = "key") -> DataFrame:
    """Adds the key of a URL column: outer blanks, the scheme's default port, the fragment and slashes ending the path
    are dropped, scheme and host lower-cased; all else counts.

    A text that isn't scheme://... is its own key, trimmed and without fragment. Null stays null. Arrow batches, as the many
    steps on parts of the text are far slower as Column expressions.
    """

    @F.pandas_udf("string")
    def keys(urls: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else url_key(u) for u in urls], dtype=object)

    return rows.withColumn(key, keys(url))


class CuckooTable:
    """A set of 64-bit hashes as 32-bit fingerprints with two candidate buckets of four slots; grows by segments.

    Each segment has twice the buckets of the one before; a new one is opened when the last is saturated. All methods
    take arrays. There are no false negatives; an absent key is taken for present with a chance of at most
    8 / 2**32 per segment.
    """

    def __init__(self, buckets: int = 1 << 10, load: float = 0.9, kicks: int = 64) -> None:
        self.load, self.kicks, self.count = load, kicks, 0
        self.segments: list[np.ndarray] = [np.zeros((buckets, SLOTS), np.uint32)]
        self.filled: list[int] = [0]

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return np.maximum((h >> np.uint64(32)).astype(np.uint32), np.uint32(1))

    @staticmethod
    def _first(h: np.ndarray, mask: int) -> np.ndarray:
        return ((h * MIX) >> np.uint64(20)).astype(np.int64) & mask

    @staticmethod
    def _other(b: np.ndarray, p: np.ndarray, mask: int) -> np.ndarray:
        return b ^ ((((p.astype(np.uint64) * MIX) >> np.uint64(24)).astype(np.int64) | 1) & mask)

    def save(self) -> list[tuple[int, int, int, bytes]]:
        """(segment, slots a bucket, filled slots, slots) of each segment, from which `restore` makes the table again."""
        return [(i, s.shape[1], n, s.tobytes()) for i, (s, n) in enumerate(zip(self.segments, self.filled))]

    def restore(self, segment: int, slots: int, filled: int, data: bytes) -> None:
        """Put back one saved segment; segments come in order, into a table that is new."""
        if segment == 0:
            self.segments, self.filled, self.count = [], [], 0
        self.segments.append(np.frombuffer(data, np.uint32).reshape(-1, slots).copy())
        self.filled.append(filled)
        self.count += filled

    def contains(self, h: np.ndarray) -> np.ndarray:
        p, hit = self._print(h), np.zeros(len(h), bool)
        for s in self.segments:
            b = self._first(h, len(s) - 1)
            hit |= (s[b] == p[:, None]).any(1) | (s[self._other(b, p, len(s) - 1)] == p[:, None]).any(1)
        return hit

    def add(self, h: np.ndarray) -> None:
        """Put in hashes, each once in `h`, none of them contained."""
        self.count += len(h)
        while len(h):
            s = self.segments[-1]
            room = int(s.size * self.load) - self.filled[-1]
            if room <= 0:
                self.segments.append(np.zeros((2 * len(s), SLOTS), np.uint32))
                self.filled.append(0)
                continue
            now, h = h[:room], h[room:]
            p = self._print(now)
            self._settle(p, self._first(now, len(s) - 1))

    def _settle(self, p: np.ndarray, b: np.ndarray) -> None:
        """Place fingerprints p, b being one of the two buckets of each; kick out others where both are full."""
        s = self.segments[-1]
        mask, rng, rounds = len(s) - 1, np.random.default_rng(len(s)), 0
        while len(p):
            for _ in range(2):
                p, b = self._place(s, p, b)
                b = self._other(b, p, mask)
            if not len(p):
                return
            rounds += 1
            if rounds > self.kicks:
                self._widen(p, b, mask)
                return
            _, one = np.unique(b, return_index=True)
            slot = rng.integers(0, SLOTS, len(one))
            out = s[b[one], slot].copy()
            s[b[one], slot] = p[one]
            p[one] = out
            b[one] = self._other(b[one], out, mask)

    def _place(self, s: np.ndarray, p: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(b, kind="stable")
        p, b = p[order], b[order]
        start = np.r_[True, b[1:] != b[:-1]]
        rank = np.arange(len(b)) - np.maximum.accumulate(np.where(start, np.arange(len(b)), 0))
        free = s[b] == 0
        can = rank < free.sum(1)
        nth = (np.cumsum(free[can], axis=1) == (rank[can] + 1)[:, None]) & free[can]
        s[b[can], nth.argmax(1)] = p[can]
        self.filled[-1] += int(can.sum())
        return p[~can], b[~can]

    def _widen(self, p: np.ndarray, b: np.ndarray, mask: int) -> None:
        """A segment that saturates early gets twice the slots a bucket: a fingerprint alone can't be moved elsewhere."""
        s = self.segments[-1]
        wide = np.zeros((len(s), s.shape[1] * 2), np.uint32)
        wide[:, : s.shape[1]] = s
        self.segments[-1] = wide
        while len(p):
            p, b = self._place(wide, p, b)
            b = self._other(b, p, mask)

    def remove(self, h: np.ndarray) -> np.ndarray:
        """Take out one fingerprint of each hash (distinct, contained before); says which were found."""
        p, done = self._print(h), np.zeros(len(h), bool)
        for k, s in enumerate(self.segments):
            first = self._first(h, len(s) - 1)
            for b in (first, self._other(first, p, len(s) - 1)):
                for i in np.flatnonzero(~done & (s[b] == p[:, None]).any(1)):  # one by one: two may share a slot
                    at = np.flatnonzero(s[b[i]] == p[i])
                    if len(at):
                        s[b[i], at[0]] = 0
                        done[i] = True
                        self.filled[k] -= 1
        self.count -= int(done.sum())
        return done


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark rows whose key has an earlier row in the same batch: these are decided before any shuffle."""
    for batch in batches:
        h1, h2, order = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "arrival"))
        by = np.lexsort((order, h2, h1))
        a, b, o = h1[by], h2[by], order[by]
        start = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(by)]
        begin = np.maximum.accumulate(np.where(start, np.arange(len(by)), 0))
        later = np.empty(len(by), bool)
        later[by] = o > o[begin]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(later)], [*batch.schema.names, "decided"])


#: What a row laid out to the tables is: a saved segment, a key to forget, a key that arrives, one that is decided already.
SEGMENT, FORGET, KEY, DECIDED = range(4)
LAID = "part int, op int, arrival long, h1 long, h2 long, segment int, slots int, filled long, data binary"
GIVEN = "arrival long, h1 long, h2 long, decided boolean, seen boolean, part int, segment int, slots int, filled long, data binary"


def _through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, op, segment and arrival: loads the part's table, forgets, answers keys in order, gives the table back.

    The table of one part is all that is kept between batches.
    """
    table, part = CuckooTable(), None
    none = lambda n, t: pa.nulls(n, t)
    names = [x.split()[0] for x in GIVEN.split(", ")]

    def given(arrival, h1, h2, decided, seen) -> pa.RecordBatch:
        n = len(arrival)
        return pa.RecordBatch.from_arrays([arrival, h1, h2, pa.array(decided), pa.array(seen), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.int32()), none(n, pa.int64()), none(n, pa.binary())], names)

    def saved() -> pa.RecordBatch:
        rows = table.save()
        n = len(rows)
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))]
        return pa.RecordBatch.from_arrays([none(n, pa.int64())] * 3 + [none(n, pa.bool_())] * 2 + [pa.array([part] * n, pa.int32()), *cols], names)

    for batch in batches:
        parts, ops = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "op"))
        new = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (ops[1:] != ops[:-1])][: len(parts)])
        for a, b in zip(new, np.r_[new[1:], len(parts)]):
            rows, op = batch.slice(a, b - a), ops[a]
            arrival, h1, h2 = (rows.column(c) for c in ("arrival", "h1", "h2"))
            if op == DECIDED:
                yield given(arrival, h1, h2, np.ones(b - a, bool), np.ones(b - a, bool))
                continue
            if parts[a] != part:
                if part is not None:
                    yield saved()
                table, part = CuckooTable(), int(parts[a])
            if op == SEGMENT:
                for r in rows.select(["segment", "slots", "filled", "data"]).to_pylist():
                    table.restore(*r.values())
                continue
            h = h1.to_numpy(zero_copy_only=False).view(np.uint64)
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            known = table.contains(keys)
            if op == FORGET:
                table.remove(keys[known])
                continue
            table.add(keys[~known])
            order = arrival.to_numpy(zero_copy_only=False)
            yield given(arrival, h1, h2, np.zeros(b - a, bool), known[inverse] | (order > order[first][inverse]))
    if part is not None:
        yield saved()


class SeenTables:
    """Cuckoo tables of keys, one for each part of the hashes, kept as rows in the shared folder; a batch makes a new version.

    `path` is the folder of the version, None for empty tables. Each method gives new tables and leaves the old ones as they
    were, so a lost executor or driver leaves the last version whole, and a batch can be run again.
    """

    def __init__(self, spark: SparkSession, parts: int | None = None, path: str | None = None) -> None:
        self.spark, self.path = spark, path
        self.parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(self) -> DataFrame:
        """(part, segment, slots, filled, data) of all tables."""
        return self.spark.read.schema(GIVEN).parquet(self.path).where("data IS NOT NULL").select("part", "segment", "slots", "filled", "data")

    def size(self) -> int:
        """How many keys the tables hold."""
        return 0 if self.path is None else self.rows().agg(F.coalesce(F.sum("filled"), F.lit(0))).first()[0]

    def extended(self, keys: DataFrame | None, forget: DataFrame | None = None, key: str = "key", arrival: str = "entry_id") -> tuple[SeenTables, DataFrame]:
        """(tables with the batch, answers): forgets the keys of `forget`, then asks and adds those of `keys` in order of arrival.

        Answers are (arrival, h1, h2, decided, seen). Keys are hashed to 128 bits; in each Arrow batch all but the first row of a
        key are decided at once and spread by arrival, so a key with a third of all rows doesn't meet in one task. The rest is
        laid out by part with the part's table and passed through it. Null keys are left out. arrival must be a positive whole
        number that orders the rows of a batch. A key is to be forgotten once, and only if it was added.
        """
        none = {x.split()[0]: F.lit(None).cast(x.split()[1]) for x in LAID.split(", ")}
        part = F.pmod("h1", F.lit(self.parts)).cast("int")
        laid = []
        if keys is not None:
            rows = keys.where(F.col(key).isNotNull()).select(F.col(arrival).cast("long").alias("arrival"), *key_hashes(key))
            marked = rows.mapInArrow(_reduce, "arrival long, h1 long, h2 long, decided boolean")
            spread = -1 - F.pmod(F.xxhash64("arrival"), F.lit(self.parts)).cast("int")
            laid.append(marked.select(F.when(F.col("decided"), spread).otherwise(part).alias("part"), F.when(F.col("decided"), DECIDED).otherwise(KEY).alias("op"), "arrival", "h1", "h2"))
        if forget is not None:
            gone = forget.where(F.col(key).isNotNull()).select(*key_hashes(key)).distinct()
            laid.append(gone.select(part.alias("part"), F.lit(FORGET).alias("op"), "h1", "h2"))
        if self.path is not None:
            laid.append(self.rows().withColumn("op", F.lit(SEGMENT)))
        full = [d.select(*[F.col(c) if c in d.columns else v.alias(c) for c, v in none.items()]) for d in laid]
        both = reduce(DataFrame.unionByName, full)
        out = both.repartition("part").sortWithinPartitions("part", "op", "segment", "arrival").mapInArrow(_through, GIVEN)
        path = written(out, "seen-tables")
        answers = self.spark.read.schema(GIVEN).parquet(path).where("data IS NULL").select(F.col("arrival").alias(arrival), "h1", "h2", "decided", "seen")
        return SeenTables(self.spark, self.parts, path), answers


def key_hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(0x5BD1E995), F.col(key)).alias("h2")]


def seen_before(known: DataFrame, arriving: DataFrame, key: str = "key", arrival: str = "entry_id") -> DataFrame:
    """(entry_id, h1, h2, decided, seen) of each arriving row with a key: the answer of cuckoo tables that were made of the keys
    of `known` and saved, then loaded and extended by the arriving rows. Both have column `key`; null keys are left out."""
    before, _ = SeenTables(known.sparkSession).extended(known.withColumn("__at", F.lit(1)), key=key, arrival="__at")
    return before.extended(arriving, key=key, arrival=arrival)[1]


def checked(answers: DataFrame, known: DataFrame, key: str = "key", arrival: str = "entry_id") -> DataFrame:
    """Exact check of the tables' answers: adds `true_seen`.

    A row is seen if its key is one of `known`, or its key has an earlier row: one aggregate by 128 bits of the key, joined back to
    the rows that weren't decided before any shuffle; those are exact as they are.
    """
    rows = answers.where("NOT decided").select(arrival, "h1", "h2")
    old = known.where(F.col(key).isNotNull()).select(F.lit(0).cast("long").alias(arrival), *key_hashes(key)).distinct()
    first = rows.unionByName(old).groupBy("h1", "h2").agg(F.min(arrival).alias("began"))
    asked = answers.where("NOT decided").join(first, ["h1", "h2"]).withColumn("true_seen", F.col(arrival) > F.col("began"))
    cols = [arrival, "seen", "true_seen"]
    return answers.where("decided").withColumn("true_seen", F.lit(True)).select(*cols).unionByName(asked.select(*cols))


def audited(answers: DataFrame) -> DataFrame:
    """One row (answers, answered_seen, wrong, wrong_share) of checked answers: how often the tables were wrong."""
    wrong = F.col("seen") != F.col("true_seen")
    return answers.agg(F.count("*").alias("answers"), F.count_if("seen").alias("answered_seen"), F.count_if(wrong).alias("wrong"), F.coalesce(F.avg(wrong.cast("double")), F.lit(0.0)).alias("wrong_share"))
