"""Queries over duplicates and membership, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparrowdex.functions.text import simple_words_sql
from sparrowdex.operators import dedup as D
from sparrowdex.session import through_table
from sparrowdex.sources.tables import table

def _shape(spark, d) -> tuple[int, int]:
    """Shape of the filter of all page addresses, by their number."""
    return D.bloom_shape(max(1, table(spark, d, "docs").where("url IS NOT NULL").select("url").distinct().count()), 0.01)


def _fp(spark, d):
    return D.fingerprints(table(spark, d, "documents"))


def simhash64(spark, d):
    return _fp(spark, d)


def lsh_bands(spark, d):
    return D.bands(_fp(spark, d), 8).select("doc_id", "band", "value")


def near_dups(spark, d):
    """Pairs of fingerprints up to 9 bits apart; a text with a few edits is that far in texts as short as these."""
    return D.near_duplicates(_fp(spark, d), 9)


def near_dup_classes(spark, d):
    """Every document with its class of equal fingerprints; `near_dups` links the classes."""
    return D.fingerprint_classes(table(spark, d, "documents"), through_table(_fp(spark, d), "fingerprints"))


def exact_dups(spark, d):
    return D.exact_duplicates(table(spark, d, "documents"))


def bloom_bits(spark, d):
    return D.bloom_words(table(spark, d, "docs"), "url", *_shape(spark, d))


def bloom_rate(spark, d):
    m, k = _shape(spark, d)
    w = bloom_bits(spark, d).agg(F.sum(F.bit_count("bits").cast("long")).alias("set_bits"))
    return w.select("set_bits", F.round(F.pow(F.col("set_bits") / m, k), 9).alias("false_positive_rate"))


def bloom_merged(spark, d):
    """The union of the filters of even and odd pages, through JSON: that of all."""
    m, k = _shape(spark, d)
    halves = [D.bloom_words(table(spark, d, "docs").where(F.pmod("id", F.lit(2)) == i), "url", m, k) for i in (0, 1)]
    return D.bloom_union(*[D.bloom_from_json(D.bloom_json(h, m, k)) for h in halves])


def fnv_hashes(spark, d):
    return table(spark, d, "docs").select("domain").distinct().where("domain IS NOT NULL").select("domain", D.fnv1a("domain").alias("hash"))


def duplicate_pages(spark, d):
    """Pages whose later fetches (after the mean time of all) are at most 3 bits from an earlier fetch of any page."""
    docs = table(spark, d, "docs").where("content IS NOT NULL AND crawled_at IS NOT NULL").select(F.col("id").alias("doc_id"), F.col("content").alias("text"), F.unix_micros("crawled_at").alias("us"))
    mean = docs.agg(F.avg("us").alias("m")).scalar()
    known = D.fingerprints(docs.where(F.col("us") < mean))
    return D.near_copies(docs.where(F.col("us") >= mean), known.select("fp")).distinct()


def visited_anti(spark, d):
    f, v = table(spark, d, "frontier").where("url IS NOT NULL"), table(spark, d, "docs").select("url").distinct()
    return f.join(v, "url", "left_anti").select("entry_id", "url")


def visited_maybe(spark, d):
    f = table(spark, d, "frontier").select("entry_id", "url")
    return D.maybe_known(f, "url", bloom_bits(spark, d), *_shape(spark, d)).select("entry_id")


VOTES = ", ".join(f"sum(CASE WHEN (instr('0123456789abcdef', substr(h, {2 * (i // 8) + (1 if i % 8 >= 4 else 2)}, 1)) - 1) >> {i % 4} & 1 = 1 THEN w ELSE -w END) AS v{i}" for i in range(64))
FP = f"""WITH sh AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS s
  FROM (SELECT doc_id, {simple_words_sql('text')} AS ws FROM documents)),
votes AS (SELECT doc_id, {VOTES} FROM (SELECT doc_id, md5(s) AS h, count(*) * count(*) AS w FROM sh GROUP BY doc_id, s) GROUP BY doc_id),
fps AS (SELECT doc_id, CAST({' + '.join(f'(CASE WHEN v{i} >= 0 THEN {1 << i if i < 63 else -(1 << 63)} ELSE 0 END)::HUGEINT' for i in range(64))} AS BIGINT) AS fp FROM votes)"""
BLOOM = """WITH h AS (SELECT md5(url) AS h FROM docs WHERE url IS NOT NULL), n AS (SELECT greatest(1, count(DISTINCT url)) AS n FROM docs),
shape AS (SELECT CAST(ceil(-n * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS m, CAST(greatest(1, ceil(ceil(-n * ln(0.01) / (ln(2) * ln(2))) / n * ln(2))) AS BIGINT) AS k FROM n),
b AS (SELECT unnest(list_transform(range(k), lambda i: (('0x' || substr(h, 1, 8))::BIGINT + i * ('0x' || substr(h, 9, 8))::BIGINT) % m)) AS b FROM h, shape),
words AS (SELECT b >> 5 AS word, bit_or(1::BIGINT << (b % 32)) AS bits FROM b GROUP BY b >> 5)"""
FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, octet_length(encode(domain))), lambda i: ('0x' || substr(hex(encode(domain)), (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"

ORACLES = {
    "simhash64": f"{FP} SELECT * FROM fps",
    "lsh_bands": f"{FP} SELECT doc_id, CAST(k AS INTEGER) AS band, CAST((CASE WHEN fp < 0 THEN fp::HUGEINT + 18446744073709551616::HUGEINT ELSE fp END >> (8 * k)::INTEGER) % 256 AS BIGINT) AS value FROM fps, range(8) r(k)",
    "near_dups": f"""{FP}, one AS (SELECT fp, min(doc_id) AS doc_id FROM fps GROUP BY fp)
SELECT a.doc_id AS a, b.doc_id AS b, CAST(bit_count(xor(a.fp, b.fp)) AS INTEGER) AS distance FROM one a JOIN one b ON a.doc_id < b.doc_id WHERE bit_count(xor(a.fp, b.fp)) <= 9""",
    "exact_dups": "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class FROM documents WHERE text IS NOT NULL",
    "bloom_bits": f"{BLOOM} SELECT * FROM words",
    "bloom_rate": f"{BLOOM} SELECT CAST(sum(bit_count(bits)) AS BIGINT) AS set_bits, round(pow(sum(bit_count(bits)) / any_value(m), any_value(k)), 9) AS false_positive_rate FROM words, shape",
    "bloom_merged": f"{BLOOM} SELECT * FROM words",
    "fnv_hashes": f"SELECT DISTINCT domain, {FNV} AS hash FROM docs WHERE domain IS NOT NULL",
    "visited_maybe": f"""{BLOOM}, q AS (SELECT entry_id, k, unnest(list_transform(range(k), lambda i: (('0x' || substr(md5(url), 1, 8))::BIGINT + i * ('0x' || substr(md5(url), 9, 8))::BIGINT) % m)) AS b FROM frontier, shape WHERE url IS NOT NULL)
SELECT entry_id FROM q JOIN words ON word = b >> 5 AND (bits >> (b % 32)) & 1 = 1 GROUP BY entry_id, k HAVING count(*) = k""",
    "visited_anti": "SELECT entry_id, url FROM frontier WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM docs WHERE url IS NOT NULL)",
}
QUERIES = {k: globals()[k] for k in (*ORACLES, "near_dup_classes", "duplicate_pages")}
