"""What several operators of this subpackage share: blanks, words, current records, sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that str.split() knows.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: A class of Java's regular expressions for blanks other than the line feed.
INLINE_BLANKS = "[\\t\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]"


def trimmed(text: Column | str) -> Column:
    """Without blanks at either end."""
    return F.btrim(text, F.lit(BLANKS))


def current_records(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The current record of each id: of its rows the one with the latest crawled_at, if its is_removed is false.

    One shuffle, with a partial aggregate before it, so an id with very many rows is no hot spot. Null ids are dropped;
    a null crawled_at is older than any other; a null is_removed counts as false. Rows that tie are taken to be
    identical; if not, the greatest row in the order of `columns` wins.
    """
    wanted = [c for c in columns if c != "id"]
    live = F.struct(F.coalesce("crawled_at", F.lit("0001-01-01").cast("timestamp")).alias("__at"), F.coalesce("is_removed", F.lit(False)).alias("__gone"), *wanted)
    last = docs.where("id IS NOT NULL").groupBy("id").agg(F.max(live).alias("r"))
    return last.where("NOT r.__gone").select("id", *[F.col(f"r.{c}").alias(c) for c in wanted])


def url_host(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)), F.lit(""))


def site(domain: Column, url: Column) -> Column:
    """`domain`, or if null (or blank) the host of `url`; lower-cased and without a leading www."""
    return F.regexp_replace(F.coalesce(F.nullif(F.lower(trimmed(domain)), F.lit("")), url_host(url)), r"^www\.", "")


def digest(text: Column) -> list[Column]:
    """128 bits of a text as two longs, which stand for the text wherever texts are compared."""
    return [F.xxhash64(text), F.xxhash64(F.lit(0x5BD1E995), text)]


def without_lines(text: Column, numbers: Column) -> Column:
    """A text without the lines of the given numbers (array of int, null for none); null stays null. Linear in both."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce(numbers, F.array().cast("array<int>")))
    return F.when(F.size(F.coalesce(numbers, F.array().cast("array<int>"))) == 0, text).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
