"""Lines repeated across the documents of one site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.common import INLINE_BLANKS, current_records, digest, site, trimmed, without_lines
from sparrowdex.operators.skew import join_stats
from sparrowdex.session import through_table


def same_lines(content: Column) -> Column:
    """The lines of a text in the form in which they are compared, in order; blank lines are empty strings.

    Runs of blanks are one space, letters lower-case, runs of ASCII digits '#', ends trimmed. The text is rewritten as a
    whole and then split at line feeds, so line i of the result is line i of the text.
    """
    t = F.lower(F.regexp_replace(F.regexp_replace(content, f"{INLINE_BLANKS}+", " "), "[0-9]+", "#"))
    return F.transform(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(" ")))


def _records(docs: DataFrame) -> DataFrame:
    """(id, site, content, day) of current records with a site and a text, kept in the shared folder as it is read thrice."""
    now = current_records(docs, ["content", "domain", "url", "crawled_at"]).where("content IS NOT NULL AND content <> ''")
    named = now.select("id", site(F.col("domain"), F.col("url")).alias("site"), "content", F.to_date("crawled_at").alias("day"))
    return through_table(named.where("site IS NOT NULL"), "records")


def _keyed(site_name: Column, line: Column) -> list[Column]:
    """128 bits that stand for a line of a site."""
    return [F.xxhash64(site_name, line).alias("h1"), F.xxhash64(F.lit(0x5BD1E995), line, site_name).alias("h2")]


def _counts(now: DataFrame) -> DataFrame:
    c = digest(F.col("content"))
    clusters = now.select("id", "site", c[0].alias("c1"), c[1].alias("c2")).groupBy("site", "c1", "c2").agg(F.min("id").alias("id"), F.count("*").alias("members"))
    lines = now.join(clusters.select("id", "members"), "id").select("site", "day", "members", same_lines(F.col("content")).alias("lines"))
    keys = F.transform(F.filter("lines", lambda x: x != ""), lambda x: F.struct(*_keyed(F.col("site"), x)))
    held = lines.select("day", "members", F.sort_array(keys).alias("ks"))  # equal lines side by side: linear but for the sort
    each = held.select("day", "members", F.posexplode(F.transform("ks", lambda k, i: F.struct(k["h1"].alias("h1"), k["h2"].alias("h2"), (~k.eqNullSafe(F.get("ks", i - 1))).cast("int").alias("first")))).alias("i", "k"))
    daily = each.select("k.*", "day", "members").groupBy("h1", "h2", "day").agg(
        F.sum("members").alias("line_rows"), F.sum(F.col("members") * F.col("first")).alias("records"), F.sum("first").alias("clusters")
    )
    return daily.groupBy("h1", "h2").agg(F.sum("line_rows").alias("line_rows"), F.sum("records").alias("records"), F.sum("clusters").alias("clusters"), F.count("*").alias("days"))


def line_counts(docs: DataFrame) -> DataFrame:
    """(h1, h2, line_rows, records, clusters, days) of every distinct non-blank line of a site, (h1, h2) standing for both.

    Duplicate documents are collapsed first: records of one site with the same text are one cluster, of which only the
    member with the least id is split into lines. A line's `clusters` and `days` (different dates of the clusters' first
    members) tell notices from republished articles; `records` counts the members of its clusters, and `line_rows` all
    its lines in all of them. Records without a site or text have no lines.
    """
    return _counts(_records(docs))


def repeated_lines(docs: DataFrame, least: int = 5, by: str = "records", days: int = 0) -> DataFrame:
    """(id, line_no, records, clusters, days) of each line that is in at least `least` of its site's `by`, on at least `days` dates.

    by: 'records' counts ids, 'clusters' counts texts, so that copies of one article don't make boilerplate of it; days
    does so for articles that are republished on one date with small edits. Unknown dates count as one.
    Null and empty texts have no lines; blank lines are never in the result. Hot lines are spread by id.
    """
    now = _records(docs)
    lines = now.select("id", "site", F.posexplode(same_lines(F.col("content"))).alias("line_no", "line")).where("line <> ''")
    keyed = lines.select("id", "line_no", *_keyed(F.col("site"), F.col("line")))
    return join_stats(keyed, _counts(now), ["h1", "h2"], "line_rows", "id", f"{by} >= {int(least)} AND days >= {int(days)}").select("id", "line_no", "records", "clusters", "days")


def without_repeated_lines(docs: DataFrame, least: int = 5, by: str = "clusters", days: int = 0) -> DataFrame:
    """(id, content, removed): each current record's text without its site's repeated lines, and how many went.

    Records without text keep their null or empty content, with 0 removed.
    """
    bad = repeated_lines(docs, least, by, days).groupBy("id").agg(F.collect_list("line_no").alias("bad"))
    now = current_records(docs, ["content"]).join(bad, "id", "left")
    return now.select("id", without_lines(F.col("content"), F.col("bad")).alias("content"), F.coalesce(F.size("bad"), F.lit(0)).alias("removed"))
