"""Crawl relations: page parse, links, frontier, robots, politeness, link-graph rank, and a hash ring for placement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.session import through_table


def html_title(html: Column | str) -> Column:
    """Text of the first title element, trimmed; empty if there is none, null for null."""
    return F.trim(F.regexp_extract(html, "(?i)<title[^>]*>([^<]*)</title>", 1))


def html_text(html: Column | str) -> Column:
    """Text without scripts, styles, tags and entities, blanks run together."""
    t = F.regexp_replace(F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>", ""), "(?is)<style[^>]*>.*?</style>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), "&[^;]+;", " "), "\\s+", " "))


def html_links(html: Column | str, base: Column) -> Column:
    """Targets of anchors; root-relative ones resolved against `base`, others that aren't absolute by its folder."""
    hrefs = F.regexp_extract_all(html, F.lit("(?i)<a[^>]+href\\s*=\\s*[\"']([^\"']+)[\"'][^>]*>"), F.lit(1))
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(F.concat(base, F.lit("")), "^([A-Za-z][A-Za-z0-9+.-]*://[^?#]*/)", 1)
    return F.transform(hrefs, lambda h: F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(F.startswith(h, F.lit("/")), F.concat(root, h)).otherwise(F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/"))), h)))


def frontier_rows(links: DataFrame, visited: DataFrame, max_depth: int = 10) -> DataFrame:
    """(url, depth, priority) of http(s) links not visited and not too deep, each URL once at its least depth.

    links: (url, depth, rank); priority = max(0, 10 * depth - 100 * rank), less is sooner. Null URLs are dropped.
    """
    ok = links.where(F.col("url").rlike("^https?://") & (F.col("depth") <= max_depth)).groupBy("url").agg(F.min("depth").alias("depth"), F.max(F.coalesce("rank", F.lit(0.0))).alias("rank"))
    return ok.join(visited.select("url").distinct(), "url", "left_anti").select("url", "depth", F.greatest(F.lit(0.0), F.col("depth") * 10 - F.col("rank") * 100).alias("priority"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """URLs (url, domain) that the rules (domain, prefix, allow) let pass: the longest prefix of the path decides, of equal
    ones an allowing one; none means allowed. Rules are met by domain; domains without rules pass."""
    path = F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    met = urls.withColumn("path", F.when(path == "", "/").otherwise(path)).join(rules, "domain").where(F.startswith("path", F.col("prefix")))
    no = met.groupBy("url", "domain").agg(F.max(F.struct(F.length("prefix").alias("n"), "allow")).alias("r")).where("NOT r.allow").select("url", "domain")
    return urls.join(no, ["url", "domain"], "left_anti")


def politeness_slots(frontier: DataFrame, delay_ms: int = 1000, parallel: int = 3, key: str = "entry_id") -> DataFrame:
    """(entry_id, domain, slot, start_ms): the place of each entry in its domain's queue by priority and arrival.

    `parallel` entries of a domain start together, the next ones `delay_ms` later. Entries are laid out by ranges of domain,
    priority and arrival, and places are counted by range and domain first, so a domain with a third of all entries isn't sorted in
    one task. Null domains are one queue, null priorities come last.
    """
    rows = frontier.select(key, F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("priority", F.lit(1e308)).alias("p"))
    parts = through_table(rows.repartitionByRange("domain", "p", key).select("*", F.spark_partition_id().alias("part")), "ranges")
    sizes = parts.groupBy("domain", "part").agg(F.count("*").alias("n"))
    before = sizes.select("domain", "part", (F.sum("n").over(Window.partitionBy("domain").orderBy("part")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("domain", "part").orderBy("p", key))
    slot = parts.withColumn("k", inside).join(before, ["domain", "part"]).withColumn("slot", F.col("before") + F.col("k") - 1)
    return slot.select(key, "domain", "slot", (F.floor(F.col("slot") / parallel) * delay_ms).alias("start_ms"))


def page_documents(fetched: DataFrame) -> DataFrame:
    """Documents of fetched pages (url, body, depth, priority, links): title or else the address, text, its first 200 characters, id by the
    address, rank max(0, 1 - priority / 100), host. Bodies that are null give no document."""
    text = html_text(F.col("body"))
    title = html_title(F.col("body"))
    return fetched.where("body IS NOT NULL").select(
        F.xxhash64("url").alias("id"), "url", F.when(F.length(title) > 0, title).otherwise(F.col("url")).alias("title"), text.alias("content"), F.substring(text, 1, 200).alias("snippet"),
        F.expr("try_parse_url(url, 'HOST')").alias("domain"), F.greatest(F.lit(0.0), 1 - F.col("priority") / 100).alias("page_rank"), F.col("depth").alias("crawl_depth"), "links",
    )


def crawl(pages: DataFrame, seeds: DataFrame, max_pages: int = 1000, max_depth: int = 3, batch: int = 256, rules: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """(documents, counters): follow links through a table of pages (url, body, links) from seeds (url), best first.

    In each round the `batch` entries of least priority, then address, are fetched by a join with the pages, and their links are added
    to the frontier unless they were there before, are too deep, aren't http(s) or the rules forbid them. Frontier and visited addresses
    stay tables in the shared folder; the driver holds counters alone. Ends with an empty frontier or `max_pages` documents.
    """
    web = pages.where("url IS NOT NULL").groupBy("url").agg(F.max(F.struct("body", "links")).alias("p")).select("url", "p.*")
    start = seeds.select("url", F.lit(0).alias("depth"), F.lit(0.0).alias("rank"))
    frontier = through_table(frontier_rows(start, seeds.select("url").where("false"), max_depth), "frontier")
    visited = through_table(frontier.select("url").where("false"), "visited")
    out, n, rounds, missing = [], 0, 0, 0
    while n < max_pages and (waiting := frontier.count()):
        now = through_table(frontier.orderBy("priority", "url").limit(min(batch, max_pages - n)), "round")
        got = through_table(now.join(web, "url", "left"), "fetched")
        visited = through_table(visited.unionByName(now.select("url")), "visited")
        links = got.where("links IS NOT NULL").select(F.explode("links").alias("url"), (F.col("depth") + 1).alias("depth"), F.lit(0.0).alias("rank"))
        new = frontier_rows(links, visited, max_depth)
        if rules is not None:
            new = robots_allowed(new.withColumn("domain", F.expr("try_parse_url(url, 'HOST')")), rules).drop("domain")
        both = frontier.join(now.select("url"), "url", "left_anti").select("url", "depth", "priority").unionByName(new)
        frontier = through_table(both.groupBy("url").agg(F.min("depth").alias("depth"), F.min("priority").alias("priority")), "frontier")
        docs = through_table(page_documents(got), "documents")
        found = docs.count()
        out.append(docs)
        n, rounds, missing = n + found, rounds + 1, missing + min(waiting, batch) - found
    empty = page_documents(web.where("false").withColumn("depth", F.lit(0)).withColumn("priority", F.lit(0.0)))
    documents = empty
    for d in out:
        documents = documents.unionByName(d)
    return documents, {"documents": n, "rounds": rounds, "visited": visited.count(), "waiting": frontier.count(), "missing": missing}


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, every: int = 5) -> DataFrame:
    """(node, rank) after `rounds` steps over (src, dst) edges; nodes without links out keep their share.

    Repeated edges and links to oneself are dropped. The lineage is cut through the shared folder every few rounds.
    """
    e = through_table(edges.where("src <> dst").distinct(), "edges")
    out = e.groupBy("src").agg(F.count("*").alias("deg"))
    w = e.join(out, "src")
    nodes = through_table(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct(), "nodes")
    ranks = nodes.withColumn("rank", F.lit(1.0))
    for k in range(rounds):
        got = w.join(ranks, w.src == ranks.node).groupBy("dst").agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        ranks = nodes.join(got, nodes.node == got.dst, "left").select("node", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if (k + 1) % every == 0 and k + 1 < rounds:
            ranks = through_table(ranks, "ranks")
    return ranks


def ring_hash(key: Column) -> Column:
    """First four bytes of the MD5, as a whole number."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def ring(spark, nodes: list[str], virtual: int = 150) -> DataFrame:
    """(h, node): places of each node's virtual nodes on the ring; ordered, one owner a place."""
    rows = spark.createDataFrame([(n, f"{n}:vnode:{i}") for n in nodes for i in range(virtual)], "node string, v string")
    return rows.select(ring_hash(F.col("v")).alias("h"), "node").groupBy("h").agg(F.min("node").alias("node"))


def _places(places: DataFrame) -> tuple[np.ndarray, list[str]]:
    """The ring in order: a few thousand places at most."""
    got = sorted((r.h, r.node) for r in places.collect())
    return np.array([h for h, _ in got], np.int64), [n for _, n in got]


def ring_lookup(keys: DataFrame, column: str, places: DataFrame) -> DataFrame:
    """Adds `node`: the owner of the first place at or after the key's hash, around the ring. Null keys have none.

    The ring, a few thousand places at most, is sent as one sorted array, in which a batch of keys is placed at once.
    """
    hs, ns = _places(places)

    @F.pandas_udf("string")
    def owner(h: pd.Series) -> pd.Series:
        if not ns:
            return pd.Series([None] * len(h), dtype=object)
        at = np.searchsorted(hs, h.fillna(0).to_numpy(np.int64)) % len(hs)
        return pd.Series(np.array(ns, object)[at]).where(h.notna().to_numpy(), None)

    return keys.withColumn("node", owner(ring_hash(F.col(column).cast("string"))))


def ring_replicas(keys: DataFrame, column: str, places: DataFrame, count: int = 3) -> DataFrame:
    """Adds `nodes`: the first `count` different owners from the key's hash on, around the ring; all nodes if there are fewer.

    The owners from each place on are laid out once for the ring, so a key is placed like in `ring_lookup`.
    """
    hs, ns = _places(places)
    lists = [list(dict.fromkeys(ns[i:] + ns[:i]))[:count] for i in range(len(ns))]

    @F.pandas_udf("array<string>")
    def owners(h: pd.Series) -> pd.Series:
        at = np.searchsorted(hs, h.fillna(0).to_numpy(np.int64)) % max(1, len(hs))
        return pd.Series([lists[i] if ok and lists else None for i, ok in zip(at.tolist(), h.notna())], dtype=object)

    return keys.withColumn("nodes", owners(ring_hash(F.col(column).cast("string"))))


def ring_without(places: DataFrame, node: str) -> DataFrame:
    """The ring after a node has left: its places go to the next ones."""
    return places.where(F.col("node") != node)
