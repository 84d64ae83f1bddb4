"""Page furniture: a site style tree of presentation and content nodes with entropy-based importance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.common import without_lines
from sparrowdex.llm.pagelines import ENDS, folded, words
from sparrowdex.operators.skew import join_stats
from sparrowdex.session import through_table

#: Forms of a line, the presentation nodes of the tree.
TITLE, TRAIL, MENU, LINK, RIGHTS, ITEM, ADDRESS, TEXT, SENTENCE, HEAD, SHORT, OTHER = range(12)
#: What a line of a form is held for before its site is looked at: forms of the page's own. The others are furniture.
OWN = (TITLE, ITEM, ADDRESS, TEXT, SENTENCE, HEAD)
#: The importance of a content node is the information in its presence on a page of its site, in bits: at most so many for
#: furniture, ...
BITS = 2.0
#: ... and so many for forms that hold the page's own text in almost all cases.
BITS_OF_TEXT, FORMS_OF_TEXT = 0.4, (ITEM, ADDRESS, TEXT)
#: Pages of a site, and sites, that must have a node for that, and pages of a site for forms of text.
LEAST_PAGES, LEAST_SITES, LEAST_TEXT = 3, 3, 4
#: Lines at the end of a page, where notices stand.
LAST = 3

SEPARATED = re.compile(r"\s+[|/>»›·•*]\s+|\s*[|»›]\s*|\s{2,}|\t+")
PARTED = re.compile(r"[|/>»›·•*\t]|  ")
TRAILS = re.compile(r"\s+[>»›/|]\s+")
LISTED = re.compile(r"(?:[-*–]|\d{1,3}[.)])\s+\S")
COUNTED = re.compile(r"[^,]*[^\W\d_] \d+(?:, [^,]*[^\W\d_] \d+)+[.]?$")
LINKED = re.compile(r"(?:→|»|›|>)\s|•.*\(\d+ [^\W\d_]+\)$")
PLACED = re.compile(r"\[[^\]]*\]\(|https?://|#\w")
SIGN_OFF = re.compile(r"(.*[.!?…]['\"”’»)]*)\s+[^\W\d_]+$")
INNER = re.compile(r"(?:(?<!\d)\.|[!?。！？])['\"”’»)]*\s+[^\sa-zß-ÿ]")
NAMES = re.compile(r"\b[^\W\d_a-zß-ÿ][^\W\d_]*")
DIGITS = re.compile(r"\d+")
TWO_WORDS = re.compile(r"[^\W\d_]{2,}(?![^\W\d_]).*?[^\W\d_]{2,}")


def template(line: str) -> str:
    """What a line has in common with its kin: digits as #, names (capitalised words) as @, if enough words are left."""
    line = DIGITS.sub("#", " ".join(line.split()))
    if not line.isupper():
        masked = NAMES.sub("@", line)
        if TWO_WORDS.search(masked):
            return masked
    return line.casefold()


class _Forms(dict):
    """Form and template hash of a line that don't depend on its page, kept as lines recur; emptied when large."""

    def __missing__(self, s: str) -> tuple[int, int]:
        if len(self) > 1 << 16:
            self.clear()
        self[s] = v = _form(s), xxhash.xxh64_intdigest(template(s)) >> 1
        return v


FORMS = _Forms()


def _form(s: str) -> int:
    if LISTED.match(s) or s[-1:].isdigit() and COUNTED.match(s) or s[-2:-1].isdigit() and COUNTED.match(s):
        return ITEM
    if PARTED.search(s):
        parts = [p for p in SEPARATED.split(s) if p]
        if len(parts) >= 3 and all(len(p.split()) <= 3 for p in parts) and not ENDS.search(s):
            return MENU
        single = len(parts) == 1
    else:
        single = True
    inner = INNER.search(s)
    if s.endswith("…") or LINKED.match(s):
        return SENTENCE if inner else LINK
    if "©" in s[:3]:
        return RIGHTS
    if PLACED.match(s):
        return ADDRESS
    if inner:
        return TEXT
    if ENDS.search(s) and not s.endswith(":"):
        return SENTENCE
    if single and len(words(s)) <= 4 and not re.search(r"\d|[:|/…☰]", s):
        return SHORT
    return OTHER


def page_nodes(title: str | None, content: str | None) -> list[tuple[int, int, int]]:
    """(line number, template hash, form) of every line of a page that isn't blank, in order: the leaves of its tree."""
    lines = [(i, s) for i, x in enumerate((content or "").split("\n")) if (s := x.strip())]
    name = folded(title or "")
    own = set(words(name))
    crumbs = {folded(TRAILS.split(s)[-1]) for _, s in lines if PARTED.search(s) and TRAILS.search(s)} - {""}
    least, most, whole = 0.7 * len(own), 2 * len(own), max(len(name), *map(len, crumbs), 0) + 40  # no longer line without double blanks is the title
    out = []
    for k, (i, s) in enumerate(lines):
        form, node = FORMS[s]
        f = folded(s) if len(s) < whole or PARTED.search(s) else ""
        if name and f and (f == name or f.startswith(name) and len(f) - len(name) < 30 and f[len(name) :].lstrip()[:1] in tuple("–-|·:")):
            form = TITLE
        elif name and f.endswith(name) and TRAILS.search(s):
            form = TRAIL
        elif f in crumbs or len(own) >= 4 and least <= s.count(" ") + 1 <= most and _alike(s, own):
            form = TITLE
        elif form in (TEXT, OTHER) and k == len(lines) - 1 and (base := SIGN_OFF.match(s)):
            form = TEXT if INNER.search(base[1]) else SENTENCE
        out.append((i, node, form))
    for k, (i, node, form) in enumerate(out):
        if form == SHORT and not (k and out[k - 1][2] == TITLE) and _heads(out, k):
            out[k] = i, node, HEAD
    return out


def _heads(lines: list[tuple[int, int, int]], k: int) -> bool:
    """Whether a text follows line k directly, or another heading that a text follows; right below the title bylines stand."""
    after = [f for _, _, f in lines[k + 1 : k + 3]]
    own = (ITEM, ADDRESS, TEXT, SENTENCE)
    return bool(after) and (after[0] in own or after[0] in (SHORT, HEAD) and after[-1] in own)


def _alike(line: str, own: set[str]) -> bool:
    """Whether a line is the title, of which `own` are the words, but for an edit."""
    a = set(words(line))
    return len(a & own) >= 0.7 * len(a | own)


def style_nodes(pages: DataFrame) -> DataFrame:
    """(id, site, line_no, node, form, first, last): the leaves of the trees of all pages (id, site, title, content).

    node stands for the line's template, form for its presentation. `first` is 1 for a template's first line on its page, so
    that sums count pages, `last` for the LAST lines of a page. site is 64 bits of its name; pages of the site null have nodes too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sites, titles, contents = (c.to_pylist() for c in batch.columns)
            cols: list[list] = [[] for _ in range(7)]
            for i, h, t, c in zip(ids, sites, titles, contents):
                lines, seen = page_nodes(t, c), set()
                if lines:
                    numbers, hashes, forms = zip(*lines)
                    n = len(lines)
                    firsts = [0 if x in seen or seen.add(x) else 1 for x in hashes]
                    for col, v in zip(cols, ([i] * n, [h] * n, numbers, hashes, forms, firsts, [0] * (n - LAST) + [1] * min(n, LAST))):
                        col.extend(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "site", "line_no", "node", "form", "first", "last"])

    return pages.select("id", _site_key(), "title", "content").mapInArrow(
        run, "id long, site long, line_no int, node long, form int, first int, last int"
    )


def _site_key() -> Column:
    return F.xxhash64(F.coalesce("site", F.lit(""))).alias("site")


def node_importance(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, node, rows, bits, pages, sites, all_pages, all_rows, wide_bits, heads, noticed) of every content node.

    bits is the information in the node's presence on a page of its site, -log2 of the share of the site's pages that
    have it; wide_bits the same over all pages of all sites that have the node. Low values are furniture. heads is the
    share of the node's lines, over all sites, that stand at a heading's place, noticed the share that a site's tree finds to
    be furniture or that stand at the end of a page. Each level is kept in the shared folder, as it is read more than once.
    """
    sizes = pages.groupBy(_site_key()).agg(F.count("*").alias("size"))
    head = (F.col("form") == HEAD).cast("int")
    own = nodes.groupBy("site", "node").agg(F.sum("first").alias("pages"), F.count("*").alias("rows"), F.sum(head).alias("heads"), F.sum("last").alias("last")).join(sizes, "site")
    own = through_table(own.withColumn("bits", -F.log2(F.col("pages") / F.col("size"))), "site-nodes")
    low = F.when((F.col("bits") <= BITS) & (F.col("pages") >= LEAST_PAGES), F.col("rows")).otherwise(F.col("last"))
    wide = own.groupBy("node").agg(
        F.count("*").alias("sites"), F.sum("pages").alias("all_pages"), F.sum("rows").alias("all_rows"), (-F.log2(F.sum("pages") / F.sum("size"))).alias("wide_bits"),
        (F.sum("heads") / F.sum("rows")).alias("heads"), (F.sum(low) / F.sum("rows")).alias("noticed"),
    )
    own = own.select("site", "node", "rows", "bits", "pages")
    return through_table(join_stats(own, through_table(wide, "nodes"), ["node"], "sites", "site"), "style-tree")


def furniture_lines(pages: DataFrame) -> DataFrame:
    """(id, line_no) of the lines of pages (id, site, title, content) that aren't the page's own.

    Lines of any length are leaves of their page's tree: their form is a presentation node, their template a content node
    below it; the pages of one site are merged by both. A content node of little information on its site (BITS, on LEAST_PAGES
    pages or more), or over LEAST_SITES sites or more, is furniture wherever it stands; forms of text (list entries, addresses,
    texts of several sentences) must have less on a site (BITS_OF_TEXT), as the pages of a small site share such. A sentence that
    LEAST_SITES sites repeat is furniture if in most places their trees find it so or it ends the page. A line without a sentence is the page's own
    if most of its like, over all sites, stand at a heading's place, directly above text. Else the form decides: titles, headings,
    sentences, list items and texts are the page's own; menus, trails, links and other lines are not. Null and empty texts have no
    lines; blank lines are never in the result.
    """
    nodes = through_table(style_nodes(pages), "style-leaves")
    tree = node_importance(nodes, pages)
    across = (F.col("sites") >= LEAST_SITES) & (F.col("all_pages") >= 2 * LEAST_SITES)
    low = (F.col("bits") <= BITS) & (F.col("pages") >= LEAST_PAGES) | across & (F.col("wide_bits") <= BITS)
    less = (F.col("bits") <= BITS_OF_TEXT) & (F.col("pages") >= LEAST_TEXT) | across & (F.col("wide_bits") <= BITS)
    tree = tree.select(
        "site", "node", "rows", low.alias("low"), less.alias("less"), (across & (F.col("noticed") >= 0.5)).alias("noticed"), F.when(F.col("all_rows") >= 2 * LEAST_SITES, F.col("heads")).alias("heads")
    )
    met = join_stats(nodes.select("id", "site", "line_no", "node", "form"), tree, ["site", "node"], "rows", "id")
    form = F.col("form")
    plain = F.when(form.isin(HEAD, SHORT, OTHER) & F.col("heads").isNotNull(), F.col("heads") < 0.5).when((form == SENTENCE) & F.col("noticed"), F.lit(True)).otherwise(~form.isin(*OWN))
    found = F.when(form == TITLE, F.lit(False)).when(form.isin(*FORMS_OF_TEXT), F.col("less")).otherwise(F.col("low") | plain)
    return met.where(found).select("id", "line_no")


def is_web_page(content_type: Column) -> Column:
    """HTML in any spelling, XHTML too, or no content type."""
    return content_type.isNull() | F.contains(F.lower(content_type), F.lit("html"))


def main_text(pages: DataFrame) -> DataFrame:
    """(id, content): each page's text without its furniture, line by line; null texts stay null."""
    bad = furniture_lines(pages).groupBy("id").agg(F.collect_list("line_no").alias("bad"))
    return pages.join(bad, "id", "left").select("id", without_lines(F.col("content"), F.col("bad")).alias("content"))
