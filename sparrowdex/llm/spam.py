"""Keyword-stuffed and link-list pages: recurrence gaps and lag windows, lists without function words, a fitted decision."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowdex.llm.pagelines import folded, words
from sparrowdex.session import through_table

#: Words of a window; reach of a recurrence and largest lag of the autocorrelation, in words.
WINDOW, REACH, LAGS = 48, 40, 32
#: Share of a window's words, function words aside, that recur within REACH: from the first on it counts as repetition, in full from the second.
REPEATED = (0.15, 0.35)
#: Share of function words of a window: below the second it counts as a list, in full from the first down.
LISTED = (0.15, 0.35)
#: A function word is in more than this share of a language's pages; so short a word may be one in any language.
SPREAD, SHORT = 0.5, 3
FEATURES = ("repeated", "listed", "regular", "periodic", "distinct", "linked")
#: What the decision is without labels: a page is a case if about half of its text is repetition or list.
PRIOR = np.array([-4.5, 9.0, 9.0, 0.5, 0.5, 0.0, 0.0])
#: At most this many labelled pages are used to fit the decision.
SAMPLE = 4000
TAG = re.compile("[a-z]{2}")


def function_words(pages: DataFrame) -> frozenset[str]:
    """Function words of the corpus: words that for certain (95 %) are in more than SPREAD of the pages of a language.

    pages: (title, content, language). The language is the first two letters of that column, null and odd ones being one
    more; it only groups the counts, which are of all pages. A language has at most the words of a page over SPREAD such
    words, so few come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            rows = [(g, w, n) for g, c in held.items() for w, n in c.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["tag", "w", "n"])

        for batch in batches:
            for content, language in zip(*(c.to_pylist() for c in batch.columns)):
                found = TAG.match((language or "").strip().lower())
                own = set(words(content or ""))
                if own:
                    held.setdefault(found[0] if found else "", Counter()).update([*own, ""])
            if sum(map(len, held.values())) > 1 << 20:
                yield flush()
        yield flush()

    counts = pages.select("content", "language").mapInArrow(count, "tag string, w string, n long").groupBy("tag", "w").agg(F.sum("n").alias("n"))
    counts = through_table(counts, "spread")
    sizes = counts.where("w = ''").select("tag", F.col("n").alias("size"))
    sure = F.col("n") - 1.645 * F.sqrt(F.col("n") * (1 - F.col("n") / F.col("size")) + 1) > SPREAD * F.col("size")
    return frozenset(r.w for r in counts.where("w <> ''").join(F.broadcast(sizes), "tag").where(sure).select("w").distinct().collect())


def page_features(title: str | None, content: str | None, links: int, known: frozenset[str] = frozenset()) -> list[float]:
    """The six features of a page, each from 0 to 1; zeros for a null or empty text.

    All lines count but the title, of any length, addresses as text of the words beside them. The words are taken in windows
    of about WINDOW. repeated: share of the
    text in windows whose words, function words aside, recur within REACH. listed: share in other windows, as far as they lack
    function words (`known` ones and words of up to SHORT letters). regular: how even the gaps between recurrences of a term
    are, over terms with four or more (1 / (1 + variation)), by their share of the text. periodic: the largest autocorrelation
    of the sequence of words over lags up to LAGS, function words aside. distinct: share of different words among those of
    listed windows. linked: links a word.
    """
    name, sequence, weight = folded(title or ""), [], []
    most = 2 * len(title or "") + 100
    for line in (content or "").split("\n"):
        if line and (len(line) > most or folded(line) != name) and (own := words(line)):
            sequence += own
            weight += [len(line) / len(own)] * len(own)
    n = len(sequence)
    if not n:
        return [0.0] * 6
    codes: dict[str, int] = {}
    seq = np.fromiter([codes.setdefault(w, len(codes)) for w in sequence], np.int64, n)
    stop = np.fromiter([w in known or len(w) <= SHORT and w.isalpha() for w in codes], bool, len(codes))[seq]
    order = np.argsort(seq, kind="stable")
    sorted_ = seq[order]
    again = np.flatnonzero(sorted_[1:] == sorted_[:-1]) + 1  # places in order of a word that was there before
    at, gap = order[again], order[again] - order[again - 1]
    plain = ~stop[at]
    at, gap, term = at[plain], gap[plain], sorted_[again[plain]]
    k = max(1, round(n / WINDOW))
    cuts = np.arange(k + 1) * n // k
    window = np.searchsorted(cuts, np.arange(n), "right") - 1
    size, own, text = np.diff(cuts), np.bincount(window, ~stop, k), np.bincount(window, weight, k)
    repeated = _share(np.bincount(window[at[gap <= REACH]], minlength=k) / np.maximum(1, own), *REPEATED)
    listed = (1 - repeated) * (1 - _share(1 - own / size, *LISTED))
    whole = text.sum()
    count = np.bincount(term, minlength=len(codes))
    many = count >= 3
    regular = 0.0
    if many.any():
        gap = gap.astype(float)
        mean = np.bincount(term, gap, len(codes))[many] / count[many]
        var = np.maximum(np.bincount(term, gap * gap, len(codes))[many] / count[many] - mean**2, 0)
        regular = float((count[many] / (1 + np.sqrt(var) / mean)).sum() / n)
    seq[stop] = -1 - np.flatnonzero(stop)
    periodic = max([np.count_nonzero(seq[k:] == seq[:-k]) / (n - k) for k in range(1, min(LAGS, n - 1) + 1)], default=0.0)
    held = seq[(listed > 0.5)[window] & ~stop].tolist()
    return [float((repeated * text).sum() / whole), float((listed * text).sum() / whole), regular, periodic, len(set(held)) / len(held) if held else 0.0, min(1.0, links / n)]


def _share(x: np.ndarray, a: float, b: float) -> np.ndarray:
    return np.minimum(1, np.maximum(0, (x - a) / (b - a)))


def feature_table(pages: DataFrame, known: frozenset[str]) -> DataFrame:
    """(id, f array<double>) of pages (id, title, content, links), in one pass without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, titles, contents, links = (c.to_pylist() for c in batch.columns)
            f = [page_features(t, c, n or 0, known) for t, c, n in zip(titles, contents, links)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(f, pa.list_(pa.float64()))], ["id", "f"])

    return pages.select("id", "title", "content", "links").mapInArrow(run, "id long, f array<double>")


def fitted(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights (bias first) of a logistic decision, fitted to at most `sample` labelled pages around PRIOR.

    Labels other than spam and ok are left out, of an id's several labels all count. The sample is the labelled pages
    of least hash. With few labels the result stays near PRIOR, so wrong labels don't turn it.
    """
    y = F.when(F.col("verdict") == "spam", 1.0).when(F.col("verdict") == "ok", 0.0)
    rows = labels.select("id", y.alias("y")).where("y IS NOT NULL").join(features, "id").orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    w = PRIOR.copy()
    if rows:
        x = np.array([[1.0, *r.f] for r in rows])
        t = np.array([r.y for r in rows])
        for _ in range(25):  # Newton steps on the penalised likelihood; labels are taken to be wrong now and then
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            q = 0.05 + 0.9 * p
            r = (t - q) * 0.9 * p * (1 - p) / (q * (1 - q))
            v = (0.9 * p * (1 - p)) ** 2 / (q * (1 - q))
            step = np.linalg.solve(x.T @ (x * v[:, None]) + np.eye(len(w)), x.T @ r - (w - PRIOR))
            w = w + step
            if np.abs(step).max() < 1e-6:
                break
    return w


def is_case(features: Column, w: np.ndarray) -> Column:
    """Whether the decision with weights `w` takes a page for spam."""
    return F.lit(float(w[0])) + sum(features[i] * float(x) for i, x in enumerate(w[1:])) > 0


def list_pages(pages: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(id, f, spam) of pages (id, title, content, links, language): which serve keywords, links or tags in place of sentences.

    The features are computed once and kept in the shared folder, as the fit and the decision both read them. A page
    without text isn't spam; repeated ids have a row each.
    """
    f = through_table(feature_table(pages, function_words(pages)), "page-features")
    return f.withColumn("spam", is_case(F.col("f"), fitted(f, labels, sample)))
