"""Snippets: sentences, relevance, diverse selection, highlighting."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stop words of snippet queries.
STOP_WORDS = frozenset(
    """
    the and for are but not you all any can had her was one our out has have been some them than what when where which while who will with would about
    after before between still again also another because every form found great into just like make many more most much only other over such that their
    then there these they this those through under very were
    """.split()
)


def query_terms(query: str) -> list[str]:
    """Words of more than two letters that aren't stop words, unstemmed."""
    return [t for t in re.sub(r"[^a-z0-9_\s]", "", query.lower()).split() if len(t) > 2 and t not in STOP_WORDS]


def sentences(text: Column | str) -> Column:
    """Pieces of more than 20 characters between ends of sentences before a capital, and line ends. Null gives null."""
    cut = F.split(F.regexp_replace(text, "([.?!])\\s*(?=[A-Z])", "$1\n"), "\n")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.length(s) > 20)


def relevance(sentence: Column, terms: list[str]) -> Column:
    """0.7 of the share of terms in the sentence, and 0.3 of how close their first places are."""
    low = F.lower(sentence)
    at = [F.instr(low, t) for t in terms]
    hit = sum((F.when(a > 0, 1).otherwise(0) for a in at), F.lit(0))
    if len(terms) < 2:
        return hit / F.lit(float(max(1, len(terms)))) * 0.7
    far = F.greatest(*at) - F.least(*[F.when(a > 0, a) for a in at])
    close = F.when(hit >= 2, F.greatest(F.lit(0.0), 1 - far / F.length(sentence))).otherwise(0.0)
    return hit / F.lit(float(len(terms))) * 0.7 + close * 0.3


def _fit(s: str, most: int) -> str:
    if len(s) <= most:
        return s
    cut = s[:most]
    if (p := cut.rfind(".")) > most / 2:
        return s[: p + 1]
    if (p := cut.rfind(" ")) > most / 2:
        return s[:p] + "..."
    return cut + "..."


def snippet(text: str | None, terms: list[str], most: int = 300, least: int = 100, diversity: float = 0.7) -> str:
    """Up to three sentences, picked one by one by relevance less likeness to those picked, with terms in <mark>.

    A text without such sentences gives its first `most` characters; null and empty texts give an empty one.
    """
    if not text:
        return ""
    found = [x for s in re.sub(r"([.?!])\s*(?=[A-Z])", r"\1\n", text).split("\n") if len(x := s.strip()) > 20]
    if not found:
        return text[:most]
    scored = []
    for s in found:
        low = s.lower()
        at = sorted(p for t in terms if (p := low.find(t)) >= 0)
        close = max(0.0, 1 - (at[-1] - at[0]) / len(s)) if len(at) > 1 else 0.0
        scored.append((len(at) / max(1, len(terms)) * 0.7 + close * 0.3, s, set(low.split())))
    picked: list = []
    while scored and len(picked) < 3:
        value = [diversity * r - (1 - diversity) * max((len(w & p[2]) / len(w | p[2]) for p in picked if w | p[2]), default=0.0) for r, _, w in scored]
        picked.append(scored.pop(value.index(max(value))))
    out, parts = "", 0
    for r, s, _ in sorted(picked, key=lambda x: -x[0]):
        if any(t in s.lower() for t in terms) or not parts:
            if len(out) + len(s) <= most:
                out += (" " if out else "") + s
                parts += 1
            elif not parts:
                out, parts = _fit(s, most), 1
        if len(out) >= least:
            break
    return re.sub(rf"\b({'|'.join(map(re.escape, terms))})\b", r"<mark>\1</mark>", out, flags=re.I | re.A) if terms else out


def with_snippet(docs: DataFrame, query: str, text: str = "text") -> DataFrame:
    """Adds `snippet`; meant for a page of results. Arrow batches, as the selection is greedy."""
    terms = query_terms(query)

    @F.pandas_udf("string")
    def make(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, terms))

    return docs.withColumn("snippet", make(text))


def with_dated_snippet(docs: DataFrame, query: str, text: str = "text", at: str = "at") -> DataFrame:
    """As `with_snippet`, with the date before it, like Jan 5, 2025; a null date gives the snippet alone."""
    made = with_snippet(docs, query, text)
    return made.withColumn("snippet", F.concat(F.coalesce(F.concat(F.date_format(at, "MMM d, yyyy"), F.lit(" — ")), F.lit("")), F.coalesce("snippet", F.lit(""))))
