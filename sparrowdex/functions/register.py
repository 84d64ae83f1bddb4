"""Named SQL functions and a table function of the library."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparrowdex.functions.text import STOP_WORDS, _accents, stem_words
from sparrowdex.operators.dedup import simhash


PLAIN, MARKS, OTHER = str.maketrans(*_accents()), re.compile("[\u0300-\u036f]"), re.compile(r"[^a-z0-9_\s'-]", re.A)


class Tokens:
    """(pos, token, term) of a text's kept words; null and empty texts have none."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str, str]]:
        bare = MARKS.sub("", (text or "").lower()).translate(PLAIN)
        for i, w in enumerate(OTHER.sub(" ", bare).split()):
            if len(w) >= 2 and w not in STOP_WORDS:
                yield i, w, stem_words([w])[0]


def register(spark: SparkSession) -> None:
    """Make stem (of a lower-case word), simhash64 (of a text, null below three words) and phonetic (of a word) known as SQL functions,
    and text_tokens as a table function. Null gives null, for text_tokens no rows."""

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        distinct = [w for w in words.unique() if w is not None]
        return words.map(dict(zip(distinct, stem_words(distinct))))

    @F.pandas_udf("long")
    def simhash64(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(t) for t in texts], dtype="Int64")

    spark.udf.register("stem", stem)
    spark.udf.register("simhash64", simhash64)
    spark.udtf.register("text_tokens", F.udtf(Tokens, returnType="pos int, token string, term string"))
    codes = "translate(regexp_replace(upper(word), '[^A-Z]', '0'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '01230120022455012623010202')"
    squeezed = f"regexp_replace(replace(substr({codes}, 2), '0', ''), '([1-6])\\\\1+', '$1')"
    tail = f"CASE WHEN substr({squeezed}, 1, 1) = substr({codes}, 1, 1) THEN substr({squeezed}, 2) ELSE {squeezed} END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION phonetic(word STRING) RETURNS STRING RETURN CASE WHEN length(word) > 0 THEN rpad(concat(substr(upper(word), 1, 1), {tail}), 4, '0') ELSE word END")
