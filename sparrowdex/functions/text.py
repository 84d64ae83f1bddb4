"""Text kernel: normal form, tokens, stems, shingles, readability, phonetic codes, language."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowdex.functions.dialect import DUCK, Dialect, Step, sql_steps

#: Stop words of the index.
STOP_WORDS = tuple(
    dict.fromkeys(
        """
    a an and are as at be by for from has he in is it its of on that the to was were will with this but they his her she which or we their
    been have had would could should may might shall can does did doing do about into over after before between under above below out off
    up down than then also very just because these those each every all any both few more most other some such no nor not only own same so
    too what when where who whom why how i me my myself you your yours yourself him himself herself itself us our ours ourselves them theirs
    themselves
    """.split()
    )
)
#: Words by which a language is told.
LANGUAGE_WORDS = {
    "en": "the and for are but not you all any can".split(),
    "de": "der die das und ist nicht sich auch".split(),
    "fr": "le la les et est sont dans pour".split(),
    "es": "el la los las y es son para por".split(),
}
#: Suffix rules of the stemmer's second, third and fourth stage, in order.
STAGE_2 = (
    "ization ize, fulness ful, ousness ous, iveness ive, ational ate, biliti ble, tional tion, lessli less, ousli ous, entli ent, ation ate, alism al, "
    "aliti al, iviti ive, fulli ful, enci ence, anci ance, abli able, izer ize, ator ate, alli al, bli ble, ogi og, li "
)
STAGE_3 = "icate ic, ative , alize al, iciti ic, ical ic, ness , ful "
STAGE_4 = "ement , ment , ance , ence , able , ible , ant , ent , ion , ism , ate , iti , ous , ive , ize "


def _accents() -> tuple[str, str]:
    """Single letters whose decomposition is one ASCII letter and marks, and those letters."""
    found = {}
    for c in map(chr, range(0xC0, 0x1F00)):
        d = [x for x in unicodedata.normalize("NFKD", c.lower()) if not "̀" <= x <= "ͯ"]
        if c == c.lower() and len(d) == 1 and d[0] < "\x80" and d[0].isalnum():
            found[c] = d[0]
    return "".join(found), "".join(found.values())


def normalized(text: Column | str) -> Column:
    """Lower case, accents off, all but ASCII word characters, apostrophes and hyphens to a blank, single blanks, trimmed.

    Null stays null; a text without such characters becomes empty.
    """
    bare = F.translate(F.regexp_replace(F.lower(text), "[\\x{300}-\\x{36f}]", ""), *_accents())
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "[^a-z0-9_\\s'-]", " "), "\\s+", " "))


def normalized_sql(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower({text})), '[^a-z0-9_\\s''-]', ' ', 'g'), '\\s+', ' ', 'g'))"


def raw_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, w): every token of the normal form with its place; null and empty texts have none."""
    n = docs.select(key, normalized(text).alias("n")).where("n <> ''")
    return n.select(key, F.posexplode(F.split("n", " ")).alias("pos", "w"))


def raw_tokens_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return (
        f"SELECT {key}, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS w FROM (SELECT {key}, string_split(n, ' ') AS ws FROM "
        f"(SELECT {key}, {normalized_sql(text)} AS n FROM {table}) WHERE n <> '')"
    )


def kept(token: str = "w") -> str:
    """Predicate (both engines): two characters or more and no stop word."""
    return f"length({token}) >= 2 AND {token} NOT IN ({', '.join(repr(w) for w in STOP_WORDS)})"


def _rules(text: str) -> list[tuple[str, str]]:
    return [tuple(r.strip(",").split(" ")[:2]) if " " in r.strip(",") else (r.strip(","), "") for r in text.split(", ")]


def stem_steps(d: Dialect, word: str = "w") -> list[Step]:
    """The stemmer as a chain of CASE rules: suffixes in stages, measured by vowel-consonant runs.

    A word of at most two characters is its own stem.
    """

    def measure(x: str) -> str:
        v = d.replace_all(d.replace_all(x, "[aeiouy]+", "v"), "[^v]+", "c")
        return f"(length({v}) - length(replace({v}, 'vc', ''))) / 2"

    def cut(x: str, n: int | str) -> str:
        return f"substr({x}, 1, length({x}) - {n})"

    def closed(x: str) -> str:
        return d.matches(x, "[^aeiouy][aeiouy][^aeiouywx]$")

    def stage(x: str, rules: str, bound: str, region: str) -> str:
        whens = " ".join(f"WHEN {x} LIKE '%{a}' AND contains({region}, '{a}') THEN concat({cut(x, len(a))}, '{b}')" for a, b in _rules(rules))
        return f"CASE WHEN NOT ({bound}) THEN {x} {whens} ELSE {x} END"

    r1 = lambda x: d.extract(x, "[aeiouy][^aeiouy](.+)")
    ends = lambda x, p: d.extract(x, f"({p})$")
    twice = "right(b2, 1) = substr(b2, length(b2) - 1, 1) AND length(b2) > 1 AND " + d.matches("b2", "[^aeiouylsz]$")
    return [
        ("a1", f"CASE WHEN {word} LIKE '%sses' OR {word} LIKE '%ies' THEN {cut(word, 2)} WHEN {word} LIKE '%ss' THEN {word} WHEN {word} LIKE '%s' THEN {cut(word, 1)} ELSE {word} END"),
        ("e1", ends("a1", "eed|eedly")),
        ("e2", ends("a1", "ed|edly|ing|ingly")),
        ("b1", f"substr(a1, 1, length(a1) - length(CASE WHEN e1 <> '' THEN e1 ELSE e2 END))"),
        ("take", f"e1 = '' AND e2 <> '' AND {measure('b1')} > 0"),
        ("b2", f"CASE WHEN e1 <> '' AND {r1('b1')} <> '' THEN concat(b1, 'ee') WHEN take THEN b1 ELSE a1 END"),
        ("b3", f"CASE WHEN NOT take THEN b2 WHEN b2 LIKE '%at' OR b2 LIKE '%bl' OR b2 LIKE '%iz' THEN concat(b2, 'e') WHEN {twice} THEN {cut('b2', 1)} WHEN {measure('b2')} = 1 AND {closed('b2')} THEN concat(b2, 'e') ELSE b2 END"),
        ("c1", f"CASE WHEN {d.matches('b3', '[^aeiouy]y$')} THEN concat({cut('b3', 1)}, 'i') ELSE b3 END"),
        ("m", measure("c1")),
        ("r2", r1("c1")),
        ("c2", stage("c1", STAGE_2, "m > 0", "r2")),
        ("r3", r1("c2")),
        ("c3", stage("c2", STAGE_3, "m > 0", "r3")),
        ("r4", r1("c3")),
        ("c4", stage("c3", STAGE_4, "m > 1", "r4")),
        ("m5", measure("c4")),
        ("c5", f"CASE WHEN c4 LIKE '%e' AND (m5 > 1 OR m5 = 1 AND NOT {closed('c4')}) THEN {cut('c4', 1)} ELSE c4 END"),
        ("stem", f"CASE WHEN length({word}) <= 2 THEN {word} WHEN {measure('c5')} > 1 AND c5 LIKE '%ll' THEN {cut('c5', 1)} ELSE c5 END"),
    ]


def with_stem(tokens: DataFrame, word: str = "w") -> DataFrame:
    """Adds `stem` to rows with a lower-case word. Null stays null.

    Arrow batches through a memo of words: the chain of two dozen suffix rules (`stem_steps`, which the cross-check
    runs) as Column expressions is far slower per row, and stemming the distinct words apart would shuffle every token.
    """

    @F.pandas_udf("string")
    def stem(words: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(words)
        new = [w for w in distinct if w not in MEMO]
        if len(MEMO) > 1 << 20:
            MEMO.clear()
            new = list(distinct)
        MEMO.update(zip(new, stem_words(new)))
        stems = pd.Series([*(MEMO[w] for w in distinct), None], dtype=object)
        return stems.take(codes).reset_index(drop=True)

    return tokens.withColumn("stem", stem(word))


MEMO: dict[str, str] = {}


def terms(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, term): stems of the tokens that are kept, places counted over all tokens."""
    return with_stem(raw_tokens(docs, key, text).where(kept())).select(key, "pos", F.col("stem").alias("term"))


def terms_sql(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """The same for the cross-check; there each distinct word is stemmed once."""
    t = f"SELECT * FROM ({raw_tokens_sql(table, key, text)}) WHERE {kept()}"
    stems = sql_steps(f"SELECT DISTINCT w FROM ({t})", stem_steps(DUCK))
    return f"SELECT {key}, pos, stem AS term FROM ({t}) JOIN (SELECT w, stem FROM ({stems})) USING (w)"


def stem_words(words: list[str]) -> list[str]:
    """Stems of a few words (a query) on the driver, by the same rules; kept words only."""
    import re

    def m(x: str) -> int:
        return re.sub("[^v]+", "c", re.sub("[aeiouy]+", "v", x)).count("vc")

    def r1(x: str) -> str:
        f = re.search("[aeiouy][^aeiouy](.+)", x)
        return f[1] if f else ""

    def closed(x: str) -> bool:
        return bool(re.search("[^aeiouy][aeiouy][^aeiouywx]$", x))

    def stage(x: str, rules: str) -> str:
        region = r1(x)
        return next((x[: -len(a)] + b for a, b in _rules(rules) if x.endswith(a) and a in region), x)

    out = []
    for w in words:
        if len(w) > 2:
            if w.endswith(("sses", "ies")):
                w = w[:-2]
            elif w.endswith("s") and not w.endswith("ss"):
                w = w[:-1]
            if e := re.search("(eed|eedly)$", w):
                b = w[: e.start()]
                w = b + "ee" if r1(b) else w
            elif (e := re.search("(ed|edly|ing|ingly)$", w)) and m(w[: e.start()]) > 0:
                w = w[: e.start()]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeiouylsz])\1$", w):
                    w = w[:-1]
                elif m(w) == 1 and closed(w):
                    w += "e"
            w = re.sub("([^aeiouy])y$", r"\1i", w)
            k = m(w)
            for rules, least in ((STAGE_2, 0), (STAGE_3, 0), (STAGE_4, 1)):
                w = stage(w, rules) if k > least else w
            if w.endswith("e") and (m(w) > 1 or m(w) == 1 and not closed(w)):
                w = w[:-1]
            if m(w) > 1 and w.endswith("ll"):
                w = w[:-1]
        out.append(w)
    return out


def normalize_text(text: str) -> str:
    """The normal form of a query on the driver."""
    import re

    bare = "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not "̀" <= c <= "ͯ")
    return " ".join(re.sub(r"[^a-zA-Z0-9_\s'-]", " ", bare).split())


def query_stems(query: str) -> list[str]:
    """Stems of a query's kept words, in order, repetitions included."""
    return stem_words([w for w in normalize_text(query).split() if len(w) >= 2 and w not in STOP_WORDS])


def ngrams(tokens: Column, n: int, sep: str) -> Column:
    """Runs of n successive elements joined by `sep`; empty if there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), sep))).otherwise(F.array().cast("array<string>"))


def shingle_rows(words: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """(key, shingle): each run of n successive elements of the arrays `ws`, joined by a blank; arrays are cut once, not for each run."""
    cut = F.arrays_zip(*[F.slice("ws", i + 1, F.greatest(F.lit(0), F.size("ws") - (n - 1))).alias(f"w{i}") for i in range(n)])
    return words.select(key, F.explode(cut).alias("z")).select(key, F.concat_ws(" ", *[F.col("z")[f"w{i}"] for i in range(n)]).alias("shingle"))


def simple_words(text: Column | str) -> Column:
    """Lower-cased ASCII words, other characters as blanks; the form near-duplicate fingerprints are made of."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9_\\s]", " "), "\\s+"), lambda w: w != "")


def simple_words_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


def readability_steps(d: Dialect, text: str, empty: float) -> list[Step]:
    """Flesch reading ease over 100, from 0 to 1; `empty` for a text without words. Null texts count as empty.

    Syllables of a word are its vowel runs, less one for a final e if there are two or more, at least one. They are
    counted on the text as a whole: vowel runs in all, words without one, words that end in a silent e.
    """
    padded = f"concat(' ', {d.replace_all(f'lower(coalesce({text}, {d.quote("")}))', '[ \t\r\n\x0b\x0c]+', '  ')}, ' ')"
    sentences = d.count(f"coalesce({text}, '')", "[^.!?]*[^.!? \t\r\n\x0b\x0c][^.!?]*")
    return [
        ("pad", padded),
        ("n_words", d.double(d.count("pad", "[^ ]+"))),
        ("n_sentences", d.double(sentences)),
        ("runs", d.double(d.count("pad", "[aeiou]+"))),
        ("bare", d.double(d.count("pad", " [^ aeiou]+ "))),
        ("silent", d.double(d.count("pad", "[aeiou][^ aeiou]+[aeiou]*e "))),
        ("readability", d.numbers(f"CASE WHEN n_words = 0 THEN {empty}# ELSE greatest(0.0#, least(1.0#, (206.835# - 1.015# * n_words / greatest(1.0#, n_sentences) - 84.6# * (runs - silent + bare) / n_words) / 100)) END")),
    ]
