"""Query understanding: types, intents, entities, boolean parse, spelling, completion, multi-pattern search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparrowdex.functions.text import normalize_text
from sparrowdex.session import through_table

#: Intents by pattern, first match wins; entities by kind.
NAVIGATIONAL = ("(login|signup|sign in|sign up|register)\\b", "^(facebook|twitter|youtube|instagram|linkedin|github|amazon)\\b", "[.](com|org|net|io)\\b", "^(open|go\\s+to|visit|launch)\\b")
TRANSACTIONAL = (
    "\\b(buy|purchase|order|shop|price|cost|discount|deal)\\b", "\\b(download|install|get|subscribe|register)\\b", "\\b(hotel|flight|booking|reservation|ticket)\\b",
    "\\b(near\\s+me|best|top|cheap|affordable)\\b", "\\b(how\\s+to|tutorial|guide|course|learn)\\b",
)
#: A second, broader set of intents.
NAVIGATIONAL_BROAD = ("^(login|signin|signup|register)\\b", "\\b(website|official|site|homepage|home page)\\b", "[.](com|org|net|io|gov)\\b", "\\b(facebook|twitter|youtube|instagram|linkedin|github)\\b")
TRANSACTIONAL_BROAD = (
    "\\b(buy|purchase|order|shop|price|cost|discount|deal)\\b", "\\b(download|install|get|subscribe)\\b", "\\b(hotel|flight|booking|reservation|ticket)\\b",
    "\\b(how\\s+to|tutorial|guide|course|learn)\\b", "\\b(near\\s+me|best|top|cheap|affordable)\\b",
)
#: What an intent found by rules is held for; the others share the rest.
CONFIDENCE = 0.85
ENTITIES = {
    "product": "iphone|macbook|airpods|ipad|samsung|nike|adidas",
    "location": "new york|los angeles|london|paris|tokyo|berlin|sydney",
    "person": "elon musk|bill gates|steve jobs|albert einstein",
    "organization": "google|microsoft|apple|amazon|facebook|tesla",
}
#: Frequent misspellings, and pairs of words that go together.
MISSPELLINGS = dict(
    p.split()
    for p in (
        "recieve receive,seperate separate,occured occurred,occurence occurrence,acheive achieve,acheivement achievement,beleive believe,beleif belief,calender calendar,"
        "cemetary cemetery,definately definitely,existance existence,freind friend,goverment government,harrass harass,independant independent,liason liaison,"
        "millenium millennium,neccessary necessary,occassion occasion,paralel parallel,priviledge privilege,publically publicly,recamend recommend,thier their,"
        "tommorow tomorrow,untill until,wierd weird"
    ).split(",")
)
PAIRS = "search engine,web crawler,machine learning,artificial intelligence,data structure,computer science,information retrieval,natural language,deep learning,neural network,big data,cloud computing,social media,user experience,real time".split(",")


def query_type(q: Column | str) -> Column:
    """boolean, phrase, fuzzy or natural; operators are upper-case words. Null is natural."""
    c = F.coalesce(F.col(q) if isinstance(q, str) else q, F.lit(""))
    return F.when(c.rlike(r"\b(AND|OR|NOT)\b"), "boolean").when(c.rlike('"[^"]*"'), "phrase").when(c.rlike("~[0-9]+"), "fuzzy").otherwise("natural")


def intent(q: Column | str, navigational: tuple = NAVIGATIONAL, transactional: tuple = TRANSACTIONAL) -> Column:
    """navigational, transactional or informational, by the first pattern that matches. Null is informational."""
    c = F.lower(F.coalesce(F.col(q) if isinstance(q, str) else q, F.lit("")))
    any_of = lambda ps: reduce(lambda a, b: a | b, [c.rlike(p) for p in ps])
    return F.when(any_of(navigational), "navigational").when(any_of(transactional), "transactional").otherwise("informational")


def intent_scores(q: Column | str) -> Column:
    """Map of each intent to its score: CONFIDENCE for the one found, half of the rest for the others."""
    found = intent(q)
    return F.create_map(*[x for i in ("navigational", "informational", "transactional") for x in (F.lit(i), F.when(found == i, CONFIDENCE).otherwise((1 - CONFIDENCE) / 2))])


def entities(q: Column | str) -> Column:
    """Array of (kind, names) for kinds of which the text names one, in lower case. Null has none."""
    c = F.lower(F.coalesce(F.col(q) if isinstance(q, str) else q, F.lit("")))
    found = [F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(c, F.lit(f"\\b({p})\\b"), F.lit(1)).alias("names")) for k, p in ENTITIES.items()]
    return F.filter(F.array(*found), lambda e: F.size(e["names"]) > 0)


def parse_boolean(query: str) -> list[tuple[str, str]]:
    """(operator, word) from left to right; the operator before a word, AND by default; words in normal form."""
    out, op = [], "AND"
    for w in query.split():
        if w in ("AND", "OR", "NOT"):
            op = w
        elif n := normalize_text(w):
            out.append((op, n))
            op = "AND"
    return out


def parse_phrase(query: str) -> tuple[list[str], list[str]]:
    """Words of the first quoted phrase (else of all), and the other words in normal form."""
    m = re.search(r'"([^"]+)"', query)
    rest = (query[: m.start()] + query[m.end() :]).strip() if m else ""
    return (m[1] if m else query).split(), normalize_text(rest).split()


def parse_fuzzy(query: str) -> list[tuple[str, int]]:
    """(word, distance) of each word~n, n at most 5."""
    return [(m[1].lower(), min(int(m[2]), 5)) for w in query.split() if (m := re.fullmatch(r"(\w+)~(\d+)", w))]


def soundex(word: Column | str) -> Column:
    """Letter and three digits; vowels don't part equal codes. Empty words have an empty code, null stays null."""
    up = F.upper(word)
    codes = F.translate(F.regexp_replace(up, "[^A-Z]", "0"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01230120022455012623010202")
    rest = F.regexp_replace(F.regexp_replace(F.substring(codes, 2, 1 << 20), "0", ""), "([1-6])\\1+", "$1")
    lead = F.substring(codes, 1, 1)
    tail = F.when(F.substring(rest, 1, 1) == lead, F.substring(rest, 2, 1 << 20)).otherwise(rest)
    return F.when(F.length(word) > 0, F.rpad(F.concat(F.substring(up, 1, 1), tail), 4, "0")).otherwise(F.col(word) if isinstance(word, str) else word)


def char_bigrams(word: Column | str) -> Column:
    """Distinct pairs of letters of the word between ^ and $."""
    p = F.concat(F.lit("^"), F.col(word) if isinstance(word, str) else word, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 1), lambda i: F.substring(p, i, F.lit(2))))


def jaccard(a: Column, b: Column) -> Column:
    """Common over all elements of two sets; 0 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u > 0, F.size(F.array_intersect(a, b)) / u).otherwise(0.0)


def spelling_candidates(words: DataFrame, dictionary: DataFrame, most: int = 2, keep: int = 20) -> DataFrame:
    """(w, candidate, freq, distance, phonetic) for words that aren't in the dictionary: the first `keep` candidates of each.

    Candidates are, in this order, dictionary words at the least distance of a word, `most` (1 or 2) at most; fixed misspellings; and words
    with the same phonetic code; each by frequency, then by alphabet. Words within distance d share one of their forms with
    at most d letters left out, so the join is on such forms, never of all with all; forms with two letters less are made only for
    words without one at distance 1. Of a phonetic code only the first `keep` words can be among a word's candidates, so
    only these are joined. Null words have none.
    """
    new = through_table(words.select("w").where("length(w) > 0").distinct().join(dictionary.select(F.col("word").alias("w")), "w", "left_anti"), "unknown-words")
    known = through_table(dictionary.select(F.col("word").alias("candidate"), "freq"), "dictionary")
    longest = known.agg(F.max(F.length("candidate")).alias("longest"))
    short = new.crossJoin(F.broadcast(longest)).where(F.length("w") <= F.col("longest") + most).select("w")

    def near_by(ws: DataFrame, d: int) -> DataFrame:
        a = ws.select("w", F.explode(_deletions(F.col("w"), d)).alias("form"))
        b = known.select("candidate", "freq", F.explode(_deletions(F.col("candidate"), d)).alias("form"))
        met = a.join(b, "form").select("w", "candidate", "freq", F.levenshtein("w", "candidate", d).alias("distance")).where("distance >= 0")
        return met.distinct()

    near = through_table(near_by(short, 1), "near-words")
    if most > 1:
        near = near.unionByName(near_by(short.join(near.select("w").distinct(), "w", "left_anti"), 2))
    fixed = F.create_map(*[F.lit(x) for kv in MISSPELLINGS.items() for x in kv])
    listed = new.withColumn("candidate", F.try_element_at(fixed, F.col("w"))).where("candidate IS NOT NULL")
    listed = listed.join(known, "candidate", "left").select("w", "candidate", F.coalesce("freq", F.lit(0).cast("long")).alias("freq"), F.levenshtein("w", "candidate").alias("distance"))
    order = Window.partitionBy("code").orderBy(F.desc("freq"), "candidate")
    codes = known.withColumn("code", soundex("candidate")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep)
    alike = new.withColumn("code", soundex("w")).join(codes, "code").select("w", "candidate", "freq", F.levenshtein("w", "candidate").alias("distance"))
    both = near.withColumn("tier", F.lit(0)).unionByName(listed.withColumn("tier", F.lit(1))).unionByName(alike.withColumn("tier", F.lit(2)))
    each = both.groupBy("w", "candidate").agg(F.max("freq").alias("freq"), F.min("distance").alias("distance"), F.min("tier").alias("tier"))
    first = Window.partitionBy("w").orderBy("tier", F.desc("freq"), "candidate")
    return each.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep).select("w", "candidate", "freq", "distance", (F.col("tier") == 2).alias("phonetic"))


def _deletions(word: Column, d: int) -> Column:
    """The word and its forms with up to d letters left out."""
    forms = F.array(word)
    for _ in range(d):
        shorter = F.flatten(F.transform(forms, lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))))
        forms = F.array_distinct(F.concat(forms, shorter))
    return forms


def _base_score(w: str, candidate: str) -> Column:
    s = 10 * F.ln(F.col("freq") + 1) - 5 * F.col("distance") + 3 * jaccard(char_bigrams(w), char_bigrams(candidate))
    return s + F.when(F.abs(F.length(w) - F.length(candidate)) <= 1, 2.0).otherwise(0.0) + F.when(F.substring(w, 1, 1) == F.substring(candidate, 1, 1), 3.0).otherwise(0.0)


def best_corrections(candidates: DataFrame, context: str | None = None) -> DataFrame:
    """(w, best, score): the candidate of highest score, ties in alphabetical order.

    Score: 10 ln(freq + 1) - 5 distance + 3 overlap of letter pairs + 2 for a length within one + 3 for the same first letter, and 5 for
    each word of the array column `context` with which the candidate forms one of PAIRS, in either order.
    """
    s = _base_score("w", "candidate")
    if context:
        s += context_bonus(F.col("candidate"), F.col(context))
    scored = candidates.withColumn("score", F.round(s, 6))
    best = scored.groupBy("w").agg(F.min(F.struct((-F.col("score")).alias("s"), "candidate")).alias("b"))
    return best.select("w", F.col("b.candidate").alias("best"), (-F.col("b.s")).alias("score"))


def context_bonus(word: Column, context: Column) -> Column:
    """5 for each word of an array that forms one of PAIRS with `word`, in either order; 0 for null."""
    pairs = F.array(*[F.lit(f"{a} {b}") for p in PAIRS for a, b in (p.split(), p.split()[::-1])])
    hits = F.filter(F.coalesce(context, F.array().cast("array<string>")), lambda c: F.array_contains(pairs, F.concat(word, F.lit(" "), c)))
    return 5.0 * F.size(hits)


def correct_texts(texts: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 2) -> DataFrame:
    """(key, corrected): each text with its words that aren't in the dictionary replaced by their best candidates.

    Words are split at blanks; signs before and after a word stay where they are. The `reach` words on either side are the
    context. A word without a candidate, words of less than three letters, and those with digits or other signs inside, stay. Null texts stay null, blanks become single.
    """
    words = texts.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.trim(text), "\\s+")).alias("i", "raw"))
    parts = words.withColumn("w", F.lower(F.regexp_extract("raw", "^[^\\p{L}\\p{N}]*(\\p{L}{3,})[^\\p{L}\\p{N}]*$", 1)))
    place = Window.partitionBy(key).orderBy("i")
    near = F.array(*[f("w", k).over(place) for f in (F.lag, F.lead) for k in range(1, reach + 1)])
    parts = through_table(parts.withColumn("context", F.array_compact(near)), "words-in-place")
    found = spelling_candidates(parts.select("w"), dictionary)
    asked = parts.where("w <> ''").select(key, "i", "w", "context").join(found, "w").withColumnRenamed("w", "word").withColumn("w", F.struct(key, "i", "word"))
    s = _base_score("word", "candidate") + context_bonus(F.col("candidate"), F.col("context"))
    best = asked.withColumn("s", F.round(s, 6)).groupBy(key, "i").agg(F.min(F.struct((-F.col("s")).alias("s"), "candidate")).alias("b")).select(key, "i", "b.candidate")
    done = parts.join(best, [key, "i"], "left")
    new = F.when(F.col("candidate").isNotNull(), F.concat(F.regexp_extract("raw", "^([^\\p{L}\\p{N}]*)", 1), F.col("candidate"), F.regexp_extract("raw", "([^\\p{L}\\p{N}]*)$", 1))).otherwise(F.col("raw"))
    lines = done.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", new.alias("x")))), lambda x: x["x"]), " ").alias("corrected"))
    return texts.select(key).join(lines, key, "left")


def completions(dictionary: DataFrame, prefix: str, k: int = 10) -> DataFrame:
    """(word, freq) of the k most frequent words that begin with the prefix, ties in alphabetical order; exact."""
    return dictionary.where(F.startswith("word", F.lit(prefix.lower()))).orderBy(F.desc("freq"), "word").limit(k).select("word", "freq")


def next_letters(dictionary: DataFrame) -> DataFrame:
    """(pair, letter, n): after each pair of letters of the dictionary's words, how often which letter follows, by the words' frequency."""
    at = F.explode(F.sequence(F.lit(1), F.length("word") - 2)).alias("i")
    each = dictionary.where("length(word) > 2").select("word", "freq", at)
    return each.groupBy(F.substring("word", F.col("i"), F.lit(2)).alias("pair"), F.substring("word", F.col("i") + 2, F.lit(1)).alias("letter")).agg(F.sum("freq").alias("n"))


def without_words(dictionary: DataFrame, words: DataFrame) -> DataFrame:
    """The dictionary without the words (word) to be deleted; null ones delete nothing."""
    return dictionary.join(words.select(F.lower("word").alias("word")).where("word IS NOT NULL"), "word", "left_anti")


def suggestions(dictionary: DataFrame, query: str, k: int = 5) -> DataFrame:
    """(suggestion, freq): the query with its last word completed."""
    head, _, last = query.lower().rpartition(" ")
    return completions(dictionary, last, k).select(F.concat(F.lit(head + " " if head else ""), "word").alias("suggestion"), "freq")


def pattern_hits(docs: DataFrame, patterns: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pattern, first): where each of a few fixed patterns first stands in a text, from 0. Null texts have none."""
    hits = F.array(*[F.struct(F.lit(p).alias("pattern"), (F.instr(F.lower(text), p) - 1).alias("first")) for p in patterns])
    return docs.where(F.col(text).isNotNull()).select(key, F.explode(hits).alias("h")).select(key, "h.pattern", "h.first").where("first >= 0")
