"""Sentence units of texts in many languages and scripts: a linear-chain tagger with Viterbi decoding."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowdex.functions.text import _accents
from sparrowdex.session import through_table

LINE = re.compile(r"[^\n\r\x0b\x0c\x85  ]+")
#: Runs of signs that may end a sentence, and blanks beside Thai letters.
SIGNS = re.compile(r"[.!?…。！？｡．।॥؟۔]+|(?<=[฀-๿])\s+(?=\S)|(?<=\S)\s+(?=[฀-๿])")
WIDE = frozenset("。！？｡．")
#: Marks that open and close quotations and brackets.
PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "(": ")", "[": "]", "「": "」", "『": "』", "（": "）", "《": "》", "【": "】", "‘": "’"}
CLOSERS = frozenset("”“»›)]」』）》】\"")
BRACKETS = frozenset("([（【")
OPENERS = frozenset("“„«‹([「『（《【‘\"'¿¡-–—*•")


class Lexicon(NamedTuple):
    """What is learnt of words from the corpus: abbreviations by kind (never, maybe), and words that go on after an ordinal."""

    kinds: dict[str, str]
    ordinals: frozenset[str]


NOTHING = Lexicon({}, frozenset())
FIRST_WORD = re.compile("[^\\W\\d_]?[^\\W\\d_\u0300-\u036f]*(?:[\u0300-\u036f]|[^\\W\\d_])*")
#: Names of months in languages that write ordinals with a full stop; the corpus adds to them.
MONTHS = frozenset("januar janner februar marz april mai juni juli august september oktober november dezember".split())
QUOTES = re.compile("[" + re.escape("".join({'"', *PAIRS, *PAIRS.values()})) + "]")
#: The word under which the lexicon has runs of dots.
DOTS = "…"
#: Letters of scripts that are written without blanks, in lines of which without any sign each letter may end a sentence.
UNSPACED = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\u0e00-\u0e7f\u1780-\u17ff\u1000-\u109f\u0e80-\u0eff]")


ACCENTS = _accents()
PLAIN, MARKS = str.maketrans(*ACCENTS), re.compile("[\u0300-\u036f]")


def plain(word: str) -> str:
    """A word as the lexicon has it: lower case, without accents on Latin letters, composed or not."""
    return MARKS.sub("", word.lower()).translate(PLAIN)


def _latin(c: str) -> bool:
    return c.isdigit() or ("a" <= c.lower() <= "z") or "À" <= c <= "ɏ"


def _thai(c: str) -> bool:
    return "฀" <= c <= "๿"


def _pairs(line: str) -> list[tuple[int, int]]:
    """Places of quotations and brackets that are both opened and closed in the line, outermost ones and inner ones."""
    out, stack, straight = [], [], None
    for m in QUOTES.finditer(line):
        i, c = m.start(), m[0]
        if c == '"':
            if straight is None:
                straight = i
            else:
                out.append((straight, i))
                straight = None
            continue
        for k in range(len(stack) - 1, -1, -1):
            if PAIRS[line[stack[k]]] == c and c != "’":
                out.append((stack[k], i))
                del stack[k:]
                break
        else:
            if c in PAIRS and c != "‘":
                stack.append(i)
    return sorted(out)


def _alone(line: str, x: int, y: int) -> bool:
    """Whether a quotation or bracket stands for itself: what it holds are sentences and not part of a larger one."""
    before, after = line[:x].rstrip(), line[y + 1 :].lstrip()
    if before and not (SIGNS.fullmatch(before[-1]) or before[-1] in CLOSERS) or not SIGNS.fullmatch(line[y - 1 : y].strip() or line[y - 2 : y - 1]):
        return False
    return not after or after.lstrip("“„«‹([¿¡\"‘")[:1].isupper()


def candidates(line: str, lexicon: Lexicon = NOTHING) -> list[tuple[int, int, list[str], int | None]]:
    """(end of the unit, begin of the next, features, opener) of each character of a line that may end a sentence.

    All other characters are inside. `opener` is the place of the quotation or bracket that closes there, if any. In a line
    of an unspaced script that has no sign, each letter may end one.
    """
    out = []
    signs = list(SIGNS.finditer(line))
    if not signs:
        return _bare_candidates(line)
    pairs = _pairs(line)
    n = len(line)
    for m in signs:
        a, b = m.span()
        if m[0].isspace():
            p, q = line[a - 1], line[b]
            if any(x < a and y >= b for x, y in pairs):
                f = ["thai", "nested"]
            else:
                f = ["thai latin"] if _latin(p) or _latin(q) else ["thai"]
            out.append((a, b, f, None))
            continue
        end, opener = b, None
        while end < n:  # closing marks belong to the sentence they close, a blank before them too
            c = end + 1 if line[end].isspace() and end + 1 < n and line[end + 1] in "»›" else end
            o = next((x for x, y in pairs if y == c and x < a), None)
            if o is None:
                break
            end, opener = c + 1, o
        rest = end
        while rest < n and line[rest].isspace():
            rest += 1
        f = ["bias"]
        if rest == n:
            out.append((end, rest, ["line end"], opener))
            continue
        if any(x < a and y >= end and not _alone(line, x, y) for x, y in pairs):
            f.append("nested")
        k = rest
        while k < n and (line[k] in OPENERS or line[k].isspace() or not line[k].isalnum() and ord(line[k]) > 0x2190):
            k += 1
        nxt = line[k] if k < n else ""
        sign = m[0]
        if line[rest] in ",;:)]}–—-،؛、，；：" or sign[0] in ".…" and not nxt:
            f.append("comma")
        glued = rest == end
        wide = sign[0] in WIDE or sign[-1] in WIDE
        dots = "…" in sign or ".." in sign
        cased = nxt.lower() != nxt.upper()
        if wide:
            f.append("wide")
        elif sign.strip(".…"):
            f.append("strong")
        if dots:
            f.append("dots")
            if lexicon.kinds.get(DOTS) == "never":
                f.append("never")
        if not wide and glued and not dots and opener is None and "।" not in sign:
            f.append("glued")
            word = line[line.rfind(" ", 0, a) + 1 : a]
            if nxt.isupper() and k + 1 < n and line[k + 1].islower() and len(word) > 2 and word[-1:].islower() and "." not in word and "/" not in word and "@" not in word:
                f.append("glued upper")
        if nxt.isdigit():
            f.append("digit")
        elif cased:
            f.append("upper" if nxt.isupper() or nxt.istitle() else "lower")
        else:
            f.append("caseless")
        if sign == "." and opener is None:
            s = a
            while s > 0 and not line[s - 1].isspace():
                s -= 1
            word = line[s:a].lstrip("“„«‹([「『（《【‘\"'¿¡").lower()
            known = lexicon.kinds.get(plain(word))
            bare = word.replace(".", "")
            if not line[:s].strip() and (word.isdigit() and len(word) <= 3 or len(word) == 1 and word.isalpha()) and not glued:
                f.append("marker")
            if known:
                f.append(known)
            elif "lower" in f and not glued and len(word) > 2 and word.isalpha():
                f.append("lower plain")
            elif len(bare) == 1 and bare.isalpha() or len(word) > 2 and all(len(x) == 1 for x in word.split(".")) and bare.isalpha():
                f.append("initial")
            if word.isdigit() and len(word) <= 2:
                f.append("ordinal" if plain(FIRST_WORD.match(line, k)[0]) in lexicon.ordinals else "number")
        if opener is not None and line[end - 1] in "」』" and line[rest] in "とっ":
            f.append("quotative")
        out.append((end, rest, f, opener))
    return out


def _bare_candidates(line: str) -> list[tuple[int, int, list[str], int | None]]:
    """Candidates of a line without signs: between any two letters of a script without blanks, by the letters beside them."""
    if not UNSPACED.search(line):
        return []
    n, out = len(line), []
    for i in range(1, n):
        if UNSPACED.match(line[i - 1]) and UNSPACED.match(line[i]):
            out.append((i, i, ["bare", f"<{line[max(0, i - 2) : i]}", f"<{line[i - 1]}", f">{line[i : i + 2]}", f">{line[i]}", f"={line[i - 1 : i + 1]}"], None))
    return out


def _chain(line: str, c: tuple, before: tuple | None, tag: bool) -> list[str]:
    """Features of a boundary at candidate c that depend on the tag of the candidate before."""
    end, _, f, opener = c
    out = []
    if opener is not None and "line end" not in f:
        begins = not line[:opener].strip() if before is None else tag and before[1] == opener
        if line[opener] in BRACKETS:
            out.append("bracket first" if begins else "bracket later")
        elif begins:
            out.append("quote first")
            if "strong" in f or "wide" in f and line[end - 2 : end - 1] in "？！":
                out.append("quote asks")
            if "upper" in f:
                out.append("quote first upper")
    if before is not None and tag and end - before[1] < 4:
        out.append("bare close" if f[0] == "bare" else "close")
    return out


def _viterbi(line: str, cs: list, weights: dict[str, float], known: list[bool | None] | None = None, gain: float = -1e18) -> list[bool]:
    """Tags of a line's candidates (True: boundary) with the largest sum of weights, by Viterbi's algorithm; with `known`, the
    best of those that agree with the tags that are known, or, with a `gain` for each tag that doesn't, of all.

    The chain matters twice: a quotation or bracket that begins its sentence, which depends on the tag before, is judged
    by other weights than a later one, and boundaries next to each other are told apart.
    """
    if not cs:
        return []
    get = weights.get
    best, back = (0.0, 0.0), []
    for i, c in enumerate(cs):
        base = sum([get(f, 0.0) for f in c[2]])
        before = cs[i - 1] if i else None
        if before is None:
            now = (0.0, base + sum([get(f, 0.0) for f in _chain(line, c, None, False)]))
            back.append((False, False))
        else:
            inside, bound = best
            a = inside + base + sum([get(f, 0.0) for f in _chain(line, c, before, False)])
            b = bound + base + sum([get(f, 0.0) for f in _chain(line, c, before, True)])
            now = (max(inside, bound), max(a, b))
            back.append((bound > inside, b > a))
        if known is not None and known[i] is not None:
            now = (now[0] + gain, now[1]) if known[i] else (now[0], now[1] + gain)
        best = now
    tag = best[1] > best[0]
    tags = [tag]
    for i in range(len(cs) - 1, 0, -1):
        tag = back[i][1] if tag else back[i][0]
        tags.append(tag)
    return tags[::-1]


def units(text: str | None, weights: dict[str, float], lexicon: Lexicon = NOTHING) -> list[tuple[int, int]]:
    """(start, end) of each sentence unit; none for null, empty and blank texts."""
    out = []
    for m in LINE.finditer(text or ""):
        line, at = m[0], m.start()
        cs = candidates(line, lexicon)
        start = 0
        for c, tag in zip(cs, _viterbi(line, cs, weights)):
            if tag:
                _add(out, line, at, start, c[0])
                start = c[0]
        _add(out, line, at, start, len(line))
    return out


def _add(out: list, line: str, at: int, a: int, b: int) -> None:
    while a < b and line[a].isspace():
        a += 1
    while b > a and line[b - 1].isspace():
        b -= 1
    if a < b:
        out.append((at + a, at + b))


def silver(text: str, lexicon: Lexicon = NOTHING) -> Iterator[tuple[str, list, list[bool | None]]]:
    """Training lines (line, candidates, tags) made of a text; tags that aren't known are None.

    Neighbouring lines that end with a sign are joined: a joint is a boundary, as the line end was one. Thai lines, which have
    no signs, are stripped of punctuation and joined likewise. Inside for certain are places before a comma or the like, in a
    number or name (glued), in a quotation inside a larger sentence, after a list's marker, a word that the corpus shows to be
    an abbreviation or before one that goes on after an ordinal, and a closed quotation, dots or an abbreviation before a small
    letter. Each such line is given once more without letter case, for scripts that have none. Lines of unspaced scripts give a second training line, stripped of punctuation, in which only their certain ends are
    boundaries; those without a sign have none.
    """
    lines = []
    for m in LINE.finditer(text):
        line = m[0].strip()
        if sum(map(_thai, line)) > len(line) / 2:
            line = re.sub(r"[^\w\s\u0e00-\u0e7f]", "", line)
            lines.append((line, len(line) > 20))
        else:
            last = line.rstrip("”“»›)]」』）》】\"")
            lines.append((line, bool(last) and bool(SIGNS.fullmatch(last[-1]))))
        if any(c in WIDE for c in line) or not SIGNS.search(line):
            yield from _stripped(line)
    for (a, ends), (b, also) in zip(lines, lines[1:]):
        if ends and also and (a[-1] not in CLOSERS or b[0].isupper()):  # a closed quotation may go on in a wrapped line
            line = f"{a} {b}"
            cs = candidates(line, lexicon)
            known = [_known(c, len(a) + 1) for c in cs]
            yield line, cs, known
            if any(CASES & set(c[2]) for c in cs):
                yield line, [(e, x, [f for f in fs if f not in CASES] + ["caseless"] * bool(CASES & set(fs)), o) for e, x, fs, o in cs], known


#: Features of the letter case of what follows.
CASES = frozenset(("lower", "lower plain", "upper"))


def _known(c: tuple, joint: int) -> bool | None:
    f = set(c[2])
    if c[1] == joint or "line end" in f:
        return True
    if f & {"comma", "nested", "thai latin", "quotative", "never", "ordinal", "marker"} or "glued" in f and "glued upper" not in f:
        return False
    return False if "lower" in f and (c[3] is not None or f & {"dots", "maybe"}) else None


def _stripped(line: str) -> Iterator[tuple[str, list, list[bool | None]]]:
    """The line without punctuation, with its sentences' ends as tags; nothing if it has a quotation, whose ends aren't certain."""
    if not UNSPACED.search(line) or any(c in PAIRS or c in CLOSERS for c in line):
        return
    parts = [re.sub(r"[^\w\s]", "", p) for p in re.split("[。！？｡．]+", line)]
    bare = "".join(parts)
    ends, at = set(), 0
    for p in parts:
        at += len(p)
        ends.add(at)
    cs = _bare_candidates(bare)
    if cs:
        yield bare, cs, [c[0] in ends for c in cs]


#: Where training begins, and what holds for a corpus without any line to learn from: a sign ends a sentence unless it is glued to
#: what follows, in a quotation, or before a comma or small letter.
START = {"bias": 1.0, "line end": 1.0, "glued": -2.0, "nested": -2.0, "comma": -2.0, "lower": -2.0, "thai": 1.0, "thai latin": -1.0, "bare": -2.0}
#: By how much known tags are to win over others.
MARGIN = 2.0


def train(texts: list[str], lexicon: Lexicon = NOTHING, rounds: int = 8) -> dict[str, float]:
    """Weights by an averaged structured perceptron over silver lines, from START.

    Unknown tags are taken as the present weights have them (the best tags that agree with the known ones); the weights move
    where other tags come within MARGIN of these.
    """
    w, sums, n = defaultdict(float, START), defaultdict(float), 1
    data = [x for t in texts if t for x in silver(t, lexicon)]
    for _ in range(rounds):
        for line, cs, known in data:
            guess = _viterbi(line, cs, w, known, MARGIN)
            if any(k is not None and k != g for k, g in zip(known, guess)):
                for tags, step in ((_viterbi(line, cs, w, known), 1.0), (guess, -1.0)):
                    for i, c in enumerate(cs):
                        if tags[i]:
                            for f in [*c[2], *_chain(line, c, cs[i - 1] if i else None, bool(i) and tags[i - 1])]:
                                w[f] += step
                                sums[f] += n * step
            n += 1
    return {k: v - sums[k] / n for k, v in w.items() if v or sums[k]}


#: Chance of a line end after an abbreviation; how much more often than usual a word goes on that may be one; odds above which
#: a word is one. Before any count the odds are exp(-letters) to 1.
AT_END, GOES_ON, ODDS = 0.01, 2.0, 20.0


RUN_OF_DOTS = re.compile(r"\.{2,}|…+")
#: A full stop with what follows: blanks and a word, the line's end, or a word that is glued to a run of dots.
STOP = re.compile(r"(?m)\.(?=[ \xa0]+([^\W_])|[ \xa0]*$|(?<=…\.)([^\W_]))")


def _stops(text: str) -> Iterator[tuple[str, str]]:
    """(word, word after it or nothing at a line's end) of each full stop of a text; runs of dots are the word DOTS."""
    if "." not in text and "…" not in text:
        return
    text = RUN_OF_DOTS.sub(DOTS + ".", text.replace("\r", "\n"))
    for m in STOP.finditer(text):
        i = k = m.start()
        if text[i - 1 : i] == DOTS:
            w = DOTS
        else:
            while k and not text[k - 1].isspace() and text[k - 1] != "(":
                k -= 1
            w = text[k:i]
            if not w[:1].isalnum() or not (w.replace(".", "").isalnum() or all(c.isalnum() or c == "." or unicodedata.category(c)[0] == "M" for c in w)):
                continue
        at = max(m.start(1), m.start(2))
        yield plain(w), FIRST_WORD.match(text, at)[0] or text[at] if at >= 0 else ""


def learn_lexicon(documents: DataFrame) -> Lexicon:
    """The lexicon of a corpus, counted over all documents, whatever the length or frequency of words.

    Counts are kept by task and summed. Of each word before a full stop is counted how often a line ends there and how often a small letter or a digit comes next.
    A word that ends lines as rarely as an abbreviation does and not as other words do is of kind never; else one that goes on
    more than GOES_ON times as often as words do is of kind maybe. Words after a number and a full stop, rather than after
    another sentence, go on after ordinals. All three are odds of binomial models, so a few occurrences decide nothing. What comes to the
    driver are the words with such odds; their number is that of a language's abbreviations, it doesn't grow with the documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["kind", "key", "n", "a", "b"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w, after in _stops(text or ""):
                    if w.strip("0123456789."):
                        n = held.setdefault(("w", w), [0, 0, 0])
                        n[0] += 1
                        n[1] += not after
                        n[2] += after[:1].islower()
                    if after[:1].isupper():
                        n = held.setdefault(("o", plain(after)), [0, 0, 0])
                        n[0] += 1
                        n[1] += len(w) <= 2 and w.isdecimal()
            if len(held) > 1 << 18:
                yield flush()
        yield flush()

    counts = documents.select("text").mapInArrow(count, "kind string, key string, n long, a long, b long")
    counts = counts.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = through_table(counts, "full-stops")
    rate = {r.kind: r.a / r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).collect()}
    if not rate:
        return NOTHING

    def odds(p: float, q: float):
        """Log odds that a of n came at rate p rather than at rate q."""
        q = min(max(q, 1e-4), 1 - 1e-4)
        return F.col("a") * math.log(p / q) + (F.col("n") - F.col("a")) * math.log((1 - p) / (1 - q))

    prior = -F.least(F.length("key"), F.lit(50)).cast("double")
    never = odds(AT_END, rate.get("w", 0.5)) + prior > math.log(ODDS)
    on = counts.where((F.col("kind") == "w") & ~never).agg(F.coalesce(F.sum("b") / F.sum("n"), F.lit(0.0))).first()[0]
    usual, own = min(max(GOES_ON * on, 1e-4), 0.9), F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.col("b") / F.col("n")))
    more = F.col("n") * (own * F.ln(own / usual) + (1 - own) * F.ln((1 - own) / (1 - usual)))
    kind = F.when(never, "never").when((own > usual) & (more + prior > math.log(ODDS)), "maybe")
    ordinal = odds(0.9, rate.get("o", 0.01)) > math.log(ODDS)
    kept = counts.select("key", F.when(F.col("kind") == "w", kind).when(ordinal, "ordinal").alias("kind")).where("kind IS NOT NULL").collect()
    return Lexicon({r.key: r.kind for r in kept if r.kind != "ordinal"}, MONTHS | {r.key for r in kept if r.kind == "ordinal"})


#: The tagger is trained on at most so many documents and characters, of whole texts.
SAMPLE, SAMPLE_CHARS = 2000, 1 << 23


def fit(documents: DataFrame, sample: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> tuple[dict[str, float], Lexicon]:
    """(weights, lexicon): the lexicon of all documents, and the tagger trained on whole texts of those of least hash, `sample`
    of them and `most_chars` characters together at most; these come to the driver."""
    lexicon = learn_lexicon(documents)
    texts, left = [], most_chars
    few = documents.where("length(trim(text)) > 0").where(F.length("text") <= most_chars).orderBy(F.xxhash64("doc_id"), "doc_id").select("text").limit(sample)
    for r in few.toLocalIterator():
        left -= len(r.text)
        if left < 0:
            break
        texts.append(r.text)
    return train(texts, lexicon), lexicon


def sentence_units(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, char_start, char_end) of every sentence unit of every document's whole text.

    Offsets count code points; there are no blanks at a unit's ends; line ends always end one. Null, empty and blank
    texts have no unit; repeated documents have their own rows. The tagger is trained as `fit` says; a corpus without lines to
    learn from is cut by START. One pass without a shuffle tags the texts.
    """
    weights, lexicon = fit(documents, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in units(t, weights, lexicon):
                    ids.append(i)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "char_start", "char_end"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, char_start int, char_end int")
