"""Encoding, leaks, sentences, near duplicates, site lines, spam and furniture on small cases and against brute force."""

import base64
import os
import random
import re
from datetime import datetime

import numpy as np
import pytest

from sparrowdex.llm import boiler, encode, leaks, neardup, sentences, sitelines, spam

CORPUS = "/root/testdata/sf0.1"
DOC = "doc_id long, text string, ids string, words string"


def test_encoding_is_the_vocabularys(spark):
    tiktoken, P = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " \n\t ", "Hello  world's <|endoftext|> 12,345", "naïve 果樹園 🎉 é", "x" * 30000, "a\r\n\x00b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df).collect()}
    e = encode.PieceEncoder(path, P.PATTERN)
    for i, t in enumerate(texts):
        assert got[i] == (plain.encode_ordinary(t) if t else [])
        assert e.decode(got[i]) == (t or "")


def _edit(p, t):
    best = len(p)
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (a != b)))
        row = new
    return min(best, *row)


def test_myers_is_edit_distance():
    rng = random.Random(5)
    for _ in range(60):
        m, n = rng.randrange(1, 65), rng.randrange(1, 40)
        p, t = ([[rng.randrange(4) for _ in range(k)] for _ in range(9)] for k in (m, n))
        assert leaks.myers(np.array(p, np.uint64), np.array(t, np.uint64)).tolist() == [_edit(x, y) for x, y in zip(p, t)]


@pytest.mark.parametrize("small", [False, True])
def test_leaks(spark, monkeypatch, small):
    if small:  # in many pieces
        for name in ("DOCUMENTS", "HITS", "ROWS"):
            monkeypatch.setattr(leaks, name, 3)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30)), "test") for i in range(20)] + [(20, "too short", "test"), (21, None, "test")]
    docs = []
    for d in range(200):
        t = [word() for _ in range(rng.randrange(0, 80))]
        if d % 3 == 0:
            w = items[d % 20][1].split()
            a, n = rng.randrange(10), rng.randrange(8, 20)
            part = w[a : a + n]
            if d % 2:
                part[len(part) // 2] = "changed"
            t[len(t) // 2 : len(t) // 2] = part
        docs.append((d, ", ".join(t).upper(), "x", None))
    docs += [(900, None, "x", "x"), (901, "", "x", "x")]
    want = set()
    for d, t, *_ in docs:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        runs = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for i, s, _ in items:
            v = (s or "").split()
            if any(tuple(v[k : k + 12]) in runs for k in range(len(v) - 11)):
                want.add((d, i))
    got = leaks.leaked_items(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, "item_id long, text string, split string")).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.distance == 0} == want and want
    changed = {(d, i) for d, t, *_ in docs for i, s, _ in items if len(v := (s or "").split()) >= 12 and min(_edit(v[k : k + 12], re.findall(r"[^\W_]+", (t or "").lower())) for k in range(len(v) - 11)) == 1}
    assert {(r.doc_id, r.item_id) for r in got if r.distance == 1} == changed and changed


@pytest.mark.parametrize(("hot", "piece"), [(1 << 14, 1 << 20), (3, 50)])
def test_near_duplicates_are_exact(spark, monkeypatch, hot, piece):
    monkeypatch.setattr(neardup, "HOT", hot)  # tokens of more sets than that are split
    monkeypatch.setattr(neardup, "PIECE", piece)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(120)}" for _ in range(rng.randrange(3, 60))] for _ in range(60)]
    texts = []
    for i in range(240):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(120)}"
        texts.append((i, " ".join(w)))
    texts += [(1000, None), (1001, ""), (1002, "one two")]
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, t in texts if (w := (t or "").split()) and len(w) > 2}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(texts, "id long, text string")
    links, members = neardup.similar_pairs(df, 3, 0.6)
    got = [tuple(r) for r in neardup.all_pairs(links, members).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    rows = {r.id: r for r in neardup.linked_records(links, members).collect()}
    assert set(rows) == set(sets)


def test_near_duplicates_of_nothing(spark):
    links, members = neardup.similar_pairs(spark.createDataFrame([], "id long, text string"))
    assert links.count() == 0 and members.count() == 0


DOCS = "id long, url string, title string, content string, domain string, crawled_at timestamp, is_removed boolean, h1 string, line string"
NOW = datetime(2025, 1, 2)


def test_site_lines(spark):
    rows = [(i, f"http://www.a.org/{i}", "t", f"Notice  {i}\r\n\nown line {chr(97 + i)}\nshared", None if i % 2 else "WWW.A.org", NOW, False, "x", "x") for i in range(6)]
    rows += [(9, "http://b.org/", "t", "Notice 1\nshared", "b.org", NOW, None, "x", "x"), (10, None, "t", "shared", None, NOW, False, "x", "x"), (11, "http://a.org/n", "t", None, "a.org", NOW, False, "x", "x")]
    rows += [(5, "http://a.org/5", "t", "old\nshared\nnew", "a.org", datetime(2024, 1, 1), False, "x", "x"), (0, "http://a.org/0", "t", rows[0][3], None, None, False, "x", "x"), (12, "u", "t", "shared", "a.org", NOW, True, "x", "x")]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted((r.id, r.line_no) for r in sitelines.repeated_lines(df).collect()) == sorted((i, n) for i in range(6) for n in (0, 3))
    clean = {r.id: (r.content, r.removed) for r in sitelines.without_repeated_lines(df).collect()}
    assert clean[3] == ("\nown line d", 2) and clean[9] == ("Notice 1\nshared", 0) and clean[11] == (None, 0)


def test_copies_are_one_cluster(spark):
    rows = [(i, f"http://a.org/{i}", "t", "same text\nof all", "a.org", NOW, False, "x", "x") for i in range(8)]
    df = spark.createDataFrame(rows, DOCS)
    assert sitelines.repeated_lines(df, 5, "records").count() == 16
    assert sitelines.repeated_lines(df, 5, "clusters").count() == 0
    assert sitelines.repeated_lines(df.limit(0)).count() == 0


PROSE = "The old mill stands by the river. It was built for the town in the last century, and it still grinds flour for us."


KNOWN = frozenset("the by it was for in and for us is".split())
POLISH = "Stary młyn stoi nad rzeką. Zbudowano go dla miasta w zeszłym wieku i nadal miele mąkę dla nas. W każdą sobotę piekarz z sąsiedniej wsi przyjeżdża po worki, a jego syn pomaga mu je ładować na wóz. Kiedy spadnie deszcz, woda w rzece wzbiera i koło kręci się szybciej niż zwykle."
RUSSIAN = "Старая мельница стоит у реки. Её построили для города в прошлом веке, и она всё ещё мелет муку для нас. Каждую субботу пекарь из соседней деревни приезжает за мешками, а его сын помогает ему грузить их на телегу. Когда идёт дождь, вода в реке поднимается и колесо вертится быстрее."


def _spam(f):
    return spam.PRIOR[0] + sum(w * x for w, x in zip(spam.PRIOR[1:], f)) > 0


def test_spam_features():
    names = dict(zip(spam.FEATURES, range(6)))
    terms = ["buy", "shoes", "cheap", "sale", "boots", "online"]
    stuffed = spam.page_features("t", "\n".join(" ".join(random.Random(i).choice(terms) for _ in range(30)) for i in range(5)), 3, KNOWN)
    assert stuffed[names["repeated"]] > 0.9 and stuffed[names["periodic"]] > 0.1 and _spam(stuffed)
    assert not _spam([0.0 if n in ("repeated", "regular", "periodic") else x for n, x in zip(spam.FEATURES, stuffed)])  # what the lags say decides
    regular = spam.page_features("t", " ".join(f"{w} item{i}" for i in range(40) for w in terms), 0, KNOWN)
    assert regular[names["regular"]] > 0.45
    assert not _spam(spam.page_features("t", PROSE, 3, KNOWN))
    assert spam.page_features(None, None, 0) == [0.0] * 6 == spam.page_features("t", "", 9)
    explained = "\n".join(f"https://x.org/{i} – {p}" for i, p in enumerate([PROSE, POLISH, RUSSIAN]))
    assert not _spam(spam.page_features("t", explained, 5, KNOWN))


def test_short_links_are_a_list():
    rng = random.Random(3)
    name = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(3))
    for n in (2, 4):
        assert _spam(spam.page_features("t", "\n".join(" ".join(name() for _ in range(n)) for _ in range(200)), 200, KNOWN))


@pytest.mark.parametrize("text", [POLISH, RUSSIAN])
def test_prose_of_an_unknown_language_is_no_list(text):
    assert not _spam(spam.page_features("t", text, 2, KNOWN))


def test_function_words(spark):
    pages = [(i, "t", f"the mill {i} of the town" if i % 3 else f"der Ort {i}", "EN-us" if i % 3 else " de") for i in range(90)] + [(100, None, None, None), (101, "t", "rare odd page", "")]
    got = spam.function_words(spark.createDataFrame(pages, "id long, title string, content string, language string"))
    assert got == {"the", "mill", "of", "town", "der", "ort"}


def test_spam_decision(spark):
    pages = [(i, "t", PROSE if i % 2 else "cheap shoes sale boots online shop " * 9, 2, "en") for i in range(40)] + [(99, None, None, None, "x")]
    labels = [(i, "ok" if i % 2 else "spam", "r") for i in range(30)] + [(1, "spam", "r"), (31, None, "r"), (32, "odd", "r")]
    got = spam.list_pages(spark.createDataFrame(pages, "id long, title string, content string, links int, language string"), spark.createDataFrame(labels, "id long, verdict string, rater string"))
    assert {r.id for r in got.where("spam").collect()} == set(range(0, 40, 2))


def test_furniture(spark):
    rows = []
    for i in range(12):
        lines = ["Home | Shop | Help | About", f"Home > News > Title number {i}", f"Title number {i}", "By the editorial desk", PROSE, "Background", f"{PROSE} And so on {i}.", f"- entry {chr(97 + i) * 3}", "Share this page: Mail Print", "→ Another article", "Back to top"]
        rows.append((i, "a.org", f"Title number {i}", "\n".join(lines)))
    rows += [(50, None, None, None), (51, "a.org", "t", "")]
    got = {}
    for r in boiler.furniture_lines(spark.createDataFrame(rows, "id long, site string, title string, content string")).collect():
        got.setdefault(r.id, set()).add(r.line_no)
    # PROSE is on every page of this small site, which makes it a notice here
    assert all(got[i] - {4, 6} == {0, 1, 3, 8, 9, 10} - {4, 6} or got[i] >= {0, 1, 3, 8, 9, 10} for i in range(12))
    assert all(not got[i] & {2, 7} for i in range(12)) and not set(got) & {50, 51}


def test_a_long_notice_is_furniture(spark):
    notice = "This site keeps small files on your device, so that it can remember what you chose, count its visitors and show you what you may like. By reading on you agree to that and to the terms of use, which you find in the footer of all pages."
    rng = random.Random(4)
    prose = lambda: " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(2)) for _ in range(40)).capitalize() + "."
    rows = [(10 * s + i, f"s{s}.org", f"Title {s} {i}", f"{notice}\nTitle {s} {i}\n{prose()} {prose()}\n{prose()}") for s in range(2) for i in range(6)]
    shared = f"{prose()} {prose()}"  # a paragraph that two of six pages share is text
    rows = [(i, s, t, f"{c}\n{shared}" if i in (3, 4) else c) for i, s, t, c in rows]
    got = {(r.id, r.line_no) for r in boiler.furniture_lines(spark.createDataFrame(rows, "id long, site string, title string, content string")).collect()}
    assert len(notice) > 199 and got == {(r[0], 0) for r in rows}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mr. Fox at Hen Inc. met 3.5 hens, etc., at 4 p.m. sharp. They ran!", ["Mr. Fox at Hen Inc. met 3.5 hens, etc., at 4 p.m. sharp.", "They ran!"]),
        ('"Where is it?" asked the hen. (It was gone.) See index.html for more.', ['"Where is it?" asked the hen.', "(It was gone.)", "See index.html for more."]),
        ("Am 3. Mai kam Fr. Dr. Huhn z. B. um 4 Uhr. Warum?", ["Am 3. Mai kam Fr. Dr. Huhn z. B. um 4 Uhr.", "Warum?"]),
        ("管理员说：“有苹果。”地图……检查了！为什么？", ["管理员说：“有苹果。”", "地图……检查了！", "为什么？"]),
        ("「どこですか。」と係が聞いた。写す。", ["「どこですか。」と係が聞いた。", "写す。"]),
        ("ดัชนีนับ 37 แอปเปิล   ห้องสมุด Piko นับ", ["ดัชนีนับ 37 แอปเปิล", "ห้องสมุด Piko นับ"]),
        ("“कहाँ है?” संग्रह ने पूछा। डॉ. Fox आया।", ["“कहाँ है?” संग्रह ने पूछा।", "डॉ. Fox आया।"]),
        ("Head line\r\n \n1) entry one\n- two", ["Head line", "1) entry one", "- two"]),
        ("  \n\t ", []), ("", []), (None, []),
    ],
)
def test_sentences(tagger, text, want):
    assert [text[a:b] for a, b in sentences.units(text, *tagger)] == want


@pytest.fixture(scope="module")
def tagger(spark):
    if not os.path.isdir(CORPUS):
        pytest.skip("no test tables")
    return sentences.fit(spark.read.parquet(f"{CORPUS}/documents.parquet"))


def test_the_tagger_is_trained(spark, tagger):
    weights, lexicon = tagger
    texts = [r.text for r in spark.read.parquet(f"{CORPUS}/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").limit(2000).collect()]
    lines = [x for t in texts for x in sentences.silver(t, lexicon)]
    assert len(lines) > 1000 and sum(k is False for _, _, known in lines for k in known) > 500
    assert sum(abs(v) > 0.5 for v in weights.values()) > 20 and sentences.train([]) == sentences.START
    right = sum(k is None or k == g for line, cs, known in lines for k, g in zip(known, sentences._viterbi(line, cs, weights)))
    assert right > 0.99 * sum(len(known) for _, _, known in lines)


def test_unpunctuated_text_is_cut_too(tagger):
    line = "为什么爬虫在月底比较照片管理员在旧港口附近统计目录地图保存了71个照片"
    assert len(sentences.units(line, *tagger)) > 1
    assert len(sentences.units("搜索与索引", *tagger)) == 1


def test_lexicon(spark):
    words = [a + b + c for a in "abcdefghijklmn" for b in "abcdefghijklmn" for c in "abcdefghijklmn"][:2500]
    rows = [("\n".join([" ".join(f"{w}. Next" for w in words[i : i + 500]), *("It ended.\nAll was well." for _ in range(500))]),) for i in range(0, 2500, 500)] * 20
    got = sentences.learn_lexicon(spark.createDataFrame(rows, "text string"))
    assert set(got.kinds) == set(words) and got.ordinals == sentences.MONTHS and set(got.kinds.values()) == {"never"}
    assert sentences.learn_lexicon(spark.createDataFrame([], "text string")) == sentences.NOTHING


def test_sentence_units_cover_the_text(spark):
    rows = [(1, "One two. Three four!\nFive", "x", "x"), (2, None, "x", "x"), (3, "", "x", "x"), (1, "One two. Three four!\nFive", "x", "x"), (4, "a " * 50000, "x", "x")]
    got = sentences.sentence_units(spark.createDataFrame(rows, DOC)).collect()
    assert sorted((r.char_start, r.char_end) for r in got if r.doc_id == 1) == [(0, 8), (0, 8), (9, 20), (9, 20), (21, 25), (21, 25)]
    assert {r.doc_id for r in got} == {1, 4}
    assert sentences.sentence_units(spark.createDataFrame([], DOC)).count() == 0
