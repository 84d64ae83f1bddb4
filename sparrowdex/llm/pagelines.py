"""Lines of a page: words, function words, sentence ends. Shared by the spam and boilerplate operators."""

from __future__ import annotations

import re

#: Frequent function words of the languages of the crawl.
FUNCTION_WORDS = frozenset(
    """
    a an and are as at be been before but by can could despite did do does each even every for from had has have he her his how i if in
    into is it its like may might more most must my neither no nor not of off on only or our over per she should so some such
    than that the their them then there these they this those to us very was we were what when where which while who whom whose why will with
    within without would you your
    aber als am an auch auf aus bei bevor bis da das dass dem den denn der des die durch ein eine einem einen einer eines er es für
    haben hat ich ihm ihn ihr ihre im in ist kaum kein keine mit nach nicht noch nur ob obwohl oder ohne sein seine seit sich sie sind so
    über um und unter vom von vor war warum was weil wenn wer wie wird wir wo während zu zum zur zwischen viele
    au aussi autant aux avant avec c ce ces cet cette chaque d dans de depuis des dont du elle encore entre est et il ils j je l la le les
    leur leurs lui mais n ne nous ou où par peu plus pour pourquoi puis qu quand que quel quelle qui s sa sans se ses si son sont sous sur
    t un une vous y à
    al antes cada como con cuando cuándo cómo de del desde donde durante e el ella ellos era es ese esta este la las lo los luego mi muy no
    o para pero por porque que qué quién se si sin sobre son su sus también tan tantas tantos una uno unos y ya
    """.split()
)

WORDS = re.compile(r"[^\W_]+").findall
URLS = re.compile(r"https?://\S+")
ENDS = re.compile(r"[.!?…:;。！？]['\"”“’»)\]]*$")


def words(line: str) -> list[str]:
    """Lower-cased words of a line, those of URLs left out."""
    line = line.lower()
    return WORDS(URLS.sub(" ", line) if "://" in line else line)


def function_share(ws: list[str]) -> float:
    """Share of function words."""
    return sum(map(FUNCTION_WORDS.__contains__, ws)) / len(ws) if ws else 0.0


def folded(text: str) -> str:
    """Case-folded, with single spaces."""
    return " ".join(text.split()).casefold()
