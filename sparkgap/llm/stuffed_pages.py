"""Pages of repeated keywords, links or product tags instead of sentences.

A text becomes a sequence of marks: words, links, tags, product codes, design
names (nets, layers) and numbers. From the gaps between the occurrences of each
word three signals are measured in windows of lags around every position:

* recurrence: how many content words return after a gap of at most `LAGS` marks
  (the positional autocorrelation summed over these lags). Prose, even when
  paragraphs are repeated, has its returns at longer gaps;
* regularity: how many content words return after the same gap as before, at any
  lag. Repeated sentences do so, too, but between two returns they use many
  different function words, where a list of keywords has at most its connectors;
* distinct-noun lists: stretches of words without function words, as in lists of
  places, brands or products.

Links, tags and codes count by themselves. Each position is judged from its
window, and a text is a case if the judged positions hold the given share of its
characters. Listings of measurements consist of design names and numbers, which
count as ordinary content.

Texts are read by one compiled expression; all the rest are array operations over
many texts at once, as words are numbered once per batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread_out

# Closed-class words (articles, pronouns, prepositions, conjunctions, auxiliaries, particles) by language.
ENGLISH = (
    "a about above after again against ago all almost along already also although always am among an and another any anybody anyone anything are around as at away back be because been before"
    " behind being below beneath beside besides between beyond both but by can cannot could did do does doing done down during each either else enough even ever every everybody everyone everything"
    " except few for from further had has have having he her here hers herself him himself his how however i if in inside instead into is it its itself just least less like may me might mine more"
    " most much must my myself near neither never no nobody none nor not nothing now of off often on once one only onto or other others otherwise our ours out outside over own per perhaps please"
    " quite rather same several shall she should since so some somebody someone something still such than that the their them then there therefore these they this those though through throughout"
    " thus till to together too toward towards under unless until up upon us very via was we were what whatever when where whether which while who whole whom whose why will with within without"
    " would yet you your yours"
).split()
GERMAN = (
    "ab aber alle allem allen aller alles als also am an andere anderen auch auf aus außer außerdem bei beide beim bereits bevor bin bis bist da dabei dafür daher damit danach dann daran darauf"
    " darf darum das dass davon dein dem den denn der deren des deshalb dessen dich die dies diese diesem diesen dieser dieses dir doch dort du durch ein eine einem einen einer eines er erst es"
    " etwas euch für gegen habe haben hat hatte hatten hier hinter ich ihm ihn ihnen ihr ihre ihrem ihren ihrer im immer in ins ist ja jede jedem jeden jeder jedes jene jener jetzt kann kein keine"
    " keinem keinen keiner keines können könnte man manche mehr mein mich mir mit muss müssen müsste nach neben nicht nichts nie niemand noch nun nur ob oben oder ohne schon sehr sein seine seinem"
    " seinen seiner seit selbst sich sie sind so sobald soll sollte sondern sonst statt trotz über um und uns unser unter vom von vor wann war waren warum was wegen weil weiter welche welcher wenn"
    " wer werden weshalb wie wieder wir wird wo wohl wollen wurde wurden würde zu zum zur zwar zwischen"
).split()
FRENCH = (
    "à afin ai ainsi alors après as au aucun aucune aussi autour autre aux avait avant avec avoir beaucoup bien c car ce ceci cela celle celui ces cet cette ceux chaque chez comme comment contre d"
    " dans de dehors déjà depuis derrière des dès dessous dessus deux devant doit donc dont du elle elles en encore enfin entre es est et étaient était été être eu eux fait faudrait faut fut ici il"
    " ils j jamais je jusque l la là laquelle le lequel les leur leurs lorsque lors lui m ma mais malgré me même mes moi moins mon n ne ni non nos notre nous on ont or ou où par parce pas pendant"
    " peu peut plus plusieurs pour pourquoi près presque puis puisque qu quand que quel quelle quelles quels qui quoi rien s sa sans se selon sera ses seulement si sien soit son sont sous souvent"
    " sur t ta tandis tant te tel telle tes toi ton toujours tous tout toute toutes très trop tu un une vers voici voilà vos votre vous y"
).split()
SPANISH = (
    "a adonde ahora al algo alguien algún alguna algunos allí ante antes aquel aquella aquí así aun aún aunque bajo bastante bien cada casi como cómo con contra cual cuál cualquier cuando cuándo"
    " cuanto de debe debajo del delante demasiado dentro desde después detrás donde dónde dos durante e el él ella ellas ellos en encima entonces entre era eran es esa ese eso esos esta está estaba"
    " están estas este esto estos fue fueron fuera ha había haber hacia han hasta hay he incluso jamás junto la las le les lo los luego mas más me mediante menos mi mí mientras mis mucho muy nada"
    " nadie ni ningún ninguna no nos nosotros nuestra nuestro nunca o os otra otras otro otros para pero poco por porque pues que qué quien quién quizá se sea según ser si sí sido siempre sin sino"
    " sobre solo sólo son su sus tal también tampoco tan tanto te ti tiene toda todavía todo todos tras tu tus u un una uno unos usted vosotros y ya yo"
).split()
FUNCTION_WORDS = frozenset([*ENGLISH, *GERMAN, *FRENCH, *SPANISH])

MARK = re.compile(
    r"[^\W\d_]+(?=[\s,;!?)]|\.\s)"  # most words, found at once; the last line has the others
    r"|(?:[hH][tT][tT][pP][sS]?://|[fF][tT][pP]://|[wW]{3}\.)\S+|(?<![\w@.])(?:[a-z0-9-]+\.)+[a-z]{2,}(?![\w.])(?:[/?]\S*)?"  # links and bare hosts
    r"|[#＃]\w+|@?\b[tT]ags?[=:]\w+"  # tags
    r"|[\w$/+\-~]*[A-Z]\w*_\w+|\b[A-Z][A-Z0-9]*\.[A-Z][A-Z0-9]*\b|\b[A-Z]+\$\d+"  # design names
    r"|\b(?:[A-Za-z]+\d+(?:-\d+)+|\d+(?:-\d+)+-[A-Za-z]+)\b"  # product codes
    r"|\d[\d.,]*|[^\W\d_]+(?:-[^\W\d_]+)*"  # numbers and words
)
WORD, FUNCTION, LINK, TAG, NAME, CODE, NUMBER = range(7)
LAGS, REACH = 12, 12
STUFFED, BARREN, MIN_MARKS = 0.5, 0.08, 8
REGULAR, EVEN, CONNECTORS = 0.6, 0.1, 0.15
SHARE = 0.55
CHUNK = 2_000_000  # characters of texts judged at once; a longer text is judged alone


def kind_of(mark: str) -> int:
    """What kind of mark a match of `MARK` is; words are lower case already."""
    first = mark[0]
    if first in "#＃@" or mark.startswith(("tag=", "tag:", "tags=", "tags:")):
        return TAG
    if "://" in mark or mark.startswith("www."):
        return LINK
    if "_" in mark or "$" in mark:
        return NAME
    if first.isdigit() and not any(c.isalpha() for c in mark):
        return NUMBER
    if "." in mark:
        return NAME if mark.isupper() else LINK
    if any(c.isdigit() for c in mark):
        return CODE
    return FUNCTION if mark in FUNCTION_WORDS else WORD


def read_marks(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind, number (equal for equal words), length and text of every mark of the texts, in order."""
    found = [MARK.findall(t) for t in texts]
    marks = pd.Series([m for f in found for m in f], dtype=object)
    codes, names = pd.factorize(marks)
    lowered = [n if "_" in n or n.isupper() and "." in n else n.lower() for n in names]
    ids, distinct = pd.factorize(pd.Series(lowered, dtype=object))
    kinds = np.array([kind_of(n) for n in distinct], np.int8)
    lengths = np.array([len(n) for n in distinct], np.int64)
    at = ids[codes] if len(codes) else np.empty(0, np.int64)
    return kinds[at], at.astype(np.int64), lengths[at], np.repeat(np.arange(len(texts)), [len(f) for f in found])


def gaps(ids: np.ndarray, texts: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How far back and ahead the same mark of the same text stands, by places (rising; the order by default); a very large number where it doesn't."""
    places = np.arange(len(ids)) if places is None else places
    none = np.int64(1 << 40)
    before, after = np.full(len(ids), none), np.full(len(ids), none)
    order = np.lexsort((ids, texts))  # stable, so positions rise within equal marks
    a, b = order[:-1], order[1:]
    same = (ids[a] == ids[b]) & (texts[a] == texts[b])
    before[b[same]] = after[a[same]] = (places[b] - places[a])[same]
    return before, after


def recurring(ids: np.ndarray, content: np.ndarray, texts: np.ndarray | None = None, lags: int = LAGS) -> np.ndarray:
    """Content words that return within `lags` marks, before or after."""
    at = np.flatnonzero(content)
    before, after = gaps(ids[at], np.zeros(len(at)) if texts is None else texts[at], at)
    out = np.zeros(len(ids), bool)
    out[at] = np.minimum(before, after) <= lags
    return out


def _window_sum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[high] - total[low]


def judged_shares(texts: Sequence[str]) -> np.ndarray:
    """Of each text the shares of its characters (of its marks) that are stuffed in any way, recur, form barren lists, are linked, return regularly."""
    kinds, ids, lengths, text = read_marks(texts)
    n = len(kinds)
    starts = np.searchsorted(text, np.arange(len(texts) + 1))
    place = np.arange(n)
    low, high = np.maximum(place - REACH, starts[text]), np.minimum(place + REACH + 1, starts[text + 1])
    around = lambda mask: _window_sum(mask, low, high)
    word, function = kinds == WORD, kinds == FUNCTION
    linked = (kinds == LINK) | (kinds == TAG) | (kinds == CODE)
    plain = word | function | linked
    before, after = gaps(ids, text)

    recur = recurring(ids, word, text)
    words = around(word)
    dense = (around(recur) >= STUFFED * np.maximum(words, 1)) & (words >= 3)

    n_plain = around(plain)
    in_words = (n_plain >= 0.7 * (high - low)) & (n_plain >= MIN_MARKS)
    barren = (around(function) <= BARREN * n_plain) & in_words

    last = np.int64(1 << 40)
    even = word & (before < last) & (after < last) & (np.abs(before - after) <= EVEN * np.maximum(before, after))
    n_even = around(even)
    period = around(np.where(even, before, 0)) / np.maximum(n_even, 1)
    diverse = function & (before >= period / 2)  # not the connector that came a few words ago
    regular = (n_even >= REGULAR * np.maximum(words, 1)) & (n_even >= 3) & (around(diverse) <= CONNECTORS * n_plain) & in_words

    ordinary = plain | (kinds == NUMBER)
    dense, barren, regular = dense & ordinary, barren & ordinary, regular & ordinary
    total = np.maximum(np.bincount(text, weights=lengths, minlength=len(texts)), 1)
    part = lambda mask: np.bincount(text[mask], weights=lengths[mask], minlength=len(texts)) / total
    return np.column_stack([part(m) for m in (linked | dense | barren | regular, dense, barren, linked, regular)])


def stuffing(text: str | None) -> tuple[float, ...]:
    """The shares of one text; 0 for null and texts without marks."""
    return tuple(float(x) for x in judged_shares([text or ""])[0])


def _chunks(texts: Sequence[str]) -> Iterator[Sequence[str]]:
    start, size = 0, 0
    for k, text in enumerate(texts):
        if size + len(text) > CHUNK and k > start:
            yield texts[start:k]
            start, size = k, 0
        size += len(text)
    if start < len(texts):
        yield texts[start:]


def stuffed_pages(documents: DataFrame, *, share: float = SHARE) -> DataFrame:
    """(doc_id, stuffed_share, recurring_share, barren_share, linked_share, regular_share, is_stuffed) of every document.

    Whole texts in one pass; a shuffle only if there are fewer partitions than
    cores. Null, empty and markless texts have shares
    of 0 and are no case. Repeated rows each get their judgement.
    """
    columns = ["stuffed_share", "recurring_share", "barren_share", "linked_share", "regular_share"]

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [judged_shares(chunk) for chunk in _chunks(batch["text"].fillna("").tolist())]
            out = pd.DataFrame(np.vstack(parts) if parts else np.empty((0, len(columns))), columns=columns)
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            out["is_stuffed"] = out["stuffed_share"] >= share
            yield out

    schema = "doc_id bigint, " + ", ".join(f"{c} double" for c in columns) + ", is_stuffed boolean"
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return spread_out(texts).mapInPandas(judged, schema)
