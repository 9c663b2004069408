import pytest

from sparkgap.llm.stuffed_pages import recurring, stuffed_pages, stuffing

PROSE = (
    "The track was moved next to the hole because the gap was only small. Please check the report before the board is ordered, and tell the lab which of the"
    " values they measured again. Nobody could say why the old name was still in the list."
)
GERMAN = "Die Leiterbahn wurde neben der Bohrung verschoben, weil der Abstand zu klein war. Bitte den Schlitz verlängern, bevor die Platte bestellt wird. "
TABLE = "\n".join(f"F.CU;NET_A{k};GND_{k};0.{k}15" for k in range(40))
SPAM = {
    "keywords": "copper tape, buy copper tape, cheap pcb, copper tape, cheap pcb online, copper tape! " * 8,
    "links": "\n".join(f"https://shop{k}.deal.example/a/b-{k} gauge" for k in range(9)),
    "tags": " ".join(f"#Brisko{k} #CopperTape" for k in range(12)),
    "listing": " * ".join(f"Velto copper tape X{k}1-8{k} SKU 10{k}33{k}" for k in range(10)),
    "places": " :: ".join(["Kestlow", "Brisko", "Tansbeck", "Gerber viewer", "Velmora", "Corvassa", "Sundrey", "Mirelle", "Ondaro", "Zandrel", "Pexium", "Directory"]),
    "stuffed prose": "Buy pcb quote here, the best pcb quote and the cheapest pcb quote for every pcb quote user. Our pcb quote is a pcb quote that beats any other pcb quote. " * 2,
}
FINE = {
    "prose": PROSE,
    "repeated paragraphs": GERMAN * 200,
    "table": PROSE + "\n\n" + TABLE,
    "tag line": PROSE + "\nTags: bus, low noise, power",
    "links beside text": PROSE + "\nSee also:\n- www.gauge-stack.example/cs\n- http://trace-nest.example/",
    "navigation": "Home » Archive » filter\n" + PROSE,
    "empty": "", "null": None, "one word": "copper", "signs": "!!! ??? ;;;",
}


@pytest.mark.parametrize("name", SPAM)
def test_spam(name):
    assert stuffing(SPAM[name])[0] > 0.66


@pytest.mark.parametrize("name", FINE)
def test_ordinary(name):
    assert stuffing(FINE[name])[0] < 0.45


def test_recurrence_against_brute_force():
    import numpy as np

    rnd = np.random.default_rng(0)
    ids, content = rnd.integers(0, 30, 200), rnd.random(200) < 0.7
    want = [bool(content[i]) and any(content[j] and ids[j] == ids[i] for j in range(max(0, i - 12), min(200, i + 13)) if j != i) for i in range(200)]
    assert recurring(ids, content).tolist() == want


def test_rows_nulls_and_empty(spark):
    rows = [(k, t, "x") for k, t in enumerate([*SPAM.values(), *FINE.values()])] + [(None, SPAM["tags"], "x"), (0, SPAM["keywords"], "x")]
    out = stuffed_pages(spark.createDataFrame(rows, "doc_id int, text string, is_stuffed string"))
    got = [r.doc_id for r in out.filter("is_stuffed").collect()]
    assert sorted(-1 if d is None else d for d in got) == [-1, 0, 0, 1, 2, 3, 4, 5]
    assert stuffed_pages(spark.createDataFrame([], "doc_id int, text string")).collect() == []


KEYWORDS = "watches bags rings chains belts shoes coats hats cases lamps clocks chairs tables pens knives spoons".split()


@pytest.mark.parametrize("connector", ["and", "or", "für", "de"])
def test_regular_lists_with_connectors_at_any_lag(connector):
    for n in (5, 11, 16):
        page = f" {connector} ".join(f"cheap {w}" if k % 3 else w for k, w in enumerate(KEYWORDS[:n])) + f" {connector} "
        assert stuffing(page * 40)[0] > 0.66, (connector, n)
    wide = f" {connector} ".join(f"{w}{'abcdefghijklmnop'[k]} {v}" for w in KEYWORDS for k, v in enumerate(KEYWORDS)) + f" {connector} "
    assert stuffing(wide * 6)[4] > 0.5  # the lag is 768 marks


def test_repeated_sentences_are_not_regular_lists():
    assert stuffing((PROSE + " ") * 50)[0] < 0.3 and stuffing(GERMAN * 50)[4] < 0.1


def test_many_texts_at_once_are_judged_like_single_ones():
    import numpy as np

    from sparkgap.llm import stuffed_pages as sp

    texts = [t or "" for t in [*SPAM.values(), *FINE.values(), GERMAN, "x", ""]] * 3
    together = np.vstack([sp.judged_shares(c) for c in sp._chunks(texts)])
    assert np.allclose(together, [stuffing(t) for t in texts])
    assert [len(c) for c in sp._chunks(["a" * sp.CHUNK, "b", "c" * sp.CHUNK])] == [1, 1, 1] and sp.judged_shares([]).shape == (0, 5)


def test_gaps_against_brute_force():
    import numpy as np

    from sparkgap.llm.stuffed_pages import gaps

    rnd = np.random.default_rng(1)
    ids, texts = rnd.integers(0, 9, 150), np.sort(rnd.integers(0, 4, 150))
    before, after = gaps(ids, texts)
    for i in range(150):
        back = [i - j for j in range(i) if ids[j] == ids[i] and texts[j] == texts[i]]
        ahead = [j - i for j in range(i + 1, 150) if ids[j] == ids[i] and texts[j] == texts[i]]
        assert (before[i] if back else 0, after[i] if ahead else 0) == (min(back, default=0), min(ahead, default=0))


@pytest.mark.parametrize("mark, kind", [("https://a.b/c", "LINK"), ("gauge-mart.shop/x?y", "LINK"), ("#Tag", "TAG"), ("tags:x", "TAG"), ("NET_A1", "NAME"), ("IN2.CU", "NAME"), ("X54-8", "CODE"), ("0.25", "NUMBER"), ("weil", "FUNCTION"), ("low-noise", "WORD")])
def test_kinds_of_marks(mark, kind):
    from sparkgap.llm import stuffed_pages as sp

    kinds, ids, lengths, texts = sp.read_marks([f"so {mark} {mark} "])
    assert kinds.tolist() == [sp.FUNCTION, getattr(sp, kind), getattr(sp, kind)] and ids[1] == ids[2] and lengths[1] == len(mark)
