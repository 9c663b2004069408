import random

from sparkgap.llm.canonical_values import close_texts, map_values, mapped_fields

REFERENCE = [
    (1, "net_class", "GND", ["ground", "chassis return"]), (2, "net_class", "POWER", None), (3, "net_class", "POWER_NEGATIVE", []), (9, "net_class", "IO_DIGITAL", ["logic pin"]),
    (101, "net_name", "BACKLIGHT_BYPASS", ["BCKL_BYPS"]), (102, "net_name", "PUMP_SENSE", []), (103, "net_name", "PUMP_RETURN", ["PMP_RTRN"]), (104, "net_name", "SENSE_RETURN", []),
]
SCHEMA = "ref_id bigint, kind string, entry string, aliases array<string>"
NAMES = {
    "backlight  bypass": 101, "BCKLBYPS": 101, "bypass-backlight": 101, "BACKLGIHT_BYPASS": 101, "sig: Backlight_Bypass*": 101, "net pump_sense (rev b)": 102, "1NVALID": 0, "pumpsense": 102,
    "ＰＵＭＰ＿ＲＥＴＵＲＮ": 103, "pmp rtrn": 103, "pump": 0, "pump bypass": 0, "OXFORD UMBRELLA 2": 0, "senze.return": 104, "PVMP - RETVRN": 103, "?": 0, "x" * 500: 0, "pump pump sense": 0,
    "BACKL1GHT_BYPASS": 101, "pump sense return": 0,
}
CLASSES = {"Ground": 1, "class gnd net": 1, "gdn": 1, "negative power": 3, "IO - DIGITAL": 9, "o - digital": 9, "clock tree": 0, "powre": 2, "logic.pin": 9, "pow": 0}


def test_typed_values(spark):
    reference = spark.createDataFrame(REFERENCE, SCHEMA)
    values = spark.createDataFrame([("net_name", v) for v in NAMES] + [("net_class", v) for v in CLASSES] + [("net_name", None), ("net_name", " "), ("net_name", "pump"), ("other", "GND")], "kind string, value string")
    got = {(r.kind, r.value): r.ref_id for r in map_values(values, reference).collect()}
    assert got.pop(("other", "GND")) == 0
    assert got == {("net_name", v): i for v, i in NAMES.items()} | {("net_class", v): i for v, i in CLASSES.items()}


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_no_close_pair_is_lost(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choices("abc", k=rnd.randint(1, 8))) for _ in range(60)]
    typed = ["".join(rnd.choices("abc", k=rnd.randint(1, 9))) for _ in range(150)]
    got = {(r.typed, r.word) for r in close_texts(spark.createDataFrame([("k", t) for t in typed], "kind string, typed string"), spark.createDataFrame([("k", w) for w in words], "kind string, word string")).collect()}
    allowed = lambda n: 0 if n <= 2 else 1 if n <= 5 else 2
    missing = {(t, w) for t in typed for w in words if osa(t, w) <= allowed(len(w))} - got
    assert not missing
    assert all(osa(t, w) <= allowed(len(w)) for t, w in got)


def test_fields_once_per_row_and_empty_list(spark):
    rules = spark.createDataFrame([(1, "exact", "pump-sense", "gnd"), (1, "exact", "pump-sense", "gnd"), (2, "token", "pump-sense", "GND"), (3, "exact", None, " ")], "rule_no bigint, match_type string, pattern string, net_class string")
    manual = spark.createDataFrame([(7, "PUMP_SENSE"), (8, "PUMP  RETURN"), (9, "nothing like it")], "entry_id bigint, net_name string")
    reference = spark.createDataFrame(REFERENCE, SCHEMA)
    got = sorted((r.src, r.row_id, r.ref_id) for r in mapped_fields(rules, manual, reference).collect())
    assert got == [("manual_entries.net_name", 8, 103), ("manual_entries.net_name", 9, 0), ("net_rules.net_class", 1, 1), ("net_rules.pattern", 1, 102)]
    nothing = mapped_fields(rules, manual, reference.limit(0)).collect()
    assert {r.ref_id for r in nothing} == {0} and len(nothing) == 6


def test_annotations_are_learned_and_light_words_may_be_missing(spark):
    names = [(k, "city", f"{a} {b}", None) for k, (a, b) in enumerate([(x, "holding company") for x in ("albatros", "birkenhof", "cassiopeia", "drachenfels", "eulenspiegel", "falkenstein")])]
    reference = spark.createDataFrame(names, SCHEMA)
    values = ["attn albatros holding company", "albatros holding company attn", "attn drachenfells holding company", "eulenspiegel company holding", "cassiopeia holdng", "company holding", "attn", "attn zzz", "x attn albatros holding company y"]
    got = {r.value: (r.ref_id, r.nearest_ref_id) for r in map_values(spark.createDataFrame([("city", v) for v in values], "kind string, value string"), reference).collect()}
    assert [got[v][0] for v in values[:4]] == [0, 0, 3, 4]
    assert got["company holding"][0] == 0 and got["attn"] == (0, None) == got["attn zzz"]
    assert got["cassiopeia holdng"][1] == 2


def test_no_name_above_the_threshold_is_lost(spark):
    import math

    from sparkgap.llm import canonical_values as cv

    rnd = random.Random(12)
    words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(3, 7))) for _ in range(25)]
    heavy = lambda: words[min(int(rnd.expovariate(0.25)), 24)]
    names = {k: list(dict.fromkeys(heavy() for _ in range(rnd.randint(1, 7)))) for k in range(40)}
    values = {f"v{k}": [w if rnd.random() < 0.8 else w[:-1] + "z" for w in rnd.choice(list(names.values()))] for k in range(120)}
    for v in values.values():
        rnd.shuffle(v)
        if rnd.random() < 0.4 and len(v) > 1:
            v.pop()
        if rnd.random() < 0.3:
            v.append(heavy())
    forms = spark.createDataFrame([("k", k, 0, t) for k, t in names.items()], "kind string, ref_id bigint, form int, tokens array<string>")
    typed = spark.createDataFrame([("k", v, t) for v, t in values.items()], "kind string, value string, tokens array<string>")
    form_words = cv.weighted_forms(forms)
    repaired = close_texts(typed.selectExpr("kind", "explode(tokens) as typed"), form_words.select("kind", "word").distinct())
    got = {(r.value, r.ref_id): r.score for r in cv.scored_names(typed, repaired, form_words).collect()}
    near = {(r.typed, r.word): r.edits for r in repaired.collect()}
    weight = {w: math.log1p(len(names) / sum(w in t for t in names.values())) for t in names.values() for w in t}
    for value, tokens in values.items():
        heft = [max([weight[w] for (t, w) in near if t == token], default=math.log1p(len(names))) for token in tokens]
        norm = math.sqrt(sum(h * h for h in heft))
        for k, name in names.items():
            best = {}
            for f, word in enumerate(name):
                options = [(near[token, word], p) for p, token in enumerate(tokens) if (token, word) in near]
                if options:
                    e, p = min(options)
                    best[p] = max(best.get(p, 0), heft[p] * weight[word] * (1 - cv.EDIT_COST * e))
            score = sum(best.values()) / (norm * math.sqrt(sum(weight[w] ** 2 for w in name)))
            assert (value, k) in got or score < cv.THRESHOLD, (value, k, score)
            if (value, k) in got:
                assert abs(got[value, k] - score) < 1e-9


def test_a_common_word_brings_few_pairs(spark):
    from sparkgap.llm import canonical_values as cv

    forms = spark.createDataFrame([("k", k, 0, [f"word{k}x", "common"]) for k in range(200)], "kind string, ref_id bigint, form int, tokens array<string>")
    typed = spark.createDataFrame([("k", f"v{k}", [f"word{k}x", "common"]) for k in range(200)], "kind string, value string, tokens array<string>")
    form_words = cv.weighted_forms(forms)
    repaired = typed.selectExpr("kind", "explode(tokens) as typed").distinct().selectExpr("kind", "typed", "typed as word", "0 as edits")
    assert cv.scored_names(typed, repaired, form_words).count() == 200
