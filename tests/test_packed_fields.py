import random

from pyspark.sql import functions as F

from sparkgap.operators.packed_fields import explode_packed, packed_items

CASES = {
    'a, "b; c" ,d=\'x, y\'|"9=top; ""q"" bottom"': ["a", "b; c", "d=x, y", '9=top; "q" bottom'],
    '["low noise", "a|b","π"]': ["low noise", "a|b", "π"],
    "x\\, y, 5\" post; 3 ;;": ["x, y", '5" post', "3"],
    '.c="a "" b"': ['.c=a " b'],
    'so-called "dirty", z': ['so-called "dirty"', "z"],
    "'hv, ac'\tfast\\; slow\t": ["hv, ac", "fast; slow"],
    "a\nb\r\nc": ["a", "b", "c"],
    '"so-called ""dirty""",rf': ['so-called "dirty"', "rf"],
    "don't, won't": ["don't", "won't"],
    '"open, b': ['"open', "b"],
    "13=J272; '7'; 2=inner ring": ["13=J272", "7", "2=inner ring"],
    " , ;| ": [], "": [], "[]": [], "a": ["a"],
}


def test_cases(spark):
    df = spark.createDataFrame([(k,) for k in CASES] + [(None,)], "s string")
    out = {r.s: r.i for r in df.select("s", packed_items(F.col("s")).alias("i")).collect()}
    assert out.pop(None) == []
    assert out == CASES


def test_round_trip_of_random_items(spark):
    rnd = random.Random(7)
    alphabet = ["a", "B1", " ", ",", ";", "|", '"', "'", "=", "x y", "", "2"]
    rows = []
    for k in range(400):
        items = []
        for _ in range(rnd.randint(0, 6)):
            item = "".join(rnd.choices(alphabet, k=rnd.randint(1, 6))).strip(' "\'=')
            if item:
                items.append(item)
        marked = ['"' + i.replace('"', '""') + '"' for i in items]
        rows.append((k, rnd.choice([",", "; ", " | ", "\t"]).join(marked), items))
    df = spark.createDataFrame(rows, "id int, s string, want array<string>")
    bad = df.withColumn("got", packed_items(F.col("s"))).filter("got <> want").collect()
    assert bad == []


def test_explode_drops_redelivery_and_keeps_repeats(spark):
    rows = [(1, "a;a;b", "x"), (1, "a;a;b", "y"), (2, None, "x"), (3, " ; ", "x"), (None, "c", "x"), (4, "t," * 50_000, "x")]
    out = explode_packed(spark.createDataFrame(rows, "fid int, f string, item string"), "fid", "f", "s")
    assert out.columns == ["src", "row_id", "pos", "item"]
    got = out.filter("row_id is null or row_id < 4").collect()
    assert sorted((r.row_id or 0, r.pos, r.item) for r in got) == [(0, 1, "c"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b")]
    assert out.filter("row_id = 4").count() == 50_000
    assert explode_packed(spark.createDataFrame([], "fid int, f string"), "fid", "f", "s").collect() == []
