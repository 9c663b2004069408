import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from sparkgap.functions.net_names import name_voltage
from sparkgap.plans import boards

WIDE = str.maketrans({chr(c): chr(c + 0xFEE0) for c in range(0x21, 0x7F)})
PLAIN = ("GND", "VCC_3V3", "-15V", "HV400", "Uart2_Tx", "P12V/aux", "MID+5V", "N9")


def brute_normal(name):
    text = "".join(c for c in unicodedata.normalize("NFKC", name) if unicodedata.category(c) not in ("Cc", "Cf")).upper()
    return re.sub("_+", "_", re.sub(r"[-+. /]", "_", text)).strip("_")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("names"))
    names = [*PLAIN, *[n.translate(WIDE) for n in PLAIN], "3​V3", "①V"]
    spark.createDataFrame([(n, "GND") for n in names], "net_a string, net_b string").write.parquet(f"{path}/measurements.parquet")
    for t in ("features", "manual_entries", "assignment_snapshots"):
        spark.createDataFrame([("GND",), (None,)], "net_name string").write.parquet(f"{path}/{t}.parquet")
    return path, names


def test_name_queries_take_every_spelling(spark, folder):
    path, names = folder
    got = {r.net_name: (r.normal, r.n_tokens) for r in boards.net_normalize_all(spark, path).collect()}
    assert got == {n: (brute_normal(n), len([t for t in brute_normal(n).split("_") if t])) for n in names}
    volts = {r.net_name: r.volts for r in boards.voltage_token_all(spark, path).collect()}
    wanted = {"GND": None, "VCC_3V3": 3.3, "-15V": -15.0, "HV400": 400.0, "Uart2_Tx": None, "P12V/aux": 12.0, "MID+5V": 5.0, "N9": None}
    assert volts == wanted | {n.translate(WIDE): v for n, v in wanted.items()} | {"3​V3": None, "①V": 1.0}
    assert spark.range(1).select(name_voltage(F.lit(None).cast("string")).alias("v")).first().v is None


def test_rules_take_every_spelling(spark, folder):
    path, names = folder
    best = {r.net_name: (r.matched_rule_id, r.confidence, r.severity) for r in boards.rule_classify_all(spark, path).collect()}
    assert set(best) == set(names) and best["GND"][0] and all(best[n.translate(WIDE)] == best[n] for n in ("GND", "VCC_3V3", "Uart2_Tx"))
    hits = {r.net_name: r.rule_ids for r in boards.rule_all_matches_all(spark, path).collect()}
    assert hits["GND".translate(WIDE)] == hits["GND"]
