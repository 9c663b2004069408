import json

import pytest
from pyspark.sql import functions as F

from sparkgap.functions.net_names import name_voltage, normal_name
from sparkgap.operators import rules as rul
from sparkgap.vocabulary import MATCH_TYPES, NET_CLASSES


def test_normal_names(spark):
    cases = {"a-b+c.d e/f": "A_B_C_D_E_F", "__x--": "X", "Ｎｅｔ１": "NET1", "a​b": "AB", "": "", "+5V": "5V", "ﬁ": "FI"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "n string").select("n", normal_name(F.col("n")).alias("got"))
    assert {r.n: r.got for r in df.collect()} == cases | {None: None}


def test_voltage_tokens(spark):
    cases = {"3V3": 3.3, "1V8": 1.8, "5V": 5.0, "5V0": 5.0, "12V": 12.0, "P3V3": 3.3, "M12V": -12.0, "N12V": -12.0, "+15V": 15.0, "-15V": -15.0, "VREF_2V5": 2.5, "HV400": 400.0,
             "GPIO12": None, "ADC_IN1": None, "UART2_TX": None, "CH4": None, "M2_CS": None, "N1": None, "03V05": 3.05}
    df = spark.createDataFrame([(k,) for k in cases], "n string").select("n", name_voltage(F.col("n")).alias("got"))
    assert {r.n: r.got for r in df.collect()} == cases


def test_self_test_passes(spark):
    out = rul.self_test(spark).collect()
    assert len(out) == 28 and all(r.passed for r in out)


def test_ties_hostile_names_and_repeats(spark):
    names = ["BAT", "a​b", None, "", "GPIO_1V8", "NEG12V", "VEE", "GPIO_1V8", "x" * 100_000]
    df = spark.createDataFrame([(n, "kept") for n in names], "net_name string, severity_in string")
    got = [(r.net_name, r.final_class, r.final_voltage_v, r.matched_rule_id, r.severity_in) for r in rul.classify_names(df, rul.builtin_pack()).collect()]
    assert len(got) == 9
    by_name = {g[0]: g for g in got}
    assert by_name["BAT"][1:4] == ("BATTERY", None, "battery_bat_minus_exact")
    assert by_name["GPIO_1V8"][1:4] == ("POWER", 1.8, "positive_voltage_token")
    assert by_name["NEG12V"][1:3] == ("POWER_NEGATIVE", -12.0) and by_name["VEE"][1:3] == ("POWER_NEGATIVE", None)
    assert {by_name[n][1] for n in (None, "", "a​b")} == {"UNKNOWN"}
    assert rul.classify_names(df.limit(0), rul.builtin_pack()).collect() == []
    assert {r.final_class for r in rul.classify_names(df, rul.RulePack(())).collect()} == {"UNKNOWN"}


@pytest.fixture
def pack_folder(tmp_path):
    (tmp_path / "manifest.json").write_text(json.dumps({"pack_name": "mine", "files": ["a.csv", "gone.csv", "b.json"], "test_file": "t.csv"}))
    (tmp_path / "defaults.json").write_text(json.dumps({"battery_volts_per_cell_max": 4.1}))
    (tmp_path / "a.csv").write_text("﻿rule_id,priority,enabled,pattern,match_type,match_on,net_class,voltage_v\nr1,700,true,MOT+,exact,normalized,POWER,twelve\nr2,x,no,MOT,prefix,raw,POWER,12\n", encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"rules": [{"rule_id": "r3", "priority": 10, "pattern": "STACK_(?P<cells>\\d+)", "match_type": "regex", "net_class": "BATTERY", "cell_count_from_pattern": True}, {"rule_id": "r4", "priority": 9, "pattern": "(", "match_type": "regex", "net_class": "NOPE"}]}))
    (tmp_path / "extra.csv").write_text("rule_id\n")
    return str(tmp_path)


def test_packs_from_files(spark, pack_folder):
    pack = rul.read_pack(pack_folder)
    assert pack.name == "mine" and pack.missing_files == ("gone.csv",) and pack.unlisted_files == ("extra.csv",)
    problems = rul.pack_problems(pack, NET_CLASSES, MATCH_TYPES)
    assert any("twelve" in p for p in problems) and any("invalid pattern" in p for p in problems) and any("'NOPE'" in p for p in problems)
    got = {r.net_name: (r.matched_rule_id, r.final_voltage_v) for r in rul.classify_names(spark.createDataFrame([("mot",), ("STACK_6",), ("MOTOR",)], "net_name string"), pack).collect()}
    assert got["mot"] == ("r1", None) and got["MOTOR"] == (None, None)
    assert got["STACK_6"][0] == "r3" and got["STACK_6"][1] == pytest.approx(24.6)


def test_patterns_with_any_marks_are_taken_literally(spark):
    from dataclasses import replace

    from sparkgap.operators import rules as rul

    rule = rul.Rule("it's \\ odd", 10, "exact", "raw", "a'b\\c\"d", "POWER", voltage_v=1e-300, reason="x")
    pack = replace(rul.builtin_pack(), rules=(rule, replace(rule, rule_id="inf", pattern="inf", voltage_v=float("inf"))))
    names = spark.createDataFrame([("a'b\\c\"d",), ("inf",), ("a",)], "net_name string")
    got = {r.net_name: (r.matched_rule_id, r.final_voltage_v) for r in rul.classify_names(names, pack).collect()}
    assert got == {"a'b\\c\"d": ("it's \\ odd", 1e-300), "inf": ("inf", float("inf")), "a": (None, None)}
    assert rul.classify_names(names, replace(pack, rules=())).count() == 3
