import pytest
from pyspark.sql import functions as F

from sparkgap.operators import assignments as asg
from sparkgap.operators import requirements as req

PAIRS = "net_a string, net_b string, effective_max_voltage_v double, final_voltage_v string"
NETS = "net_name string, final_voltage_v double, galvanic_zone string, source string"
STORE = [("3V3", 3.3, "1", "rule"), ("ISO_RX", 3.3, "Zone 2", "rule"), ("CELL10", 43.0, "z1", "rule"), ("PRI_12V", 12.0, "galvanic zone 1", "manual"), ("AUX_5V", 5.0, "", "rule"), ("NET_A", 10.0, "zone_1", "imported_exact"), ("NET_B", 21.0, "Zone 1", "rule"), ("NOV", float("nan"), None, None), ("Z3", 1.0, "Zone 3", "rule")]


def test_precedence(spark):
    pairs = [("3V3", "ISO_RX", 1200.0, ""), ("CELL10", "GND", 40.0, ""), ("PRI_12V", "AUX_5V", None, ""), ("NET_A", "NET_B", 11.0, ""), ("NET_A", "gnd", 900.0, ""), ("NOV", "NET_A", 1.0, ""), ("A", "B", 1.0, ""), (None, "GND", 1.0, ""), ("3V3", "Z3", 700.0, "")]
    voltages = req.zone_voltages({"Zone 1": {"Zone 3": 750}})
    out = req.with_compliance(req.pair_requirements(spark.createDataFrame(pairs, PAIRS), spark.createDataFrame(STORE, NETS), voltages)).collect()
    got = {(r.net_a, r.net_b): (r.required_voltage_v, r.requirement_source, r.standard_voltage_status) for r in out}
    assert got == {
        ("3V3", "ISO_RX"): (1000.0, "galvanic_zone", "OK"), ("CELL10", "GND"): (43.0, "rule_guess", "NOK"), ("PRI_12V", "AUX_5V"): (7.0, "manual_override", "UNKNOWN"), ("NET_A", "NET_B"): (11.0, "rule_guess", "OK"),
        ("NET_A", "gnd"): (10.0, "net_class", "OK"), ("NOV", "NET_A"): (None, "unknown", "UNKNOWN"), ("A", "B"): (None, "unknown", "UNKNOWN"), (None, "GND"): (None, "unknown", "UNKNOWN"), ("3V3", "Z3"): (750.0, "galvanic_zone", "NOK"),
    }
    warn = {(r.net_a, r.net_b): r.warning for r in out}
    assert warn["3V3", "ISO_RX"] == "" and warn["PRI_12V", "AUX_5V"] == req.INCOMPLETE
    summary = req.requirement_summary(spark.createDataFrame(out)).first()
    assert (summary.cross_zone_pairs, summary.cross_zone_pass, summary.cross_zone_fail, summary.local_voltage_pairs) == (2, 1, 1, 7)


def test_zone_matrices():
    assert req.zone_voltages({"z1->zone 2": 1500, "Zone 3|4": "x", "1;5": 7})[2, 1] == 1500 and req.zone_voltages({"1;5": 7})[5, 1] == 7
    assert req.zone_voltages({"Zone 1": {"Zone 2": 5}, "Zone 2": {"Zone 1": 6}})[1, 2] == 6
    assert req.zone_voltages([[0, 9], [8, 0]])[2, 1] == 9 and req.zone_voltages(None, -3)[1, 2] == 1000 and req.zone_voltages(None)[4, 4] == 0


def test_reviews_differences_merges_and_replay(spark):
    schema = "net string, final_class string, final_voltage_v double, review_state string, source string, severity string"
    old = spark.createDataFrame([("a", "GND", 0.0, "Approved", "manual", "Info"), ("b", "POWER", None, "Imported", "rule", "Critical"), ("c", "POWER", 1.0, "Needs review", "rule", None)], schema)
    new = spark.createDataFrame([("a", "POWER", 0.0, "Approved", "rule", "Info"), ("b", "POWER", float("nan"), "Waived", "rule", "Critical"), ("d", None, None, None, None, None)], schema)
    assert {r.net: r.category for r in asg.assignment_difference(old, new, ["net"]).collect()} == {"a": "class_changed", "b": "review_state_changed", "c": "deleted", "d": "added"}
    merged = {r.net: (r.final_class, r.source, r.changed) for r in asg.merge_detected(old, new, ["net"], ["final_class"]).collect()}
    assert merged == {"a": ("GND", "manual", False), "b": ("POWER", "rule", False), "c": ("POWER", "rule", False), "d": (None, None, True)}
    counts = asg.review_counts(old).first()
    assert (counts.needs_review, counts.unreviewed_critical) == (2, 1)
    assert {r.net for r in asg.batch_preview(old, "approve").filter("blocked").collect()} == {"b"}
    assert asg.batch_preview(old, "waive").filter("new_review_state = 'Waived'").count() == 3 and asg.batch_preview(old, "?").filter("blocked").count() == 3
    log = spark.createDataFrame([(1, "a", "X", False), (2, "c", None, True), (3, "a", "Y", False)], "seq bigint, net string, final_class string, deleted boolean")
    assert {r.net: r.final_class for r in asg.replay(old, log, ["net"], ["final_class"]).collect()} == {"a": "Y", "b": "POWER"}
    assert {r.net: r.final_class for r in asg.replay(old, log, ["net"], ["final_class"], upto=1).collect()} == {"a": "X", "b": "POWER", "c": "POWER"}
    assert req.zone_counts(old.withColumn("net_name", F.col("net")).withColumn("galvanic_zone", F.lit("z2"))).filter("n_nets > 0").first().zone == "Zone 2"


@pytest.mark.parametrize("column, bad", [("final_class", "X"), ("confidence", None), ("severity", "info"), ("review_state", "")])
def test_validity(spark, column, bad):
    good = {"final_class": "GND", "confidence": "High", "severity": "Info", "review_state": "Approved"} | {column: bad}
    assert spark.createDataFrame([tuple(good.values())], ", ".join(f"{c} string" for c in good)).select(asg.validity_problem().alias("p")).first().p == column


def test_pairs_of_the_tables_meet_their_assignments(spark):
    """Every source and status occurs, so the SQL's agreement means something."""
    import os

    import pytest

    from sparkgap.plans.boards import assigned_pair_requirement

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    seen = assigned_pair_requirement(spark, folder).select("requirement_source", "standard_voltage_status").distinct().collect()
    assert {r[0] for r in seen} == {"galvanic_zone", "manual_override", "rule_guess", "net_class", "unknown"}
    assert {r[1] for r in seen} == {"OK", "NOK", "UNKNOWN"} == {r[1] for r in seen if r[0] == "galvanic_zone"}
