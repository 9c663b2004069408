from sparkgap.operators.revision_match import match_one_name, match_revisions
from sparkgap.operators.rules import builtin_pack

# Nets that keep their name between the two revisions of the golden set.
KEPT = "+12V 3V3 5V0 ADC_IN1 AGND BAT_4S CANH CANL DC_LINK_800V GND GPIO12 HV400 L1 M12V N1 PGND USB_VBUS VDD_1V8 VREF_2V5".split()
WANT = {(n, n, "exact", None) for n in KEPT} | {
    ("OLD_ONLY_NET", None, "missing", None), ("SIG-A", None, "missing", None), ("SIG.A", None, "missing", None), ("Vsys_Main", None, "missing", None), (None, "NEW_ETH_TX_N", "new", None),
    (None, "NEW_ETH_TX_P", "new", None), ("SENSE-DIV", "SENSE_DIV", "normalized", None), (None, "SIG A", "conflict", None), ("Vsys_Main", "VSYS_MAIN_PWR", "likely_renamed", 75),
    ("MCU_SPI_CLK", "mcu_spi_clk", "case_insensitive", None),
}


def test_golden_table(spark):
    old = spark.createDataFrame([("p", o) for o in {w[0] for w in WANT if w[0]}] + [("p", "GND"), ("p", None), ("q", "GND")], "project string, net_name string")
    new = spark.createDataFrame([("p", n) for n in {w[1] for w in WANT if w[1]}] + [("q", "gnd")], "project string, net_name string")
    out = match_revisions(old, new, builtin_pack(), scope=["project"]).collect()
    assert {(r.old_net, r.new_net, r.match_status, r.match_score) for r in out if r.project == "p"} == WANT and len(out) == len(WANT) + 1
    why = {r.old_net: r.detail for r in out if r.match_status == "missing"}
    assert why == {"OLD_ONLY_NET": "Net not present in current revision", "SIG-A": "Conflict candidate awaiting resolution", "SIG.A": "Conflict candidate awaiting resolution", "Vsys_Main": "Suggested as likely rename"}
    assert [(r.old_net, r.new_net, r.match_status) for r in out if r.project == "q"] == [("GND", "gnd", "case_insensitive")]


def test_an_old_net_is_used_once():
    assert match_one_name(["ab"], ["AB", "Ab"]) == [("ab", "AB", "case_insensitive", ""), (None, "Ab", "unmatched", "")]
    assert match_one_name([], ["x"]) == [(None, "x", "unmatched", "")]


def test_empty(spark):
    none = spark.createDataFrame([], "net_name string")
    assert match_revisions(none, none, builtin_pack()).collect() == []
