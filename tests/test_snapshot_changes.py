import pandas as pd

from sparkgap.operators.snapshot_changes import merge_ranges, snapshot_changes

SCHEMA = (
    "project_id string, rev_no int, row_id bigint, net_name string, final_class string, final_voltage_v double, review_state string, galvanic_zone string,"
    " loaded_at timestamp, key string"
)


def row(project, rev, rid, net, cls="GND", v=1.0, state="Approved", zone=None):
    return (project, rev, rid, net, cls, v, state, zone, None, "extra")


def found(spark, rows):
    out = snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((r.project_id or "", r.from_rev, r.to_rev, r.old_net, r.new_net, r.match_status, tuple(r.changed_fields)) for r in out)


def test_kinds_of_change_over_skipped_revisions(spark):
    rows = [
        row("p", 1, 1, "A-B"), row("p", 1, 2, "same", v=None), row("p", 1, 3, "gone"), row("p", 1, 4, "Ｃ１"), row("p", 1, 5, "V", v=5.0), row("p", 1, 6, "Z", zone="Zone 2"),
        row("p", 4, 7, "a_b"), row("p", 4, 8, "same", v=float("nan")), row("p", 4, 9, "C1", state="Waived"), row("p", 4, 10, "V", v=5.0000005), row("p", 4, 11, "Z", zone=" z2"),
        row("p", 4, 12, "fresh"), row("p", 4, 13, "fresh"), row("p", 6, 14, "fresh"), row("q", 2, 15, "lone"), row("p", None, 16, "nowhere"),
    ]
    assert found(spark, rows) == [
        ("p", 1, 4, "", "fresh", "new", ()), ("p", 1, 4, "A-B", "a_b", "respelled", ()), ("p", 1, 4, "gone", "", "missing", ()), ("p", 1, 4, "Ｃ１", "C1", "changed", ("review_state",)),
        ("p", 4, 6, "C1", "", "missing", ()), ("p", 4, 6, "V", "", "missing", ()), ("p", 4, 6, "Z", "", "missing", ()), ("p", 4, 6, "a_b", "", "missing", ()), ("p", 4, 6, "same", "", "missing", ()),
    ]


def test_null_names_and_projects_and_empty(spark):
    rows = [row(None, 1, 1, None), row(None, 2, 3, None, cls=None), row(None, 2, 2, "")]
    assert found(spark, rows) == [("", 1, 2, "", "", "changed", ("final_class",))]
    assert found(spark, []) == []


def test_merge_over_any_batch_borders():
    keys = ["a", "a", "a", "b", "c", "c", "d"]
    sides = [0, 0, 1, 1, 0, 1, 0]
    whole = pd.DataFrame(
        {"project_id": "p", "from_rev": 1, "to_rev": 2, "side": sides, "key": keys, "net": [k + str(s) for k, s in zip(keys, sides)], "final_class": "x", "final_voltage_v": None,
         "review_state": "s", "galvanic_zone": "", "row_id": range(7)}
    )
    want = None
    for size in (1, 2, 3, 7):
        parts = [whole.iloc[i : i + size].reset_index(drop=True) for i in range(0, 7, size)]
        got = pd.concat(list(merge_ranges(iter(parts))), ignore_index=True)[["old_net", "new_net", "match_status"]].values.tolist()
        want = want or got
        assert got == want == [["a0", "a1", "respelled"], ["", "b1", "new"], ["c0", "c1", "respelled"], ["d0", "", "missing"]]
