import itertools
import json
import random

from sparkgap.operators.schema_drift import cheapest_assignment, consistent_table, edit_script, schema_changes, schema_paths, top_level_changes, tree_of

SCHEMA = "row_id bigint, project_id string, file_no int, payload string, field string"


def test_assignment_is_cheapest():
    rnd = random.Random(2)
    for _ in range(60):
        n, m = rnd.randint(1, 4), rnd.randint(4, 6)
        costs = [[rnd.randint(0, 9) for _ in range(m)] for _ in range(n)]
        got = cheapest_assignment(costs)
        best = min(sum(costs[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert len(set(got)) == n and sum(costs[i][j] for i, j in enumerate(got)) == best


def test_script_with_nested_fields_and_moves():
    old = tree_of([("a", "number"), ("e", "object"), ("e\nx", "leaf"), ("e\ny", "leaf"), ("k", "text")])
    new = tree_of([("b", "text"), ("e", "object"), ("e\nz", "leaf"), ("y", "leaf"), ("k", "list")])
    cost, edits = edit_script(old, new, {("a", "b"): 1.0})
    assert sorted(edits) == sorted([("renamed", "a", "b"), ("retyped", "a", "b"), ("retyped", "k", "k"), ("removed", "e\nx", ""), ("added", "", "e\nz"), ("moved", "e\ny", "y")])
    assert edit_script(old, old, {})[1] == [] and edit_script(old, old, {})[0] == 0


def files(*objects):
    return [(k, "p", no, json.dumps(o) if isinstance(o, dict) else o, "clash") for k, (no, o) in enumerate(objects)]


def test_changes_between_files(spark):
    nets = [f"N{k}" for k in range(8)]
    rows = files(
        *[(1, {"net_name": n, "final_voltage_v": k * 1.5, "waived": "no", "labels": ["a", f"t{k}"], "old": k}) for k, n in enumerate(nets)],
        *[(3, {"net_name": n, "volts": f"{k * 1.5:.2f}", "waived": False, "labels": f"a;t{k}", "note": f"n{k}", "evidence": {"id": k}}) for k, n in enumerate(nets)],
        *[(4, {"net_name": n, "volts": f"{k * 1.5:.2f}", "waived": False, "labels": f"a;t{k}", "evidence": {"id": k, "more": 1}}) for k, n in enumerate(nets)],
        (1, {"net_name": "N0", "final_voltage_v": 0.0, "waived": "no", "labels": ["a", "t0"], "old": 0}), (4, "not json"), (4, "[1]"), (4, None),
    )
    df = spark.createDataFrame(rows, SCHEMA)
    changes = schema_changes(df)
    got = sorted((r.from_file, r.to_file, r.change_kind, r.old_field, r.new_field) for r in changes.collect())
    assert got == sorted([
        (1, 3, "added", "", "evidence"), (1, 3, "added", "", "note"), (1, 3, "removed", "old", ""), (1, 3, "renamed", "final_voltage_v", "volts"), (1, 3, "retyped", "final_voltage_v", "volts"),
        (1, 3, "retyped", "labels", "labels"), (1, 3, "retyped", "waived", "waived"), (3, 4, "added", "", "evidence.more"), (3, 4, "removed", "note", ""),
    ])
    table = consistent_table(df, changes, names={"tags": ("labels",)})
    assert table.filter("net_name is not null").count() == 24
    assert {r.final_voltage_v for r in table.filter("file_no = 4 and net_name = 'N2'").collect()} == {3.0}
    assert {(r.waived, r.tags) for r in table.filter("net_name = 'N2' and file_no = 3").collect()} == {(False, "a;t2")}


def test_unlike_content_is_no_rename_and_empty(spark):
    rows = files(*[(1, {"net_name": f"N{k}", "a": k}) for k in range(5)], *[(2, {"net_name": f"N{k}", "b": k + 100}) for k in range(5)], *[(3, {"net_name": f"N{k}", "b": None}) for k in range(5)])
    got = {(r.change_kind, r.old_field, r.new_field) for r in schema_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("added", "", "b"), ("removed", "a", "")}
    assert schema_changes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_nested_fields_are_renamed_and_retyped_at_any_depth(spark):
    rows = files(
        *[(1, {"net_name": f"N{k}", "evidence": {"score": f"{k}", "who": f"lab {k} b{k}", "deep": {"a": k, "old": {"z": f"z{k}"}}}}) for k in range(6)],
        *[(2, {"net_name": f"N{k}", "evidence": {"score": k, "whom": f"lab {k} b{k}", "deep": {"a": k, "new": {"z": f"z{k}"}}}}) for k in range(6)],
    )
    got = {(r.change_kind, r.old_field, r.new_field, r.nested) for r in schema_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("retyped", "evidence.score", "evidence.score", True), ("renamed", "evidence.who", "evidence.whom", True), ("renamed", "evidence.deep.old", "evidence.deep.new", True)}


def test_moves_are_removed_or_added_at_the_top(spark):
    rows = files(
        *[(1, {"net_name": f"N{k}", "e": {"x": 1}, "score": k * 3, "b": f"b{k}"}) for k in range(6)],
        *[(2, {"net_name": f"N{k}", "e": {"x": 1, "score": k * 3}, "b": f"b{k}"}) for k in range(6)],
        *[(3, {"net_name": f"N{k}", "e": {"x": 1}, "points": k * 3, "b": f"b{k}"}) for k in range(6)],
    )
    changes = schema_changes(spark.createDataFrame(rows, SCHEMA))
    assert {(r.from_file, r.change_kind, r.old_field, r.new_field) for r in changes.collect()} == {(1, "moved", "score", "e.score"), (2, "moved", "e.score", "points")}
    assert {(r.from_file, r.change_kind, r.old_field, r.new_field) for r in top_level_changes(changes).collect()} == {(1, "removed", "score", ""), (2, "added", "", "points")}


def test_early_files_and_other_projects_get_the_renamed_column(spark):
    volts = lambda p, no, name, more=None: [(0, p, no, json.dumps({"net_name": f"N{k}", name: k * 1.5, **(more or {})}), "x") for k in range(6)]
    rows = volts("p", 1, "foo_v", {"lab": "a"}) + volts("p", 2, "final_voltage_v", {"lab": "a"}) + volts("p", 5, "v_new", {"labor": "a"}) + volts("q", 3, "v_new", {"lab": "a"}) + volts("q", 4, "unheard", {"lab": "b"})
    rows += [(0, "q", 4, '{"net_name": "twice", "a": 1, "a": 2}', "x"), (0, "q", 4, "[]", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    table = consistent_table(df, schema_changes(df)).filter("net_name = 'N3'")
    got = {(r.project_id, r.file_no): (r.final_voltage_v, r.extra) for r in table.collect()}
    assert got == {("p", 1): (4.5, '{"lab":"a"}'), ("p", 2): (4.5, '{"lab":"a"}'), ("p", 5): (4.5, '{"lab":"a"}'), ("q", 3): (4.5, '{"lab":"a"}'), ("q", 4): (4.5, '{"lab":"b"}')}
    assert consistent_table(df, schema_changes(df)).count() == 32


def test_the_one_table_comes_back_from_any_spelling(spark):
    rnd = random.Random(5)
    truth, rows = {}, []
    spellings = {"final_voltage_v": ["final_voltage_v", "u", "v,x"], "galvanic_zone": ["galvanic_zone", "zone", "z 'o"], "notes": ["notes", "re\nmark"]}
    for p in range(4):
        names = {t: rnd.choice(s) for t, s in spellings.items()}
        for no in range(1, 8):
            changing = rnd.choice(list(spellings))
            names[changing] = spellings[changing][0] if no == 3 else rnd.choice(spellings[changing])
            for k in range(12):
                values = {"final_voltage_v": float(k * 7 + p), "galvanic_zone": f"Zone {k % 5 + 1}", "notes": f"note {k * 31 + p} on {k}"}
                written = {names["final_voltage_v"]: rnd.choice([values["final_voltage_v"], str(values["final_voltage_v"])]), names["galvanic_zone"]: values["galvanic_zone"], names["notes"]: values["notes"]}
                rows.append((0, f"p{p}", no, json.dumps({"net_name": f"N{k}", **written}), "x"))
                truth[f"p{p}", no, f"N{k}"] = tuple(values.values())
    df = spark.createDataFrame(rows, SCHEMA)
    table = consistent_table(df, schema_changes(df))
    assert {(r.project_id, r.file_no, r.net_name): (r.final_voltage_v, r.galvanic_zone, r.notes) for r in table.collect()} == truth


def test_schemas_are_read_with_any_name():
    text = "OBJECT<`a:b<c,`N: N, big: N, e: OBJECT<`q``r`N: ARRAY<VARIANT>, t: STRING>, l: ARRAY<OBJECT<`x>`N: N>>, n: VOID, `x y`N: BOOLEAN>"
    want = [("a:b<c,", "number"), ("big", "number"), ("e", "object"), ("e\nq`r", "list"), ("e\nt", "text"), ("l", "list"), ("n", "null"), ("x y", "boolean")]
    assert schema_paths(text) == want
    assert schema_paths("ARRAY<N>") == [] == schema_paths("OBJECT<>")
