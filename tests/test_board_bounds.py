from sparkgap.plans import boards


def test_bounds_hold_pads_of_every_kind_and_tracks(spark, tmp_path):
    schema = "feature_id bigint, job_id string, layer string, kind string, polarity string, symbol_name string, net_name string, x double, y double, x2 double, y2 double, rotation_deg double"
    rows = [
        (1, "j", "L1", "P", "P", "r1000", "A", 0.0, 0.0, None, None, 0.0), (2, "j", "L1", "P", "P", "rect4000x2000", "A", 10.0, 0.0, None, None, 90.0),
        (3, "j", "L1", "L", "P", "r200", "A", -5.0, 1.0, 3.0, 7.0, None), (4, "j", " l2", "L", "P", "r200", "A", 0.0, 0.0, 1.0, 0.0, None),
        (5, "j", "L3", "P", "P", "r200", "A", float("nan"), 0.0, None, None, None),
    ]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "features.parquet"))
    got = {r.layer: tuple(r)[2:] for r in boards.board_bounds(spark, str(tmp_path)).collect()}
    assert got["L1"] == (-5.1, -2.0, 11.0, 7.1) and got["L2"] == (-0.1, -0.1, 1.1, 0.1) and set(got) <= {"L1", "L2"}
