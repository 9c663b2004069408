from pyspark.sql import functions as F

from sparkgap import cli
from sparkgap.operators import measurements as mea

MEASURED = "measurement_id bigint, job_id string, layer string, clearance_mm double, effective_max_voltage_v double, ipc2221a_max_voltage_v double"
STACK = ("F.Cu", "IN1.CU", " in2.cu ", "IN10.CU", "B.CU")


def test_measured_inner_layers_count_as_internal(spark):
    rows = [(k, "four", layer, 0.3, None, None) for k, layer in enumerate(STACK)] + [(9, "one", "IN1.CU", 0.3, None, None), (10, "four", "IN1.CU", None, None, None)]
    m = spark.createDataFrame(rows, MEASURED)
    new = mea.recomputed_voltages(m, roles=mea.measured_layer_roles(m), pollution=3, altitude_m=1000.0, particle_mm=0.05)
    got = {r.measurement_id: (r.layer_role, r.ipc2221a_max_voltage_v) for r in new.collect()}
    assert got == {0: ("external", 30.0), 1: ("internal", 520.0), 2: ("internal", 520.0), 3: ("internal", 520.0), 4: ("external", 30.0), 9: ("external", 30.0), 10: ("internal", None)}


def test_roles_from_the_archives_stack_up(spark):
    layers = [("j", name, k, "SIGNAL", "BOARD", None, None) for k, name in enumerate(("art1", "art2", "art3", "art4"))] + [("j", "drill", None, "DRILL", "BOARD", "art1", "art4")]
    roles = cli.stack_roles(spark.createDataFrame(layers, "job_id string, layer string, ordinal int, type string, context string, start_layer string, end_layer string"))
    assert {(r.layer, r.layer_role) for r in roles.collect()} == {("ART1", "external"), ("ART2", "internal"), ("ART3", "internal"), ("ART4", "external")}
    m = spark.createDataFrame([(1, "j", "ART2", 0.3, None, None), (2, "j", "ELSE", 0.3, None, None)], MEASURED)
    assert {r.layer: r.layer_role for r in mea.recomputed_voltages(m, roles=roles).select("layer", F.col("layer_role")).collect()} == {"ART2": "internal", "ELSE": "external"}
