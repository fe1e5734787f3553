"""Predicates on features, and how scores read."""

from pyspark.sql import functions as F

from costfield.functions import predicates
from costfield.operators.cost import Layer, Rules


def test_predicates(spark):
    rows = spark.createDataFrame([("Gas ; oil", "osd", "wetland_peat", 1.0), ("biogas,water", " Od ", "wood", 9.0), (None, None, None, None), ("oil, GAS", "x", "a_wetland", 3.0)], "s string, k string, f string, x double")
    got = rows.select(predicates.has_token(F.col("s"), "gas"), predicates.category(F.col("k"), {"strict": ["OSD"], "other": ["od"]}), predicates.like_any(F.col("f"), ["wetland%", "%oo%"])).collect()
    assert [tuple(x) for x in got] == [(True, "strict", True), (False, "other", True), (False, None, False), (True, None, False)]
    box = rows.filter(predicates.meets_box((F.col("x"), F.col("x"), F.col("x") + 1, F.col("x") + 1), (2.0, 2.0, 3.0, 3.0)))
    assert sorted(x.x for x in box.collect()) == [1.0, 3.0]


def test_labels_of_scores():
    layers = [Layer("wall", "barrier"), Layer("a", "add", 4, bit=1), Layer("b", "add", 2.5, bit=1), Layer("cable", "discount", 1), Layer("gone", "ignore", 3), Layer("c", "group", 6, "g")]
    rules = Rules(layers=layers, band=("a", 50.0, 200.0, 0.8, 0.4), near=(6.0, 300.0), population=(1.0, 3.0, 4, 1.0), risk=(200.0, 50.0, 5.0, 4), off=frozenset(["population"]))
    assert predicates.score_labels(rules) == {"wall": "barrier", "a": "2.5–4", "b": "2.5–4", "cable": "−1", "gone": "", "c": "6", "near": "0–6", "band": "×0.8", "population": "", "risk": "0–5"}
