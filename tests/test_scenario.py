"""Scenarios: defaults, stored ones over other rules, differences, presets, and the model's answers."""

import copy
import json

import pytest

from costfield.operators import cost, scenario

CELLS = "r int, c int, surface string, building boolean"
RULES = cost.Rules(
    layers=[cost.Layer("wall", "barrier"), cost.Layer("forest", "group", 4, "green"), cost.Layer("nature", "group", 6, "green"), cost.Layer("cable", "discount", 1)],
    band=("cable", 100.0, 100.0, 0.8, 0.5), near=(2.0, 150.0), risk=(100.0, 6.0, 5.0, 2), deferred={"people": ("population", "risk")},
)
SITES = [{"site": "a", "role": "source", "r": 0, "c": 0}, {"site": "x", "role": "storage", "r": 4, "c": 0}, {"site": "y", "role": "storage", "r": 4, "c": 5}]


@pytest.fixture(scope="module")
def model(spark):
    cells = spark.createDataFrame([(r, c, "sea" if c > 3 else "land", (r, c) == (2, 3)) for r in range(5) for c in range(6)], CELLS)
    presence = spark.createDataFrame([("wall", 2, c) for c in (0, 1)] + [("forest", 3, c) for c in range(3)] + [("nature", 3, 1), ("cable", 1, 1)], "layer string, r int, c int")
    people = spark.createDataFrame([(r, c, float(1 + r + c)) for r in range(5) for c in range(4)], "r int, c int, people double")
    return scenario.Model(cells, presence, people, RULES)


def test_the_default_changes_nothing(model):
    default = scenario.default_scenario(RULES, SITES)
    assert scenario.described(default, default) == []
    assert scenario.reconciled(json.loads(json.dumps(default)), default) == (default, [])
    plain = {(x.r, x.c): x.cost for x in cost.cost_surface(model.cells, model.presence, model.population, RULES).collect()}
    assert {(x.r, x.c): x.cost for x in model.surface(default).collect()} == plain


def test_stored_scenarios_over_other_rules():
    default = scenario.default_scenario(RULES, SITES)
    stored = copy.deepcopy(default) | {"version": 0, "name": "mine"}
    stored["params"] |= {"sea": 5, "band": "x", "gone": 1}
    stored["params"]["risk"] = {"enabled": 1, "high": 4.0}
    stored["layers"] = {"forest": {"treatment": "barrier", "weight": float("inf")}, "old": {"treatment": "cost"}, "wall": {"treatment": "wish"}}
    stored["groups"] = {"green": {"rule": "sum"}}
    stored["sites"] = {"b": {"role": "source", "r": 1, "c": 1}, "x": {"enabled": False}, "z": {"role": "source"}}
    got, notes = scenario.reconciled(stored, default)
    assert got["name"] == "mine" and got["params"]["sea"] == 5 and got["params"]["band"] == 0.8 and got["params"]["risk"] == {"enabled": True, "threshold": 6.0, "high": 4.0}
    assert got["layers"]["forest"] == {"treatment": "barrier", "weight": 4} and got["layers"]["wall"]["treatment"] == "barrier" and "old" not in got["layers"]
    assert got["sites"]["b"]["enabled"] and not got["sites"]["x"]["enabled"] and "z" not in got["sites"]
    assert len(notes) == 8 and scenario.reconciled([1], default) == (default, ["not a scenario"])
    assert set(scenario.described(got, default)) == {"params.sea: 2.0 -> 5", "params.risk.high: 5.0 -> 4.0", "layers.forest.treatment: cost -> barrier", "groups.green.rule: max -> sum", "sites.b: nothing -> {'enabled': True, 'role': 'source', 'r': 1, 'c': 1}", "sites.x.enabled: True -> False"}


def test_presets(model):
    default = scenario.default_scenario(RULES, SITES)
    found = scenario.presets(default, {"no walls": (["wall"], "ignore", 0.0)}, {"x only": ["y"]})
    assert len(found) == 8 and all(len(scenario.described(s, default)) >= 1 for s in found.values())
    assert scenario.rules_of(found["no risk"], RULES).off == {"risk"} and scenario.rules_of(found["groups add up"], RULES).group_rule["green"] == "sum"
    base = {(x.r, x.c): x.cost for x in model.surface(default).collect()}
    calm = {(x.r, x.c): x.cost for x in model.surface(found["no risk"]).collect()}
    assert all(calm[k] is None if v is None else calm[k] <= v for k, v in base.items()) and calm != base
    open_ = {(x.r, x.c): x.cost for x in model.surface(found["no walls"]).collect()}
    assert base[2, 0] is None and open_[2, 0] is not None


def test_answers_of_a_model(model):
    default = scenario.default_scenario(RULES, SITES)
    found = scenario.presets(default, {"no walls": (["wall"], "ignore", 0.0)}, {"y only": ["x"]})
    before = model.run(default)
    rows = before.orderBy("rank").collect()
    assert [x.rank for x in rows] == [1, 2] and rows[0].best and rows[0].cost <= rows[1].cost
    assert [tuple(x) for x in scenario.changed_best(before, model.run(found["y only"])).collect()] == ([] if rows[0].to_id == "y" else [("a", "x", "y")])
    assert scenario.changed_best(before, before).isEmpty()
    steps = model.explain(default, 3, 1).orderBy("step").collect()
    assert steps[0].label == "base" and {x.label: x.value for x in steps}["green"] == 6.0
    assert [x.label for x in model.explain(default, 2, 0).collect()] == ["wall"]
    cells = {(x.r, x.c): x.band for x in model.corridor(default, "a", "y", [0.0, 0.2]).collect()}
    assert cells[0, 0] == 0 and cells[4, 5] == 0 and set(cells.values()) == {0, 1}
