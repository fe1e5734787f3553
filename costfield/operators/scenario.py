"""Scenarios of a model as plain documents: the default of some rules, what a stored one means for other rules, what two differ in, presets, and the model's answers.

A scenario has ``version``, ``name``, ``params`` (base costs, the band's factor, the computed classes), ``layers`` (treatment and weight of each),
``groups`` (their rule) and ``sites`` (role, cell, whether it counts). It holds settings only; data stay in tables.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import dataclass, replace
from numbers import Real

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costfield.operators import cost, network, paths
from costfield.operators.cost import Rules
from costfield.sources.config import differences

VERSION = 1
TREATMENTS, GROUP_RULES = ("cost", "barrier", "ignore"), ("max", "sum")
#: The weight that a barrier starts with where a scenario makes it a cost.
BARRIER_WEIGHT = 10.0


def default_scenario(rules: Rules, sites: list[dict] | None = None, name: str = "default") -> dict:
    """The scenario that changes nothing."""
    layers = {x.name: {"treatment": x.kind if x.kind in ("barrier", "ignore") else "cost", "weight": x.score or BARRIER_WEIGHT} for x in rules.layers}
    params = {
        "land": rules.base["land"], "sea": rules.base["sea"], "band": rules.band[3], "near": {"enabled": "near" not in rules.off, "score": rules.near[0], "metres": rules.near[1]},
        "population": {"enabled": "population" not in rules.off, "low": rules.population[0], "high": rules.population[1]}, "risk": {"enabled": "risk" not in rules.off, "threshold": rules.risk[1], "high": rules.risk[2]},
    }
    groups = {g: {"rule": rules.group_rule.get(g, "max")} for g in [*dict.fromkeys(x.group for x in rules.layers if x.group), *rules.deferred]}
    return {"version": VERSION, "name": name, "params": params, "layers": layers, "groups": groups, "sites": {str(s["site"]): {"enabled": True} | {k: s[k] for k in ("role", "r", "c")} for s in sites or []}}


def reconciled(stored: object, default: dict) -> tuple[dict, list[str]]:
    """A stored scenario over the default of today's rules, and notes on what didn't fit: known settings with values of their kind are kept, others are noted."""
    out, notes = copy.deepcopy(default), []
    if not isinstance(stored, dict):
        return out, ["not a scenario"]
    if stored.get("version") != VERSION:
        notes.append(f"version {stored.get('version')} instead of {VERSION}: settings are matched by name")
    if isinstance(stored.get("name"), str) and stored["name"]:
        out["name"] = stored["name"]

    def take(into: dict, given: object, at: str) -> None:
        for key, value in given.items() if isinstance(given, dict) else ():
            where = f"{at}.{key}"
            if key not in into and at != "sites":
                notes.append(f"{where} is no setting of this model")
            elif at == "sites" and isinstance(value, dict) and key not in into:
                if {"role", "r", "c"} <= value.keys():
                    into[key] = {"enabled": True} | value
                else:
                    notes.append(f"{where} has no role or place")
            elif isinstance(into[key], dict):
                take(into[key], value, where)
            elif isinstance(into[key], bool) != isinstance(value, bool) or isinstance(into[key], Real) and not (isinstance(value, Real) and abs(value) < float("inf")) or isinstance(into[key], str) and not isinstance(value, str):
                notes.append(f"{where} can't be {value!r}")
            elif key == "treatment" and value not in TREATMENTS or key == "rule" and value not in GROUP_RULES:
                notes.append(f"{where} can't be {value!r}")
            else:
                into[key] = value

    for part in ("params", "layers", "groups", "sites"):
        take(out[part], stored.get(part), part)
    return out, notes


def described(scenario: dict, default: dict) -> list[str]:
    """What the scenario changes, a line each."""
    said = lambda v: "nothing" if v is None else v
    return [f"{key}: {said(old)} -> {said(new)}" for part in ("params", "layers", "groups", "sites") for key, old, new in differences(default[part], scenario[part], f"{part}.")]


def rules_of(scenario: dict, rules: Rules) -> Rules:
    """The rules under the scenario."""
    p = scenario["params"]
    kinds = {x.name: x.kind for x in rules.layers}
    treatments = {k: (v["treatment"], v["weight"]) for k, v in scenario["layers"].items() if not (v["treatment"] == "cost" and v["weight"] == 0)}
    treatments |= {k: ("ignore", 0.0) for k, v in scenario["layers"].items() if v["treatment"] == "cost" and v["weight"] == 0 and kinds[k] != "barrier"}
    out = cost.treated(rules, treatments, {g: v["rule"] for g, v in scenario["groups"].items()})
    off = {k for k in ("near", "population", "risk") if not p[k]["enabled"]} | ({"band"} if p["band"] == 1 else set())
    return replace(
        out, base={"land": p["land"], "sea": p["sea"]}, band=(*rules.band[:3], p["band"], rules.band[4]), near=(p["near"]["score"], p["near"]["metres"]), off=frozenset(off),
        population=(p["population"]["low"], p["population"]["high"], *rules.population[2:]), risk=(rules.risk[0], p["risk"]["threshold"], p["risk"]["high"], rules.risk[3]),
    )


def presets(default: dict, layers: dict[str, tuple[list[str], str, float]] | None = None, without: dict[str, list[str]] | None = None) -> dict[str, dict]:
    """Scenarios to try, by name: cheaper and dearer sea, people's risk off and doubled, a stronger band, groups that add up.

    ``layers`` adds one each that treats some layers otherwise (names, treatment, weight), ``without`` one each without some sites.
    """
    out: dict[str, dict] = {}

    def preset(name: str) -> dict:
        return out.setdefault(name, copy.deepcopy(default) | {"name": name})

    land = default["params"]["land"]
    preset("cheap sea")["params"]["sea"] = land
    preset("dear sea")["params"]["sea"] = 3 * land
    preset("no risk")["params"]["risk"]["enabled"] = False
    preset("double risk")["params"]["risk"]["high"] = min(10.0, 2 * default["params"]["risk"]["high"])
    preset("strong band")["params"]["band"] = 0.6
    for group in preset("groups add up")["groups"].values():
        group["rule"] = "sum"
    for name, (names, treatment, weight) in (layers or {}).items():
        preset(name)["layers"].update({k: {"treatment": treatment, "weight": weight} for k in names})
    for name, names in (without or {}).items():
        for k in names:
            preset(name)["sites"][k]["enabled"] = False
    return out


@dataclass
class Model:
    """A model's data and rules, and what it answers under a scenario."""

    cells: DataFrame
    presence: DataFrame
    population: DataFrame
    rules: Rules

    def surface(self, scenario: dict) -> DataFrame:
        return cost.cost_surface(self.cells, self.presence, self.population, rules_of(scenario, self.rules))

    def explain(self, scenario: dict, r: int, c: int) -> DataFrame:
        """The steps of one cell's cost."""
        return cost.explain(self.cells, self.presence, self.population, rules_of(scenario, self.rules)).filter((F.col("r") == r) & (F.col("c") == c))

    def _sites(self, scenario: dict) -> DataFrame:
        rows = [(name, s["role"], s["r"], s["c"]) for name, s in sorted(scenario["sites"].items()) if s["enabled"]]
        return self.cells.sparkSession.createDataFrame(rows, "site string, role string, r int, c int")

    def _searched(self, scenario: dict, limit: int, pairs: Callable[[DataFrame], DataFrame], slack: float = 0.0) -> tuple[DataFrame, DataFrame, DataFrame]:
        grid, sites = self.surface(scenario).select("r", "c", "cost"), self._sites(scenario)
        placed = network.snap(sites, grid, limit)
        wanted = pairs(sites)
        return wanted, placed, paths.accumulate(grid, placed, targets=network.targets(wanted, placed), slack=slack)

    def run(self, scenario: dict, limit: int = 3) -> DataFrame:
        """The routed storages of each source by cost, of the sites within ``limit`` cells of one that can be entered."""
        pairs, placed, acc = self._searched(scenario, limit, network.route_pairs)
        return network.ranked(network.pair_costs(acc, pairs, placed))

    def corridor(self, scenario: dict, a: str, b: str, tolerances: list[float], limit: int = 3) -> DataFrame:
        """The cells of the corridor between two sites, with the number of the narrowest tolerance that holds them."""
        pair = self.cells.sparkSession.createDataFrame([(a, b)], "from_id string, to_id string")
        both = pair.union(pair.select("to_id", "from_id"))
        _, placed, acc = self._searched(scenario | {"sites": {k: scenario["sites"][k] for k in (a, b)}}, limit, lambda _: both, max(tolerances))
        return network.corridors(acc, network.pair_costs(acc, pair, placed), tolerances)


def changed_best(before: DataFrame, after: DataFrame) -> DataFrame:
    """(from_id, old, new): sources whose best storage differs between two runs; null where there is none."""
    one = lambda df, name: df.filter("best").select("from_id", F.col("to_id").alias(name))
    return one(before, "old").join(one(after, "new"), "from_id", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
