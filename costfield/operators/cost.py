"""The additive cost of cells: base, barriers, highest-only groups, ordered additions and discounts, decay, bands, scales."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costfield.functions.scales import interpolate, quantile_scale
from costfield.operators.distance import distance_transform
from costfield.operators.raster import focal_sum
from costfield.shared import materialise


@dataclass
class Layer:
    """A layer's rule. ``kind``: barrier, group (the highest score of ``group`` counts), add, discount or ignore; ``weight`` 0 ignores it too.

    Layers of one cost ``key`` (by default, the layer's name) count once, with the highest score that is present.
    A layer that isn't ``optional`` must be in the data.
    """

    name: str
    kind: str
    score: float = 0.0
    group: str = ""
    surface: str = "any"
    bit: int = 0
    weight: float = 1.0
    key: str = ""
    optional: bool = False

    @property
    def cost_key(self) -> str:
        return self.key or self.name


@dataclass
class Rules:
    layers: list[Layer]
    base: dict[str, float] = field(default_factory=lambda: {"land": 1.0, "sea": 2.0})
    size: float = 100.0
    reference: float = 100.0
    group_rule: dict[str, str] = field(default_factory=dict)
    near: tuple[float, float] = (6.0, 300.0)
    near_factor: float = 1.0
    band: tuple[str, float, float, float, float] = ("", 0.0, 0.0, 1.0, 0.0)
    population: tuple[float, float, int, float] = (1.0, 3.0, 4, 1.0)
    risk: tuple[float, float, float, int] = (200.0, 0.0, 5.0, 4)
    #: Class bits of what is computed, by its name in ``DYNAMIC``.
    bits: dict[str, int] = field(default_factory=dict)
    #: Computed classes (of ``DYNAMIC``) that are switched off.
    off: frozenset[str] = frozenset()
    #: Scores are above the lowest, and the highest at most.
    lowest: float = 0.0
    highest: float = 10.0
    #: Groups of which the highest value counts after all else: of computed values and of the layers of that group.
    deferred: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"people": ("population", "risk")})

    @property
    def scale(self) -> float:
        return self.size / self.reference


#: What is computed from buildings, layers and people, rather than given as a layer.
DYNAMIC = ("near", "band", "population", "risk")


def check_rules(rules: Rules) -> None:
    """Scores within range, groups of two members at least, class bits that are different powers of two, known members of deferred groups, each in one."""
    bits = [x.bit for x in rules.layers if x.bit] + [b for b in rules.bits.values() if b]
    members = [m for group in rules.deferred.values() for m in group]
    if len(set(members)) < len(members) or not set(members) <= {"near", "population", "risk"} or not set(rules.bits) <= set(DYNAMIC):
        raise ValueError(f"unknown or repeated computed classes: {members}, {sorted(rules.bits)}")
    if rules.population[0] > rules.population[1] or rules.risk[2] <= 0:
        raise ValueError("the population scale must not fall, and the risk scale must rise")
    if len(set(bits)) < len(bits) or any(b <= 0 or b & (b - 1) for b in bits):
        raise ValueError("class bits must be different powers of two")
    if not 0 < rules.band[3] <= 1:
        raise ValueError("the band's factor must be above 0 and 1 at most")
    groups: dict[str, set[str]] = {g: set(members) for g, members in rules.deferred.items()}
    place: dict[str, tuple[str, str]] = {}
    for layer in rules.layers:
        if layer.kind not in ("barrier", "group", "add", "discount", "ignore"):
            raise ValueError(f"unknown kind of layer {layer.name}: {layer.kind}")
        if layer.surface not in ("any", "land"):
            raise ValueError(f"unknown surface of layer {layer.name}: {layer.surface}")
        if layer.group and layer.kind != "add":
            groups.setdefault(layer.group, set()).add(layer.cost_key)  # a member that a scenario treats otherwise is one still
        if layer.kind in ("barrier", "ignore"):
            continue
        if not rules.lowest < layer.score <= rules.highest:
            raise ValueError(f"score of {layer.name} out of range: {layer.score}")
        if place.setdefault(layer.cost_key, (layer.kind, layer.group)) != (layer.kind, layer.group):
            raise ValueError(f"layers of the cost key {layer.cost_key} differ in their kind or group")
    if small := [g for g, keys in groups.items() if len(keys) < 2]:
        raise ValueError(f"a group needs two members: {small}")


def present_layers(cells: DataFrame, presence: DataFrame, rules: Rules) -> DataFrame:
    """``cells`` (r, c, surface, building, ...) with ``layers``: the numbers, in the rules' order, of the layers that hold there, and class_bits.

    A layer holds on no building, and only on its own surface; where it doesn't hold, it has no bit either. Layers of
    ``presence`` that no rule names are left out; ``unknown_layers`` lists them.
    """
    spark = cells.sparkSession
    table = spark.createDataFrame([(k, x.name) for k, x in enumerate(rules.layers)], "k int, layer string")
    held = presence.join(F.broadcast(table), "layer").groupBy("r", "c").agg(F.collect_set("k").alias("layers"))
    joined = cells.join(held.hint("merge"), ["r", "c"], "left")
    only = {k: x.surface for k, x in enumerate(rules.layers) if x.surface != "any"}
    layers = F.coalesce("layers", F.array().cast("array<int>"))
    for k, surface in only.items():
        layers = F.when(F.col("surface") == surface, layers).otherwise(F.array_remove(layers, k))
    bits = F.array(*(F.lit(x.bit).cast("long") for x in rules.layers)) if rules.layers else F.array().cast("array<long>")
    joined = joined.withColumn("layers", F.when(F.coalesce("building", F.lit(False)), F.array().cast("array<int>")).otherwise(layers))
    return joined.withColumn("class_bits", F.aggregate("layers", F.lit(0).cast("long"), lambda acc, k: acc.bitwiseOR(F.get(bits, k))))


def unknown_layers(presence: DataFrame, rules: Rules, required: list[str] | None = None) -> DataFrame:
    """(problem, layer): layers of ``presence`` that no rule names, and ``required`` ones (all, if none are named) that are nowhere."""
    spark = presence.sparkSession
    have = presence.select("layer").distinct()
    named = spark.createDataFrame([(x.name,) for x in rules.layers], "layer string")
    wanted = spark.createDataFrame([(x,) for x in (required if required is not None else [x.name for x in rules.layers])], "layer string")
    extra = have.join(F.broadcast(named), "layer", "left_anti").select(F.lit("unknown").alias("problem"), "layer")
    return extra.union(wanted.join(have, "layer", "left_anti").select(F.lit("missing").alias("problem"), "layer"))


def check_inputs(cells: DataFrame, presence: DataFrame, population: DataFrame, rules: Rules) -> None:
    """Required layers are in the data, and there are buildings and people where a rule asks for them: else an error names what is missing."""
    required = [x.name for x in rules.layers if not x.optional and x.kind != "ignore" and x.weight > 0]
    missing = sorted(r.layer for r in unknown_layers(presence, rules, required).filter("problem = 'missing'").collect())
    if missing:
        raise ValueError(f"required layers are missing: {missing}")
    if "near" not in rules.off and rules.near[0] > 0 and cells.filter("building").isEmpty():
        raise ValueError("costs near buildings need buildings")
    if "population" not in rules.off and eligible_population(cells, population, rules).isEmpty():
        raise ValueError("the population scale needs inhabited land cells")


def treated(rules: Rules, treatments: dict[str, tuple[str, float]], groups: dict[str, str] | None = None) -> Rules:
    """The rules of a scenario: for some layers (cost, barrier or ignore; the score to have), and for some groups max or sum."""
    if extra := set(treatments) - {x.name for x in rules.layers}:
        raise ValueError(f"unknown layers: {sorted(extra)}")
    layers = []
    for layer in rules.layers:
        treatment, score = treatments.get(layer.name, ("cost" if layer.kind != "barrier" else "barrier", layer.score))
        if treatment not in ("cost", "barrier", "ignore"):
            raise ValueError(f"unknown treatment of {layer.name}: {treatment}")
        kind = {"barrier": "barrier", "ignore": "ignore"}.get(treatment, "add" if layer.kind in ("barrier", "ignore") else layer.kind)
        layers.append(replace(layer, kind=kind, score=score))
    return replace(rules, layers=layers, group_rule=rules.group_rule | (groups or {}))


def has(rules: Rules, k: int) -> Column:
    return F.array_contains("layers", k) & F.lit(rules.layers[k].weight > 0)


def base_cost(rules: Rules) -> Column:
    return F.when(F.col("surface") == "land", rules.base["land"] * rules.scale).otherwise(rules.base["sea"] * rules.scale)


def is_barrier(rules: Rules) -> Column:
    """Buildings, and the layers that are barriers."""
    out = F.coalesce(F.col("building"), F.lit(False))
    for k, layer in enumerate(rules.layers):
        if layer.kind == "barrier":
            out = out | has(rules, k)
    return out


def _keys(rules: Rules, kinds: tuple[str, ...], group: str | None = None) -> dict[str, list[int]]:
    """The numbers of the layers of each cost key, in the rules' order."""
    out: dict[str, list[int]] = {}
    for k, x in enumerate(rules.layers):
        if x.kind in kinds and (group is None or x.group == group):
            out.setdefault(x.cost_key, []).append(k)
    return out


def _key_score(rules: Rules, numbers: list[int]) -> Column:
    """The highest score of a cost key's present layers; null if none is there."""
    scores = [F.when(has(rules, k), rules.layers[k].score * rules.layers[k].weight * rules.scale) for k in numbers]
    return F.greatest(*scores) if len(scores) > 1 else scores[0]


def group_cost(rules: Rules, group: str, more: list[Column] | None = None) -> Column:
    """The highest score of the group's present cost keys (or their sum, where the rule says so), and of ``more``; 0 if none."""
    scores = [F.coalesce(_key_score(rules, numbers), F.lit(0.0)) for numbers in _keys(rules, ("group",), group).values()] + (more or [])
    return sum(scores[1:], scores[0]) if rules.group_rule.get(group) == "sum" else F.greatest(F.lit(0.0), *scores)


@dataclass
class Step:
    """A step of the cost: where it ``holds``, and the cost ``after`` it, from the cost before it. ``score`` is a fixed one, else ``rule`` tells what it depends on."""

    label: str
    kind: str
    holds: Column
    after: Callable[[Column], Column]
    score: float | None = None
    rule: str = ""


def _any(rules: Rules, numbers: list[int]) -> Column:
    return reduce(lambda a, b: a | b, (has(rules, k) for k in numbers), F.lit(False))


def static_steps(rules: Rules) -> list[Step]:
    """Base, groups, then additions and discounts in the layers' order; a discount stops at open land's cost."""
    steps = [Step("base", "base", F.lit(True), lambda _: base_cost(rules))]
    for group in dict.fromkeys(x.group for x in rules.layers if x.kind == "group" and x.group not in rules.deferred):
        members = _keys(rules, ("group",), group)
        steps.append(Step(group, "group", _any(rules, sum(members.values(), [])), lambda cost, g=group: cost + group_cost(rules, g), rule=f"{rules.group_rule.get(group, 'max')}({', '.join(members)})"))
    for key, numbers in _keys(rules, ("add", "discount")).items():
        amount, scores = F.coalesce(_key_score(rules, numbers), F.lit(0.0)), [rules.layers[k].score * rules.layers[k].weight * rules.scale for k in numbers]
        score = None if any(isinstance(x, Column) for x in scores) else max(scores)
        if rules.layers[numbers[0]].kind == "add":
            steps.append(Step(key, "add", _any(rules, numbers), lambda cost, a=amount: cost + a, score))
        else:
            floor = F.lit(rules.base["land"] * rules.scale)
            steps.append(Step(key, "discount", _any(rules, numbers), lambda cost, a=amount, h=_any(rules, numbers): F.greatest(cost - a, F.when(h, floor)), score))
    return steps


def static_cost(rules: Rules) -> Column:
    """The cost after the last static step. Null on barriers."""
    return F.when(~is_barrier(rules), reduce(lambda cost, step: step.after(cost), static_steps(rules), F.lit(0.0)))


def later_steps(rules: Rules) -> list[Step]:
    """What follows the static steps: near buildings, the band, people, and groups that hold any of these."""
    _, _, _, factor, floor = rules.band
    land, zero = F.col("surface") == "land", F.lit(0.0)
    held = {"near": land & F.col("near_cost").isNotNull(), "population": F.col("population_cost").isNotNull(), "risk": F.col("risk_cost").isNotNull()}
    held |= {name: F.lit(False) for name in rules.off & held.keys()}
    value = {name: F.when(held[name], F.col(f"{name}_cost") * (rules.near_factor if name == "near" else 1.0)).otherwise(zero) for name in held}
    together = {m for group in rules.deferred.values() for m in group}
    alone = lambda name, rule: [] if name in together or name in rules.off else [Step(name, "computed", held[name], lambda cost: cost + value[name], rule=rule)]
    steps = alone("near", "distance")
    if rules.band[0] and "band" not in rules.off:
        inside = F.coalesce("in_band", F.lit(False))
        steps.append(Step("band", "factor", inside, lambda cost: F.when(inside, F.greatest(F.lit(floor), cost * factor)).otherwise(cost), rule="factor" if isinstance(factor, Column) else f"factor {factor:g}"))
    steps += alone("population", "quantiles") + alone("risk", "quantiles")
    for group, members in rules.deferred.items():
        keys = _keys(rules, ("group",), group)
        holds = reduce(lambda a, b: a | b, [held[m] for m in members], _any(rules, sum(keys.values(), [])))
        steps.append(Step(group, "group", holds, lambda cost, g=group, ms=members: cost + group_cost(rules, g, [value[m] for m in ms]), rule=f"{rules.group_rule.get(group, 'max')}({', '.join([*members, *keys])})"))
    return steps


def near_buildings(cells: DataFrame, rules: Rules) -> DataFrame:
    """(r, c, near_cost) of the cells nearer to a building than the limit, decaying to nothing there."""
    score, limit = rules.near
    d = F.sqrt("d2") * rules.size
    around = distance_transform(cells.select("r", "c"), cells.filter("building").select("r", "c")).filter((d > 0) & (d < limit))
    return around.select("r", "c", (score * rules.scale * (1 - d / limit)).alias("near_cost"))


def parallel_band(present: DataFrame, rules: Rules) -> DataFrame:
    """Cells (r, c) beside the band's asset layer: at its inner distance at least and its outer at most, and not on it."""
    name, inner, outer, *_ = rules.band
    k = next(i for i, x in enumerate(rules.layers) if x.name == name)
    asset = present.filter(F.array_contains("layers", k)).select("r", "c")
    d = F.sqrt("d2") * rules.size
    return distance_transform(present.select("r", "c"), asset).filter((F.col("d2") > 0) & (d >= inner) & (d <= outer)).select("r", "c")


def eligible_population(cells: DataFrame, population: DataFrame, rules: Rules) -> DataFrame:
    """Land cells without a building that people live on, with ``people``."""
    least = rules.population[3] * rules.scale**2
    return cells.filter("surface = 'land' and not building").select("r", "c").join(population.hint("merge"), ["r", "c"]).filter((F.col("people") > 0) & (F.col("people") >= least))


def population_cost(cells: DataFrame, population: DataFrame, rules: Rules) -> DataFrame:
    low, high, count, _ = rules.population
    who = eligible_population(cells, population, rules)
    scale = quantile_scale(who, "people", low, high, count, low)
    return who.crossJoin(F.broadcast(scale)).select("r", "c", (interpolate(F.col("people"), F.col("xs"), F.col("ys")) * rules.scale).alias("population_cost"))


def risk_cost(cells: DataFrame, population: DataFrame, rules: Rules) -> DataFrame:
    """(r, c, focal, risk_cost) of the land cells with more people around than the threshold."""
    radius, threshold, highest, count = rules.risk
    all_cells = cells.select("r", "c", "surface").join(population.hint("merge"), ["r", "c"], "left")
    around = focal_sum(all_cells, "people", int(radius // rules.size)).join(cells.filter("surface = 'land'").select("r", "c").hint("merge"), ["r", "c"]).filter(F.col("focal") > threshold)
    scale = quantile_scale(around, "focal", 0.0, highest, count, highest)
    return around.crossJoin(F.broadcast(scale)).select("r", "c", "focal", (interpolate(F.col("focal"), F.col("xs"), F.col("ys")) * rules.scale).alias("risk_cost"))


def _prepared(cells: DataFrame, presence: DataFrame, population: DataFrame, rules: Rules) -> DataFrame:
    """Each cell with all that its steps look at."""
    check_rules(rules)
    present = present_layers(cells, presence, rules)
    none = F.lit(None).cast("double")
    parts = {
        "near": (lambda: near_buildings(cells, rules), {"near_cost": none}),
        "band": (lambda: parallel_band(present, rules).withColumn("in_band", F.lit(True)), {"in_band": F.lit(False)}),
        "population": (lambda: population_cost(cells, population, rules), {"population_cost": none}),
        "risk": (lambda: risk_cost(cells, population, rules), {"focal": none, "risk_cost": none}),
    }
    found = present
    for name, (make, absent) in parts.items():
        off = name in rules.off or name == "band" and not rules.band[0]
        found = found.withColumns(absent) if off else found.join(make().hint("merge"), ["r", "c"], "left")
    present = found
    return present.withColumn("barrier", is_barrier(rules))


def stepped(cells: DataFrame, presence: DataFrame, population: DataFrame, rules: Rules) -> tuple[DataFrame, list[Step]]:
    """Each cell with the cost after every step (``after_0``, ``after_1``, ...; null on barriers), and the steps."""
    steps = static_steps(rules) + later_steps(rules)
    present = _prepared(cells, presence, population, rules).withColumn("after_0", F.when(~F.col("barrier"), base_cost(rules)))
    for k, step in enumerate(steps[1:], 1):
        present = present.withColumn(f"after_{k}", F.when(~F.col("barrier"), step.after(F.col(f"after_{k - 1}"))))
    return present, steps


@dataclass
class Scenario:
    """Other scores of some layers, by name, a factor of the costs near buildings, and the band's factor."""

    name: str
    scores: dict[str, float] = field(default_factory=dict)
    near: float = 1.0
    band: float | None = None


def scenario_surfaces(cells: DataFrame, presence: DataFrame, population: DataFrame, rules: Rules, scenarios: list[Scenario], keep: tuple[str, ...] = ()) -> DataFrame:
    """(scenario, r, c, cost) under each scenario, all in one job: layers, distances and people are found once, and the scores are columns.

    Columns ``keep`` of ``cells`` stay. What the steps look at is written once, so readers of a part of the cells or scenarios work out the costs of these alone.
    """
    if extra := {k for s in scenarios for k in s.scores} - {x.name for x in rules.layers}:
        raise ValueError(f"unknown layers: {sorted(extra)}")
    rows = [(s.name, [float(s.scores.get(x.name, x.score)) for x in rules.layers], float(s.near), float(rules.band[3] if s.band is None else s.band)) for s in scenarios]
    table = cells.sparkSession.createDataFrame(rows, "scenario string, scores array<double>, near_factor double, band_factor double")
    layers = [x if x.kind in ("barrier", "ignore") else replace(x, score=F.get("scores", F.lit(k))) for k, x in enumerate(rules.layers)]
    varied = replace(rules, layers=layers, near_factor=F.col("near_factor"), band=(*rules.band[:3], F.col("band_factor"), rules.band[4]))
    cost = reduce(lambda before, step: step.after(before), static_steps(varied) + later_steps(varied), F.lit(0.0))
    prepared = materialise(_prepared(cells, presence, population, rules), "prepared")
    each = prepared.crossJoin(F.broadcast(table))  # as many rows as scenarios were stated
    return each.select("scenario", "r", "c", F.when(~F.col("barrier"), cost).alias("cost"), *keep)


def cost_surface(cells: DataFrame, presence: DataFrame, population: DataFrame, rules: Rules, check: bool = False) -> DataFrame:
    """The whole surface: (r, c, surface, class_bits, cost and its parts). ``cost`` is null where a cell can't be entered. ``check`` asks for all that the rules need first."""
    if check:
        check_inputs(cells, presence, population, rules)
    present, steps = stepped(cells, presence, population, rules)
    static, last = len(static_steps(rules)) - 1, len(steps) - 1
    at = lambda label: next((k for k, s in enumerate(steps) if k > static and s.label == label), None)
    near = static if at("near") is None else at("near")
    banded = near if at("band") is None else at("band")
    there = {"near": (F.col("surface") == "land") & F.col("near_cost").isNotNull(), "band": F.coalesce("in_band", F.lit(False)), "population": F.col("population_cost").isNotNull(), "risk": F.col("risk_cost").isNotNull()}
    bits = F.col("class_bits")
    for name, bit in rules.bits.items():
        bits = bits.bitwiseOR(F.when(there[name] & ~F.col("barrier"), F.lit(bit).cast("long")).otherwise(F.lit(0).cast("long")))
    named = {"static_cost": static, "near_building_cost": near, "band_cost": banded, "cost": last}
    return present.select("r", "c", "surface", bits.alias("class_bits"), *(F.col(f"after_{k}").alias(name) for name, k in named.items()))


def class_statistics(cells: DataFrame, presence: DataFrame, population: DataFrame, rules: Rules) -> DataFrame:
    """(step, label, rule, score, cells, applied_cells, total): what each class has added to the surface, in the order of its steps; one pass over the cells.

    ``cells`` counts where a class is, on barriers too, ``applied_cells`` where its cost counts. ``total`` is the change of the cost that it made: below zero
    for discounts and bands, the sum of the highest scores for groups, null for barriers; but for base costs and plain additions
    cells times score, of all cells but buildings.
    """
    present, steps = stepped(cells, presence, population, rules)
    open_cell = ~F.coalesce(F.col("building"), F.lit(False))
    land = F.col("surface") == "land"
    rows: list[tuple] = [("open_land", "", rules.base["land"] * rules.scale, land & open_cell, None), ("open_sea", "", rules.base["sea"] * rules.scale, ~land & open_cell, None)]
    rows += [(key, "barrier", None, _any(rules, numbers), None) for key, numbers in _keys(rules, ("barrier",)).items()]
    for k, step in enumerate(steps[1:], 1):
        change = F.col(f"after_{k}") - F.col(f"after_{k - 1}")
        holds = step.holds & ~F.col("barrier") if step.kind in ("computed", "factor") else step.holds
        rows.append((step.label, step.rule or ("discount" if step.kind == "discount" else ""), step.score, holds, None if step.kind == "add" else change))
    rows.append(("building", "barrier", None, ~open_cell, None))
    sums, out = [], []
    for k, (label, rule, score, holds, change) in enumerate(rows):
        sums += [F.count_if(holds).alias(f"n{k}"), F.count_if(holds & ~F.col("barrier")).alias(f"m{k}"), F.sum(F.when(holds, change if change is not None else F.lit(0.0))).alias(f"t{k}")]
        total = F.lit(None).cast("double") if rule == "barrier" else F.col(f"n{k}") * F.lit(score) if change is None else F.coalesce(f"t{k}", F.lit(0.0))
        out.append(F.struct(F.lit(k).alias("step"), F.lit(label).alias("label"), F.lit(rule).alias("rule"), F.lit(score).cast("double").alias("score"), F.col(f"n{k}").alias("cells"), F.col(f"m{k}").alias("applied_cells"), total.alias("total")))
    return present.agg(*sums).select(F.explode(F.array(*out)).alias("s")).select("s.*")


def explain(cells: DataFrame, presence: DataFrame, population: DataFrame, rules: Rules) -> DataFrame:
    """(r, c, step, label, value, cost): each step that holds at a cell, with what it changes the cost by and the cost after it.

    A cell that can't be entered has one row: step -1, what blocks it (the building, or else the first barrier in the rules' order), no value and no cost.
    """
    present, steps = stepped(cells, presence, population, rules)
    blocks = [F.when(F.coalesce(F.col("building"), F.lit(False)), "building")] + [F.when(has(rules, k), x.cost_key) for k, x in enumerate(rules.layers) if x.kind == "barrier"]
    none = F.lit(None).cast("double")
    listed = [F.when(F.col("barrier"), F.struct(F.lit(-1).alias("step"), F.coalesce(*blocks).alias("label"), none.alias("value"), none.alias("cost")))]
    for k, step in enumerate(steps):
        before = F.col(f"after_{k - 1}") if k else F.lit(0.0)
        listed.append(F.when(~F.col("barrier") & step.holds, F.struct(F.lit(k).alias("step"), F.lit(step.label).alias("label"), (F.col(f"after_{k}") - before).alias("value"), F.col(f"after_{k}").alias("cost"))))
    return present.select("r", "c", F.explode(F.array_compact(F.array(*listed))).alias("s")).select("r", "c", "s.*")
