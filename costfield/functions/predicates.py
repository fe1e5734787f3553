"""Which features a layer takes: by boxes, by tokens of their values, by categories, by patterns; and how a class's score reads."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from costfield.operators.cost import Rules


def meets_box(extent: tuple[Column, Column, Column, Column], box: tuple[float, float, float, float]) -> Column:
    """Whether extents (low x, low y, high x, high y) meet a box, edges included. Compares columns only, so a Parquet scan prunes by it."""
    return (extent[0] <= box[2]) & (extent[2] >= box[0]) & (extent[1] <= box[3]) & (extent[3] >= box[1])


def has_token(value: Column, token: str) -> Column:
    """Whether one of the parts of ``value`` between semicolons and commas is ``token``, in any case; not for a null."""
    parts = F.transform(F.split(F.replace(value, F.lit(","), F.lit(";")), ";"), lambda p: F.lower(F.trim(p)))
    return F.coalesce(F.array_contains(parts, token.lower()), F.lit(False))


def category(value: Column, layers: dict[str, Iterable[str]]) -> Column:
    """The layer of a category in any case, from the categories of each layer; null for others."""
    said = F.upper(F.trim(value))
    return F.coalesce(*(F.when(said.isin(*(c.upper() for c in names)), layer) for layer, names in layers.items()))


def like_any(value: Column, patterns: Iterable[str]) -> Column:
    """Whether ``value`` matches one of the SQL patterns."""
    return F.coalesce(reduce(lambda a, b: a | b, (value.like(p) for p in patterns), F.lit(False)), F.lit(False))


def score_labels(rules: Rules) -> dict[str, str]:
    """How the score of each layer and computed class reads: a number, a range, ``barrier``, a factor or a discount."""
    out: dict[str, str] = {}
    by_bit: dict[int, list[float]] = {}
    for x in rules.layers:
        by_bit.setdefault(x.bit or id(x), []).append(x.score)
    for x in rules.layers:
        scores = sorted(set(by_bit[x.bit or id(x)]))
        plain = f"{scores[0]:g}" if len(scores) == 1 else f"{scores[0]:g}–{scores[-1]:g}"
        out[x.name] = {"barrier": "barrier", "ignore": "", "discount": f"−{x.score:g}"}.get(x.kind, plain)
    computed = {"near": f"0–{rules.near[0]:g}", "band": f"×{rules.band[3]:g}" if rules.band[0] else "", "population": f"{rules.population[0]:g}–{rules.population[1]:g}", "risk": f"0–{rules.risk[2]:g}"}
    return out | {k: "" if k in rules.off else v for k, v in computed.items()}
