"""Attributes of source features: tags, voltages, categories, statuses, id lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words of a wind farm's status, the planned ones first, and the marine plan's zone codes by layer.
PLANNED = ("planned", "plan", "proposed", "announced", "application")
BUILT = ("production", "operational", "operation", "construction", "approved", "consented", "commissioning", "built")
MARINE_LAYERS = {"marine_shipping": ("S",), "marine_renewables": ("Ev", "Ei"), "marine_materials": ("R", "N"), "marine_cable_corridor": ("Ek",)}


def tag_value(tags: Column, key: str) -> Column:
    """The value of ``key`` in text of the form ``"key"=>"value",...``; null where it is absent."""
    mark = F.lit(f'"{key}"=>"')
    after = F.substr(tags, F.instr(tags, mark) + len(f'"{key}"=>"'))
    # The value ends at the first quote that no backslash precedes: escaped ones are put out of the way, and back after the cut.
    hidden = F.replace(F.replace(after, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))
    value = F.substring_index(hidden, '"', 1)
    return F.when(F.contains(tags, mark) & F.contains(hidden, F.lit('"')), F.replace(F.replace(value, F.lit("\x02"), F.lit('"')), F.lit("\x01"), F.lit("\\\\")))


def _volts(token: Column) -> Column:
    """Volts of a number with or without a unit; null for anything else."""
    low = F.lower(F.trim(token))
    kilo, plain = low.endswith("kv"), F.rtrim(F.regexp_replace(low, "k?v$", ""))
    number = F.when(plain.rlike(r"^[0-9]+([.][0-9]+)?$"), plain.try_cast("double"))
    return number * F.when(kilo, 1000).otherwise(1)


def voltage_in_volts(value: Column) -> Column:
    """The greatest voltage of a list such as ``132 kV;400000``; null if none can be read."""
    return F.array_max(F.transform(F.split(F.replace(value, F.lit(","), F.lit(";")), ";"), _volts))


def wind_farm_category(status: Column) -> Column:
    """``planned`` or ``barrier``; an unknown status is an error."""
    says = lambda words: F.lower(F.trim(status)).rlike("|".join(words))
    return F.when(says(PLANNED), "planned").when(says(BUILT), "barrier").otherwise(F.raise_error(F.concat(F.lit("unclassified wind-farm status: "), F.coalesce(status, F.lit("null")))))


def marine_layer(zone: Column) -> Column:
    """The layer of a marine plan zone; null for zones of no layer."""
    return F.coalesce(*(F.when(zone.isin(*codes), layer) for layer, codes in MARINE_LAYERS.items()))


def id_list(value: Column) -> Column:
    """The ids of a list such as ``way/101,202``; anything else in it is an error."""
    item = lambda t: F.when(t.rlike(r"^(way/)?\d+$"), F.regexp_extract(t, r"(\d+)$", 1)).otherwise(F.raise_error(F.concat(F.lit("invalid id: "), t)))
    return F.array_sort(F.array_distinct(F.transform(F.split(value, ","), lambda t: item(F.trim(t)))))


def optional_amount(value: Column) -> Column:
    """A finite number of zero or more; null if blank; an error otherwise."""
    number = F.trim(value).try_cast("double")
    fine = number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number < float("inf"))
    return F.when(value.isNull() | (F.trim(value) == ""), None).when(fine, number).otherwise(F.raise_error(F.concat(F.lit("not an amount: "), value)))
