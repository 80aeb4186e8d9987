"""Machine state and elements: layers of values, families of knobs, grouped magnets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def layer_states(states: DataFrame) -> DataFrame:
    """(name, value): of all layers (name, prio, value) the value of the highest priority."""
    return states.groupBy("name").agg(F.max_by("value", "prio").alias("value"))


def corrector_changes(table: DataFrame) -> DataFrame:
    """(name, value) of the kicks that changed: by kind a horizontal, a vertical, or both."""
    h = F.struct(F.concat("name", F.lit(".hkick")).alias("name"), F.col("hkick").alias("value"), (F.col("hkick") != F.col("hkick_old")).alias("changed"))
    v = F.struct(F.concat("name", F.lit(".vkick")).alias("name"), F.col("vkick").alias("value"), (F.col("vkick") != F.col("vkick_old")).alias("changed"))
    kicks = F.when(F.col("kind") == "hkicker", F.array(h)).when(F.col("kind") == "vkicker", F.array(v)).when(F.col("kind") == "tkicker", F.array(h, v))
    return table.select(F.inline(kicks)).where("changed").select("name", "value")


def family_prior(diagonal: DataFrame, strengths: DataFrame) -> DataFrame:
    """(family, alpha): strength times the median of the family's positive diagonal entries, 0 without any.

    Families of knobs and of strengths must be the same; either side alone is an error.
    """
    medians = diagonal.groupBy("family").agg(F.median(F.when(F.col("value") > 0, F.col("value"))).alias("median"))
    both = medians.withColumn("k", F.lit(1)).join(strengths, "family", "full")
    alone = F.col("k").isNull() | F.col("strength").isNull()
    checked = F.when(alone, F.raise_error(F.concat(F.lit("prior and knobs differ in "), F.col("family"))).cast("double"))
    return both.select("family", checked.otherwise(F.coalesce("median", F.lit(0.0)) * F.col("strength")).alias("alpha"))


def length_weighted(elements: DataFrame, group: Column, strength: str, length: str) -> DataFrame:
    """(group, strength, n): mean strength by length of each group; 0 if its length is 0."""
    sums = elements.groupBy(group.alias("group")).agg(
        F.sum(F.col(strength) * F.col(length)).alias("kl"), F.sum(length).alias("l"), F.count("*").alias("n")
    )
    return sums.select("group", F.coalesce(F.try_divide("kl", "l"), F.lit(0.0)).alias("strength"), "n")


def collapse_pairs(elements: DataFrame, cell: str, value: str, rtol: float = 1e-12, atol: float = 1e-15) -> DataFrame:
    """(cell, value) of cells of exactly two equal members; anything else is an error."""
    pairs = elements.groupBy(cell).agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    same = (F.col("n") == 2) & (F.col("high") - F.col("low") <= atol + rtol * F.abs("low"))
    bad = F.raise_error(F.concat(F.lit("members differ in "), F.col(cell).cast("string"))).cast("double")
    return pairs.select(cell, F.when(same, F.col("low")).otherwise(bad).alias(value))


def expand_groups(groups: DataFrame, members: DataFrame, group: str, value: str) -> DataFrame:
    """(member, value): every member (group, member) gets its group's value; a member of a group that has none is an error."""
    found = members.join(groups.select(group, F.col(value).alias("value")), group, "left")
    missing = F.raise_error(F.concat(F.lit("no value for "), F.col(group).cast("string"))).cast("double")
    return found.select("member", F.when(F.col("value").isNotNull(), F.col("value")).otherwise(missing).alias("value"))


def by_sign(group: Column, strength: Column, split: Column) -> Column:
    """The group of an element, told apart by the sign of its strength where ``split``: ``_p`` from 0 on, ``_n`` below."""
    return F.when(split, F.concat(group, F.when(strength >= 0, "_p").otherwise("_n"))).otherwise(group)


def drop_prefixes(rows: DataFrame, name: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows whose upper-cased name starts with none of the upper-cased prefixes; a null name stays."""
    starts = [F.upper(name).startswith(p.upper()) for p in prefixes]
    return rows.where(~F.coalesce(reduce(lambda a, b: a | b, starts, F.lit(False)), F.lit(False)))


def in_given_order(rows: DataFrame, key: str, wanted: Sequence[str]) -> DataFrame:
    """Rows whose key is wanted, with its ``place`` in the list, from 0; what is wanted twice counts at its first place."""
    places = {w: i for i, w in reversed(list(enumerate(wanted)))}
    if not places:
        return rows.withColumn("place", F.lit(0)).where("false")
    lookup = F.map_from_arrays(F.array(*map(F.lit, places)), F.array(*map(F.lit, places.values())))
    return rows.withColumn("place", F.try_element_at(lookup, F.col(key))).where("place is not null")


def knob_specs(elements: DataFrame, specs: DataFrame) -> DataFrame:
    """(name, attribute) for each element and spec of its kind whose pattern it matches and whose attribute is not 0.

    ``elements`` has ``kind``, ``name`` and a map ``attributes``; ``specs`` is a dimension
    of a machine: kind, pattern, attribute, nonzero_attr (null: no condition).
    """
    found = elements.join(specs, "kind").where(F.expr("rlike(name, pattern)"))
    strength = F.coalesce(F.try_element_at("attributes", F.col("nonzero_attr")), F.lit(0.0))
    return found.where(F.col("nonzero_attr").isNull() | (strength != 0)).select("name", "attribute")


def monitor_plane(name: Column, horizontal: str, vertical: str) -> Column:
    """``x``, ``y`` or ``xy`` by the patterns found in a monitor's name; none of them is an error."""
    h, v = name.rlike(horizontal), name.rlike(vertical)
    bad = F.raise_error(F.concat(F.lit("no plane for "), name))
    return F.when(h & v, "xy").when(h, "x").when(v, "y").otherwise(bad)


def split_knobs(values: DataFrame, knobs: DataFrame, fixed: DataFrame) -> DataFrame:
    """Given values (name, value) with ``role``: a fitted knob, a fixed value of the model, or unknown."""
    is_knob = knobs.select("name", F.lit(True).alias("k")).distinct()
    is_fixed = fixed.select("name", F.lit(True).alias("f")).distinct()
    found = values.join(is_knob, "name", "left").join(is_fixed, "name", "left")
    return found.select("name", "value", F.when(F.col("k"), "knob").when(F.col("f"), "fixed").otherwise("unknown").alias("role"))


def all_or_raise(rows: DataFrame, known: DataFrame, key: str, message: str) -> DataFrame:
    """``rows``, with an error when one whose key is not in ``known`` is read."""
    found = rows.join(known.select(key, F.lit(True).alias("found")).distinct(), key, "left")
    checked = F.when(F.col("found"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit(message + " "), F.col(key).cast("string"))))
    return found.withColumn(key, checked).drop("found")


def ordered_union(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """(key, position) of all keys, each at its first place over the frames in order; frames have ``pos``."""
    tagged = [f.select(key, F.struct(F.lit(i).alias("frame"), F.col("pos")).alias("position")) for i, f in enumerate(frames)]
    merged = tagged[0]
    for t in tagged[1:]:
        merged = merged.unionAll(t)
    return merged.groupBy(key).agg(F.min("position").alias("position"))
