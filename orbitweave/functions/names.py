"""Names of knobs, families and selections."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

GAIN_PREFIX = "bpmgain."


def family(knob: Column) -> Column:
    """The text after a knob's last dot; the whole name without one."""
    return F.substring_index(knob, ".", -1)


def result_name(knob: Column) -> Column:
    """``knl[n]`` and ``ksl[n]`` attributes (order counted from 1) as ``dk<n-1>l`` and ``dk<n-1>sl``."""
    order = F.regexp_extract(knob, r"\.k[ns]l\[(\d+)\]$", 1)
    skew = F.when(knob.rlike(r"\.ksl\["), "sl").otherwise("l")
    stem = F.regexp_replace(knob, r"\.k[ns]l\[\d+\]$", "")
    return F.when(order != "", F.concat(stem, F.lit(".dk"), (order.cast("int") - 1).cast("string"), skew)).otherwise(knob)


def is_gain(knob: Column) -> Column:
    return knob.startswith(GAIN_PREFIX)


def parse_selection(text: str, families: dict[str, set[str]]) -> dict[str, list[str]]:
    """``family:error,error family:error`` as a map; ``none`` selects nothing.

    A family named twice gets the errors of both, in order; an unknown family or
    error, or a token of another shape, is an error.
    """
    chosen: dict[str, list[str]] = {}
    for token in text.split():
        if token == "none":
            continue
        m = re.fullmatch(r"(\w+):(\w+(?:,\w+)*)", token)
        if not m or m[1] not in families:
            raise ValueError(f"bad selection {token!r}")
        for error in m[2].split(","):
            if error not in families[m[1]]:
                raise ValueError(f"{m[1]} has no {error!r}")
            if error not in (have := chosen.setdefault(m[1], [])):
                have.append(error)
    return chosen
