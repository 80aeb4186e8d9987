"""One 64-bit number for a reading, in the order of file, turn, monitor and plane."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts from the highest to the lowest and their bits: 63 in all, so that ids are not negative and sort as their parts do.
PARTS = (("file", 20), ("turn", 24), ("monitor", 16), ("plane", 3))


def pack(**parts: Column) -> Column:
    """The id of (file, turn, monitor, plane); null if one is null, an error if one is negative or has too many bits."""
    if set(parts) != {name for name, _ in PARTS}:
        raise ValueError(f"an id has the parts {[name for name, _ in PARTS]}")
    packed = F.lit(0).cast("long")
    for name, bits in PARTS:
        value = parts[name].cast("long")
        wrong = F.raise_error(F.concat(F.lit(f"{name} does not fit in {bits} bits: "), value.cast("string"))).cast("long")
        packed = packed * (1 << bits) + F.when(value.between(0, (1 << bits) - 1) | value.isNull(), value).otherwise(wrong)
    return packed


def unpack(reading: Column) -> list[Column]:
    """The parts of an id, as columns named after them."""
    out, low = [], 0
    for name, bits in reversed(PARTS):
        out.append(F.shiftright(reading, low).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).alias(name))
        low += bits
    return out[::-1]
