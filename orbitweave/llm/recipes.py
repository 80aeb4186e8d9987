"""The mixing recipe that the registered queries share: the source tree of ``documents`` and its weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Target weight of a source by its language; other languages count 1.
LANGUAGE_WEIGHTS = {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0}
#: Tokens to keep, as a share of all.
MIX_SHARE = 0.8


def domain_of(source: Column) -> Column:
    """The tree's top level: four groups of sources by a hash of their name."""
    return F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce(source, F.lit("")).cast("binary")), F.lit(4)).cast("string"))


def source_weights(docs: DataFrame) -> DataFrame:
    """(domain, lang, source, weight) for every source of ``docs`` by its language."""
    lang = F.col("lang")
    weight = reduce(lambda c, kv: c.when(lang == kv[0], kv[1]), LANGUAGE_WEIGHTS.items(), F.when(F.lit(False), 0.0)).otherwise(1.0)
    return docs.select(domain_of(F.col("source")).alias("domain"), "lang", "source", weight.alias("weight")).distinct()
