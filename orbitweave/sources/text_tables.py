"""Text tables of a machine: monitor noise, knob values, TFS tables, result files.

These are dimensions of a machine, read with Spark's text reader so that any store
works; lines keep their place in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): the lines of one file from 0."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("row", "value"))


def read_noise_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, std_x, std_y) in metres from a white-space table of name and two columns of millimetres; names in capitals."""
    words = F.split(F.trim("value"), r"\s+")
    rows = _numbered(spark, path).where("row > 0").where(F.trim("value") != "").select(words.alias("w"))
    return rows.select(
        F.upper(F.col("w")[0]).alias("name"), (F.col("w")[1].cast("double") / 1000).alias("std_x"), (F.col("w")[2].cast("double") / 1000).alias("std_y")
    )


def read_knobs(spark: SparkSession, path: str) -> DataFrame:
    """(name, value, pos) from lines of name, tab, value; a later line of a name replaces an earlier one."""
    rows = _numbered(spark, path).where(F.trim("value") != "").select("row", F.split("value", "\t").alias("w"))
    each = rows.select(F.trim(F.col("w")[0]).alias("name"), F.trim(F.col("w")[1]).cast("double").alias("value"), "row")
    return each.groupBy("name").agg(F.max_by("value", "row").alias("value"), F.min("row").alias("pos"))


def write_knobs(values: DataFrame, path: str) -> None:
    """Lines of name, tab, value."""
    values.select(F.concat_ws("\t", "name", F.col("value").cast("string")).alias("value")).write.text(path)


def _fields(line: Column) -> Column:
    """White-space separated fields; a quoted one keeps its blanks and loses its quotes."""
    raw = F.regexp_extract_all(line, F.lit(r'("[^"]*"|[^\s"]+)'), 1)
    return F.transform(raw, lambda x: F.regexp_replace(x, '^"|"$', ""))


def read_tfs(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The table of a TFS file with a column per name, numbers as doubles, and its ``@`` headers.

    ``*`` starts the line of names and ``$`` that of types (``%le`` double, ``%d`` long,
    else text); blank and ``#`` lines are skipped.
    """
    lines = _numbered(spark, path).where(F.trim("value") != "")
    head = lines.where(F.col("value").rlike(r"^\s*[@*$]")).orderBy("row").collect()  # a few lines
    headers, names, kinds = {}, [], []
    for r in head:
        words = r["value"].split()
        if words[0] == "@":
            headers[words[1].lower()] = " ".join(words[3:]).strip('"')
        elif words[0] == "*":
            names = words[1:]
        else:
            kinds = words[1:]
    if not names or len(names) != len(kinds):
        raise ValueError(f"{path} has no matching lines of names and types")
    rows = lines.where(~F.col("value").rlike(r"^\s*[@*$#]")).select("row", _fields(F.col("value")).alias("w"))
    kind = {"%le": "double", "%d": "long"}
    columns = [F.col("w")[i].cast(kind.get(k, "string")).alias(n.lower()) for i, (n, k) in enumerate(zip(names, kinds, strict=True))]
    return rows.select("row", *columns), headers


def read_error_strengths(spark: SparkSession, path: str) -> DataFrame:
    """(name, value): integrated gradient errors by element from a TFS error table with the columns NAME and K1L; the last row of a name counts."""
    rows, _ = read_tfs(spark, path)
    if missing := sorted({"name", "k1l"} - set(rows.columns)):
        raise ValueError(f"{path} has no columns {missing}")
    return rows.groupBy("name").agg(F.max_by(F.col("k1l").cast("double"), "row").alias("value"))


def read_arc_results(spark: SparkSession, path: str) -> DataFrame:
    """(row, label, arc, value) from a tab-separated file whose second column lists values by comma."""
    rows = _numbered(spark, path).where(F.trim("value") != "").where(~F.col("value").startswith("#"))
    split = rows.select("row", F.split("value", "\t").alias("w"))
    return split.select("row", F.col("w")[0].alias("label"), F.posexplode(F.split(F.col("w")[1], ",")).alias("arc", "text")).select(
        "row", "label", "arc", F.trim("text").cast("double").alias("value")
    )
