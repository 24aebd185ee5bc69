"""CSV and column-oriented JSON, with the cell typing of the frame layer, and Spark's own formats."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.errors import DataValidationError

NUMBER = r"^\s*[+-]?(0|[1-9][0-9]*|(0|[1-9][0-9]*)?\.[0-9]+|[1-9][0-9]*\.)([eE][+-]?[0-9]+)?\s*$"


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', header: bool = True, multiline: bool = True) -> DataFrame:
    """Columns become numbers or booleans where every cell is one; empty, null and undefined cells are null.

    A number with a leading zero, as in 01, is text. Without a header columns are col0, col1 and so on. Two passes:
    one aggregation finds the types.
    """
    raw = spark.read.csv(path, sep=delimiter, quote=quote, escape=quote, header=header, multiLine=multiline, inferSchema=False)
    if not header:
        raw = raw.toDF(*(f"col{i}" for i in range(len(raw.columns))))
    return typed(raw)


def typed(raw: DataFrame) -> DataFrame:
    raw = raw.select(*(F.when(~F.col(f"`{c}`").isin("", "null", "undefined"), F.col(f"`{c}`")).alias(c) for c in raw.columns))
    asked = []
    for i, c in enumerate(raw.columns):
        own = F.col(f"`{c}`")
        asked += [F.bool_and(own.rlike(NUMBER)).alias(f"n{i}"), F.bool_and(own.isin("true", "false")).alias(f"b{i}")]
    found = raw.agg(*asked).first() if raw.columns else {}
    out = []
    for i, c in enumerate(raw.columns):
        own = F.col(f"`{c}`")
        out.append((F.trim(own).cast("double") if found[f"n{i}"] else own.cast("boolean") if found[f"b{i}"] else own).alias(c))
    return raw.select(*out)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, single: bool = False) -> None:
    """A folder of files written by all tasks; ``single`` gathers them in one, which is for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").csv(path, sep=delimiter, header=header, escape='"', nullValue="", emptyValue='""')


def to_csv_text(df: DataFrame, delimiter: str = ",", header: bool = True, most: int = 100_000) -> str:
    """The CSV of a small frame, quoted only where needed and without a last line end."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise DataValidationError(f"more than {most} rows; write_csv has no such bound")

    def cell(v) -> str:
        text = "" if v is None else str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)
        return '"' + text.replace('"', '""') + '"' if any(x in text for x in (delimiter, '"', "\n", "\r")) else text

    lines = [delimiter.join(map(cell, df.columns))] if header else []
    return "\n".join([*lines, *(delimiter.join(map(cell, r)) for r in rows)])


def to_json_text(df: DataFrame, most: int = 100_000) -> str:
    """A column-oriented document (columns, index, data) of a small frame; NaN becomes null."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise DataValidationError(f"more than {most} rows; write JSON lines instead")
    clean = lambda v: None if isinstance(v, float) and v != v else v
    return json.dumps({"columns": df.columns, "index": list(range(len(rows))), "data": {c: [clean(r[i]) for r in rows] for i, c in enumerate(df.columns)}}, indent=2, default=str)


def from_json_text(spark: SparkSession, text: str) -> DataFrame:
    doc = json.loads(text)
    if not isinstance(doc, dict) or {"columns", "index", "data"} - set(doc):
        raise DataValidationError("columns, index and data are needed")
    if set(doc["data"]) != set(doc["columns"]):
        raise DataValidationError("data and columns name different columns")
    sizes = {len(v) for v in doc["data"].values()} | {len(doc["index"])}
    if len(sizes) > 1:
        raise DataValidationError("columns have different lengths")

    def kind(values) -> T.DataType:
        known = {type(v) for v in values if v is not None}
        return T.BooleanType() if known == {bool} else T.DoubleType() if known and known <= {int, float} else T.StringType()

    schema = T.StructType([T.StructField(c, kind(doc["data"][c])) for c in doc["columns"]])
    fit = lambda v, t: None if v is None else float(v) if isinstance(t, T.DoubleType) else v if isinstance(t, T.BooleanType) else str(v)
    rows = list(zip(*([fit(v, schema[c].dataType) for v in doc["data"][c]] for c in doc["columns"]), strict=True))
    return spark.createDataFrame(rows, schema)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A column-oriented document, read by Spark from any store it reaches."""
    return from_json_text(spark, spark.read.text(path, wholetext=True).first()[0])


def write_json(df: DataFrame, path: str) -> None:
    df.sparkSession.createDataFrame([(to_json_text(df),)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n")
