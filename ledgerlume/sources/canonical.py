"""The canonical table of transfers: one fixed schema, coerced to and validated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("sender", T.StringType()), T.StructField("receiver", T.StringType()),
    T.StructField("amount", T.DoubleType()), T.StructField("timestamp", T.TimestampType()), T.StructField("label", T.IntegerType()),
    T.StructField("scenario_id", T.StringType()), T.StructField("ring_id", T.StringType()), T.StructField("dataset_source", T.StringType()),
])
COLUMNS = SCHEMA.fieldNames()
REQUIRED = ("transaction_id", "sender", "receiver", "amount", "timestamp")
DEFAULTS = {"label": -1, "scenario_id": "", "ring_id": ""}


def coerce(df: DataFrame, source: str) -> DataFrame:
    """df with the canonical columns and row_ord, the place of a row in the input.

    Values that don't convert become null, NaN too; optional columns get their defaults; a
    missing required column is an error.
    """
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"required columns are missing: {', '.join(missing)}")
    out = []
    for f in SCHEMA.fields:
        if f.name not in df.columns:
            out.append(F.lit(DEFAULTS.get(f.name, source)).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name)
        kind = df.schema[f.name].dataType
        if isinstance(f.dataType, T.TimestampType):
            c = F.try_to_timestamp(c) if isinstance(kind, T.StringType) else c.cast("timestamp")
        elif f.name == "amount":
            c = c.try_cast("double")
            c = F.when(~F.isnan(c), c)
        else:
            c = c.try_cast(f.dataType)
        if f.name in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[f.name]))
        elif f.name == "dataset_source":
            c = F.coalesce(c, F.lit(source))
        out.append(c.alias(f.name))
    place = F.col("row_ord").cast("long") if "row_ord" in df.columns else F.monotonically_increasing_id()
    return df.select(*out, place.alias("row_ord"))


def schema_problems(df: DataFrame) -> list[str]:
    """What makes df not canonical; empty if nothing does."""
    found = [f"missing column {c}" for c in COLUMNS if c not in df.columns]
    kinds = dict(df.dtypes)
    if kinds.get("amount", "double") not in ("double", "float") and not kinds.get("amount", "").startswith("decimal"):
        found.append("amount is not a number with fraction")
    if kinds.get("label", "int") not in ("tinyint", "smallint", "int", "bigint"):
        found.append("label is not an integer")
    return found


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
