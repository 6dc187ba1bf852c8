"""Semi-structured text as VARIANT columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def variant_fields(df: DataFrame, raw: str, fields: dict[str, tuple[str, str]], malformed: str = "malformed") -> DataFrame:
    """Every column of ``df`` and, by name, the values at JSON paths as types:
    ``fields[name] = (path, type)``. The text is parsed once, into a VARIANT.
    A path that a row lacks, a value that does not fit its type, null text and
    text that is no JSON give null; ``malformed`` tells the last from the rest."""
    staged = df.withColumn("_v", F.try_parse_json(F.col(raw)))
    return staged.select(*[F.col(f"`{c}`") for c in df.columns],
                         *[F.try_variant_get("_v", path, kind).alias(n) for n, (path, kind) in fields.items()],
                         (F.col(raw).isNotNull() & F.col("_v").isNull()).alias(malformed))


def schema_found(df: DataFrame, raw: str) -> DataFrame:
    """The schema that all rows of JSON text share, and how many rows have it."""
    v = F.try_parse_json(F.col(raw))
    return df.agg(F.schema_of_variant_agg(v).alias("schema"), F.count(v).alias("n_rows"))


