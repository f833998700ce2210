"""Configuration tables: the handful of rows that every row of a large table meets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows beyond which a table is no configuration any more.
MOST = 10_000


def each_of(df: DataFrame, configuration: DataFrame) -> DataFrame:
    """Every row of ``df`` with every row of a configuration table, which becomes part of the plan; a larger table is refused."""
    rows = configuration.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a configuration table has at most {MOST} rows")
    kind = configuration.schema.simpleString()
    options = F.array(*(F.struct(*(F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in configuration.schema)) for r in rows)).cast(f"array<{kind}>")
    return df.withColumn("_each", F.explode(options)).select(*df.columns, "_each.*")
