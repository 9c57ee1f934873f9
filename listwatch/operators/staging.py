"""Filtering on columns that are expensive to compute."""

from pyspark.sql import Column, DataFrame, functions as F


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds, tested after its columns are computed.

    A plain filter is pushed below the projections that compute its columns, which then repeats
    their whole expression once per use.  A generator stays where it is.
    """
    return df.select(*df.columns, F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")).drop("_kept")
