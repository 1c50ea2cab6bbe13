"""Holding a Spark result against a DuckDB result, whatever the order of rows and columns."""

import math


def value(v):
    """A value in a form that both engines share."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return int(v) if hasattr(v, "__index__") else str(v) if not isinstance(v, str) else v


def rows(df) -> list[tuple]:
    """Sorted rows of a pandas table, columns by name; whole numbers as floats, so that types may differ."""
    names = sorted(df.columns)
    out = [tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in map(value, r)) for r in df[names].itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def assert_same(spark_df, duck_df):
    """Same columns, same rows."""
    a, b = spark_df.toPandas(), duck_df
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
