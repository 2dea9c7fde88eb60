"""Column-expression helpers.

``ledgerlens.functions.sql`` builds Spark SQL text (used by the operators in
``selectExpr`` projections); the functions here wrap the same text as
``Column`` objects for DataFrame-API users. All of them are built-in Spark
expressions, so they stay JVM-side and inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.functions import sql


def _wrap(builder):
    def f(name: str, *args) -> Column:
        return F.expr(builder(name, *args))
    f.__doc__ = builder.__doc__
    f.__name__ = builder.__name__
    return f


round2 = _wrap(sql.round2)
js_number_text = _wrap(sql.js_number)
fixed2 = _wrap(sql.fixed2)
js_trim = _wrap(sql.js_trim)
csv_cell = _wrap(sql.csv_cell)
normalize_date = _wrap(sql.normalize_date)
pct_text = _wrap(sql.pct)

__all__ = ["sql", "round2", "js_number_text", "fixed2", "js_trim", "csv_cell",
           "normalize_date", "pct_text"]
