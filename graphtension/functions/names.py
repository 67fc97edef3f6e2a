"""Codes to names, as expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_of(code: Column, names: dict[int, str], kind: str) -> Column:
    """The name of a code, or ``Kind(code)`` for one without a name."""
    out = F.concat(F.lit(f"{kind}("), code.cast("string"), F.lit(")"))
    for k, v in names.items():
        out = F.when(code == k, v).otherwise(out)
    return out
