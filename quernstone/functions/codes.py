"""Course-code expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_key(code: Column) -> Column:
    """Upper case, letters and digits only; null and blank codes become null."""
    kept = F.regexp_replace(F.upper(code), r"[^\p{L}\p{N}]", "")
    return F.when(kept != "", kept)
