"""Review flags: STRUCT<code, message, severity>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAG_TYPE = "struct<code:string,message:string,severity:string>"
SEVERITIES = ("info", "warn", "error")


def flag(code, message, severity="info") -> Column:
    code, message, severity = (c if isinstance(c, Column) else F.lit(c)
                               for c in (code, message, severity))
    return F.struct(code.cast("string").alias("code"), message.cast("string").alias("message"),
                    severity.cast("string").alias("severity"))


def no_flags() -> Column:
    return F.array().cast(f"array<{FLAG_TYPE}>")


def flags_where(*pairs: tuple[Column, Column]) -> Column:
    """ARRAY of the flags whose condition holds, in the given order."""
    listed = F.array(*[F.when(cond, value) for cond, value in pairs])
    return F.filter(listed, lambda f: f.isNotNull())


def violation_flag(rule: Column, message: Column, severity: str = "warn") -> Column:
    return flag(F.concat(F.lit("qa-"), rule), message, severity)
