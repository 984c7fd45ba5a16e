"""Settings by precedence, and rights by role as row filters.

A setting of a tenant goes before a global one, which has no tenant, and that before a default. A
table of (role, action) says what a role may do; compiled into a filter, it decides row by row what
a user sees and changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(rows: DataFrame, settings: DataFrame, keys: list[str], defaults: dict[str, str | None], tenant: str = "tenant_id") -> DataFrame:
    """Rows with a column for each key: the setting (tenant_id, key, value, updated_at) of the row's tenant, else the global one, else the default.

    Blank and null values count as not set, a null tenant has the global settings; of repeated
    settings the last by updated_at counts, then the largest value. The settings of a tenant come
    together in one row before they are joined; the global ones, one value a key, are read at once.
    """
    said = settings.where(F.col("key").isin(keys) & (F.trim("value") != ""))
    last = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.struct(F.coalesce("updated_at", F.lit("")).alias("at"), "value"))).alias(f"_{k}")
    own = said.where("tenant_id is not null").groupBy(F.col("tenant_id").alias("_tenant")).agg(*[last(k) for k in keys])
    shared = said.where("tenant_id is null").agg(*[last(k) for k in keys]).first()
    held = rows.join(own, F.col(tenant) == F.col("_tenant"), "left")
    fallback = {k: shared[f"_{k}"] if shared[f"_{k}"] is not None else defaults.get(k) for k in keys}
    return held.select(*[held[c] for c in rows.columns], *[F.coalesce(f"_{k}", F.lit(fallback[k])).cast("string").alias(k) for k in keys])


def checked_number(value: Column, name: str, expected: int | None = None) -> Column:
    """A setting as a number above 0, and as the expected one where one is stated; else an error that names it."""
    number = value.try_cast("double")
    bad = F.raise_error(F.concat(F.lit(f"invalid_{name}:"), F.coalesce(value, F.lit("null"))))
    out = F.when(number.isNull() | F.isnan(number) | (number <= 0), bad).otherwise(number)
    if expected is None:
        return out
    return F.when(out != expected, F.raise_error(F.concat(F.lit(f"{name}_mismatch:expected_{expected}_got_"), value))).otherwise(out)


def allows(matrix: dict[str, set[str]], role: Column, action: str) -> Column:
    """Whether a role may do an action; unknown and null roles may nothing."""
    return F.coalesce(role.isin([r for r, actions in sorted(matrix.items()) if action in actions]), F.lit(False))


def row_filter(matrix: dict[str, set[str]], role: Column, user_tenant: Column, row_tenant: Column, see: str = "see", see_all: str = "see_all") -> Column:
    """Whether a user sees a row: who may see all sees it, and who may see sees rows of the own tenant and rows without one. Never null."""
    own = row_tenant.isNull() | F.coalesce(row_tenant == user_tenant, F.lit(False))
    return allows(matrix, role, see_all) | (allows(matrix, role, see) & own)


def visible_to_user(rows: DataFrame, matrix: dict[str, set[str]], role: str | None, tenant: str | None) -> DataFrame:
    """The rows (tenant_id, …) that one user sees. The filter is made of literals only, so it reaches the scan."""
    may = lambda action: role is not None and action in matrix.get(role, ())
    if may("see_all"):
        return rows
    if not may("see"):
        return rows.where(F.lit(False))
    return rows.where(F.col("tenant_id").isNull() if tenant is None else F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant))
