"""Tenant isolation: reads see one tenant's rows, writes must carry it (FLT1-FLT3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tenant_view(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """Rows of the tenant; none when it is unset or empty. The filter reaches the scan."""
    kind = df.schema[column].dataType
    return df.filter(F.col(column) == F.lit(tenant or None).cast(kind))


def tenant_violations(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """Rows that another tenant, or none, owns."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(tenant or None).cast(df.schema[column].dataType)) | F.col(column).isNull())


def tenant_write_check(df: DataFrame, tenant: str | None, column: str = "tenant_id") -> DataFrame:
    """``df``, unless a row violates: then the whole write is refused."""
    if tenant_violations(df, tenant, column).limit(1).count():
        raise PermissionError(f"rows outside tenant {tenant!r}")
    return df


def tenant_delete(df: DataFrame, keys: DataFrame, tenant: str | None, on: list[str], column: str = "tenant_id") -> DataFrame:
    """``df`` without the tenant's rows that ``keys`` names; other tenants' rows stay, named or not."""
    doomed = tenant_view(df, tenant, column).join(keys.select(on), on, "left_semi").select(*on, column).distinct()
    return df.join(doomed, [*on, column], "left_anti")
