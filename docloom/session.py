"""A session bound to one tenant: every table it hands out carries the tenant's filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.validators import safe_uuid


def tenant_filter(frame: DataFrame, tenant: str | None, column: str = "practice_id") -> DataFrame:
    """Rows of the tenant; an unset or garbage tenant sees none."""
    bound = safe_uuid(F.lit(tenant)) if tenant is not None else F.lit(None).cast("string")
    return frame.filter(F.coalesce(F.col(column) == bound, F.lit(False)))


def bound_filter(frame: DataFrame, tenant: Column | object, column: str) -> DataFrame:
    """The same for keys that aren't uuids; null sees no row."""
    value = tenant if isinstance(tenant, Column) else F.lit(tenant)
    return frame.filter(F.coalesce(F.col(column) == value, F.lit(False)))


class TenantSession:
    def __init__(self, spark: SparkSession, tenant: str | None, role: str = "clinician", actor: str = "unknown"):
        self.spark, self.tenant, self.role, self.actor = spark, tenant, role, actor
        self._tables: dict[str, DataFrame] = {}

    def register(self, name: str, frame: DataFrame) -> None:
        self._tables[name] = frame

    def table(self, name: str) -> DataFrame:
        return tenant_filter(self._tables[name], self.tenant)
