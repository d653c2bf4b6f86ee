"""Feature column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

SECONDS_PER_HOUR = 3600
SECONDS_PER_DAY = 86400


def known(df: DataFrame, name: str) -> Column:
    """The column with NaN, which counts as missing, turned into null."""
    col = F.col(name)
    return F.when(~F.isnan(col), col) if isinstance(df.schema[name].dataType, (DoubleType, FloatType)) else col


def transaction_hour(dt: Column) -> Column:
    """Floor division then modulo (N6), int16."""
    return F.pmod(F.floor(dt / SECONDS_PER_HOUR), F.lit(24)).cast("short")


def transaction_day(dt: Column) -> Column:
    """Floor division, int32."""
    return F.floor(dt / SECONDS_PER_DAY).cast("int")


def log_amount(amount: Column) -> Column:
    """ln(1 + x) computed in double, stored as float32."""
    return F.log1p(amount.cast("double")).cast("float")


def email_domain_match(p: Column, r: Column) -> Column:
    """Null reads as the literal ``missing`` on both sides."""
    return (F.coalesce(p, F.lit("missing")) == F.coalesce(r, F.lit("missing"))).cast("byte")


def has_full_address(addr1: Column, addr2: Column) -> Column:
    """Both address parts present."""
    return (addr1.isNotNull() & addr2.isNotNull()).cast("byte")


def has_address_truthy(addr1: Column) -> Column:
    """Serving-time flag, 0 counts as no address."""
    return (F.coalesce(addr1, F.lit(0)) != 0).cast("int")


def device_info_missing(info: Column) -> Column:
    """D9."""
    return info.isNull().cast("byte")


def is_mobile_device(device_type: Column) -> Column:
    """Case-insensitive, null -> 0."""
    return (F.lower(F.coalesce(device_type, F.lit(""))) == "mobile").cast("byte")


def flag_equals(col: Column, value: str) -> Column:
    """Equality flag, int8."""
    return F.coalesce(col == value, F.lit(False)).cast("byte")


def account_pair(orig: Column, dest: Column) -> Column:
    """Null if either side is null."""
    return F.concat(orig, F.lit("->"), dest)


def float32(c: Column) -> Column:
    return c.cast("double").cast("float")
