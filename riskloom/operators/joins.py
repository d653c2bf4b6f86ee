"""Join helpers: broadcast only behind a check of measured bytes, with a shuffle join beyond it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

BROADCAST_MAX_BYTES = 64 << 20
COLUMN_BYTES = 16


def fits_broadcast(small: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    """Whether the rows of ``small`` (text measured, other columns counted at ``COLUMN_BYTES``) stay
    within ``max_bytes``; one aggregate over it."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in small.schema.fields
            if isinstance(f.dataType, (StringType, BinaryType))]
    row = sum(wide, F.lit(COLUMN_BYTES * len(small.columns)))
    return (small.agg(F.sum(row.cast("long"))).first()[0] or 0) <= max_bytes
