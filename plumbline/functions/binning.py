"""Equal-width bucket numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def equal_width_bucket(value: Column, low: float | None, high: float | None, bins: int) -> Column:
    """Bucket 1..bins of `value` between `low` and `high`; the top edge joins the last bucket.

    A constant column falls into bucket 1; a missing value gives NULL.
    """
    if bins < 1:
        raise ValueError(f"bins must be at least 1, got {bins}")
    if low is None or high is None or not math.isfinite(low) or not math.isfinite(high):
        return F.lit(None).cast("bigint")
    if high == low:
        return F.when(value.isNotNull(), F.lit(1).cast("bigint"))
    position = (value - F.lit(low)) / F.lit(high - low) * F.lit(float(bins))
    bucket = F.least(F.floor(position).cast("bigint") + 1, F.lit(bins).cast("bigint"))
    # `least` passes over NULL, so a missing value must be kept out of it.
    return F.when(value.isNotNull(), bucket)
