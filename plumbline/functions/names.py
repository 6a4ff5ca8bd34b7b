"""Columns by their literal names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The top-level column called `name`, whatever characters it holds."""
    return F.col("`{}`".format(name.replace("`", "``")))
