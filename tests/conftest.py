from __future__ import annotations

import os
import sys
import uuid
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from plumbline.session import local_session  # noqa: E402

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    home = tmp_path_factory.mktemp("spark")
    session = local_session(
        8,
        app="tests",
        spark__sql__warehouse__dir=str(home / "warehouse"),
        spark__checkpoint__dir=str(home / "shared"),
        spark__sql__shuffle__partitions="4",
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder() -> str:
    return TABLES


@pytest.fixture
def fresh():
    """A new name per call, for tables and views."""
    return lambda prefix="t": f"{prefix}_{uuid.uuid4().hex[:10]}"


@pytest.fixture
def setting(spark):
    """Change session options for one test."""
    changed = {}

    def change(key: str, value: str) -> None:
        changed.setdefault(key, spark.conf.get(key))
        spark.conf.set(key, value)

    yield change
    for key, value in changed.items():
        spark.conf.set(key, value)


def plan_of(df, mode: str = "formatted") -> str:
    """The physical plan as `explain` prints it."""
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
