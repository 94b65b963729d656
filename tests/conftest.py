import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelcraft.session import build_session, ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="panelcraft-warehouse-")
    s = build_session("local[4]", shuffle_partitions=8, app="panelcraft-tests", extra={"spark.sql.warehouse.dir": warehouse})
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture()
def scratch():
    """A fresh scratch folder per test (tests only; jobs use the cluster's shared folders)."""
    return tempfile.mkdtemp(prefix="panelcraft-test-")
