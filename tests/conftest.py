import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fanweave.session import local_session  # noqa: E402

# Fixed hand graph (ids offset by 10**10 to exercise ids above 2**31).
OFF = 10 ** 10
HAND_EDGES = [(1, 2), (1, 3), (1, 3), (2, 3), (3, 1), (4, 3), (5, 5), (6, 7), (8, 7), (7, 9),
              (10, 11), (11, 10)]


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", 8, app="fanweave-tests",
                      extra={"spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fanweave-test-ckpt-", dir="/tmp"))
    yield s


@pytest.fixture(scope="session")
def hand_graph(spark):
    from fanweave.operators.graph import assemble
    users = spark.createDataFrame([(i + OFF, f"user{i}", "intro") for i in range(1, 12)],
                                  "id long, name string, intro string")
    follows = spark.createDataFrame([(a + OFF, b + OFF, 1.0) for a, b in HAND_EDGES],
                                    "src long, dst long, weight double")
    return assemble(users, follows)


def by_id(df, key="id", value=None, offset=OFF):
    cols = df.columns
    value = value or [c for c in cols if c != key][0]
    return {r[key] - offset: r[value] for r in df.collect()}
