import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from codegrove.session import get_session

    session = get_session(
        "tests", "local[8]",
        {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
         "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
         "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint"))},
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_graph(spark):
    """(nodes, edges) from {id: type} and (src, dst, type) triples."""

    def build(nodes: dict, edges: list):
        n = spark.createDataFrame(
            [(i, i, f"m.{i}", t, "f.py", 1, 5) for i, t in nodes.items()],
            "id string, name string, qualified_name string, node_type string, file_path string, line_start int, line_end int",
        )
        e = spark.createDataFrame(
            [(a, b, t, 1.0, None) for a, b, t in edges],
            "src string, dst string, edge_type string, weight double, metadata string",
        )
        return n, e

    return build
