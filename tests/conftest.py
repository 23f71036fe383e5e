import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from filelake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus_tree(tmp_path):
    """Three text files, one of them a copy."""
    # The texts of the three files.
    root = tmp_path / "test_data"
    (root / "subdir").mkdir(parents=True)
    (root / "file1.txt").write_text("This is the first file.")
    (root / "file2.txt").write_text("This is the second file, it is unique.")
    (root / "subdir" / "file3_dupe.txt").write_text("This is the first file.")
    return root


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
