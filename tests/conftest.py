import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslint.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 2, app="corpuslint-tests")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpuslint-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture
def files_df(spark):
    """Build a `files` table from {path: text} (or {repo: {path: text}})."""
    def make(tree, repo="repo"):
        rows = []
        if all(isinstance(v, dict) for v in tree.values()):
            for r, t in tree.items():
                rows += [(r, p, c.encode("utf-8") if isinstance(c, str) else c) for p, c in t.items()]
        else:
            rows = [(repo, p, c.encode("utf-8") if isinstance(c, str) else c) for p, c in tree.items()]
        rows = [(r, p, bytearray(c), len(c)) for r, p, c in rows]
        return spark.createDataFrame(rows, "repo string, path string, content binary, size_bytes bigint")
    return make
