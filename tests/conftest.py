import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from spanloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("spanloom-tests", 4, shuffle_partitions=4, memory="6g")


@pytest.fixture(scope="session")
def make_sent(spark):
    """(sid, category, words, tags, s) from lists of words."""
    def make(sentences, category="en", tag="n"):
        rows = [(i, category if isinstance(category, str) else category[i], list(w), [tag] * len(w), "".join(w))
                for i, w in enumerate(sentences)]
        return spark.createDataFrame(
            rows, "sid bigint, category string, words array<string>, tags array<string>, s string")
    return make
