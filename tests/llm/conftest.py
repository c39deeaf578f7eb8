import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from quarrylens import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    yield session.local_session(8, 4)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with a clashing extra column, from (doc_id, text[, lang, source])."""

    def make(*rows):
        full = [(*r, *("en", "src0")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame(
            [(*r, 0, "x", "y") for r in full],
            "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string",
        )

    return make
