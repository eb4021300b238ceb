import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from llm_odd import ODD  # noqa: E402


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs, with null-bearing and clashing extra columns."""

    def docs(rows):
        kind = "doc_id bigint, text string, lang string, n_tokens string, class_id string, score string, part string, id string, rep string, length string"
        return spark.createDataFrame([(i, t, None, "x", None, "y", None, "z", None, "w") for i, t in rows], kind).repartition(3)

    return docs


@pytest.fixture(scope="session")
def odd(make):
    return make(ODD)
