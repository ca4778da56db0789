import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"


@pytest.fixture
def documents(spark):
    """Rows of ``documents`` from (doc_id, text), with columns whose names clash with those of operators."""

    def make(*rows):
        rows = [(i, t, "web", 7, "x") for i, t in rows]
        return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n bigint, component_id string")

    return make
