import os

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
SF = "/root/testdata/sf0.001"


@pytest.fixture
def docs(spark):
    """Documents with an extra column of a clashing name: nulls, empty and very long texts, ties, repeated rows."""
    def make(rows, columns="doc_id long, text string, lang string, source string, n_chars long, row string, t string"):
        width = columns.count(",") + 1
        return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], columns)
    return make
