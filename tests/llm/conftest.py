import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from conftest_llm import messy_rows  # noqa: E402

#: Columns that documents may bring along, named like those the operators make.
CLASHING = (
    "score double, kept boolean, ids string, part long, bucket int, home long, tokens long, bits long, packed string,"
    " v string, s string, e string, f string, copies long, `order` string, slice string, fingerprint string,"
    " component_id long, domain string, u long, label string, toxic int, host int, tie string, guest boolean, m long"
)
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls, blanks, repeated rows, ties, a very long text and clashing extra columns."""
    extra = [x.split()[0] for x in CLASHING.split(", ")]
    rows = [(*r, *[None] * len(extra)) for r in messy_rows()]
    return spark.createDataFrame(rows, f"{DOCUMENTS}, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i not in (13, 14)), int(i % 7 == 0)) for i in range(100, 140)] + [(None, 1, 1), (14, 0, None), (5, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
