import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from cases import EXTRA, ROWS  # noqa: E402

@pytest.fixture(scope="session")
def edge(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in EXTRA)
    rows = [(k, t, "en", "s", None, *["x"] * len(EXTRA)) for k, t in ROWS]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
