import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(ROOT), str(Path(__file__).resolve().parent)]


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those of results."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(ROOT))

    def make(rows, lang=None):
        return spark.createDataFrame(
            [(i, t, lang(t) if lang else "en", "s", len(t or ""), 1.0, "k") for i, t in rows],
            "doc_id long, text string, lang string, source string, n_chars long, score double, kept string")

    return make
