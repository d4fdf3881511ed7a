import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT))
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""
    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:  # names that operators use inside
            for c in ("key", "doc", "mark", "row", "size", "dig", "bucket", "part", "at", "n", "starts", "group", "__chunk", "kept", "score"):
                df = df.selectExpr("*", f"'x' as `{c}`")
        return df

    return make
