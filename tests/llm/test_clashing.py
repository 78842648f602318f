"""Columns of a table keep their values whatever their names are."""

from collections import Counter

import pytest

from tallyglass.llm import classifier, jaccard, mixing, secrets
from tests.llm import odd

OPERATORS = {
    "keep_good": lambda docs, labels: classifier.keep_good(docs, labels),
    "keep_one": lambda docs, labels: jaccard.keep_one(docs),
    "redact": lambda docs, labels: secrets.redact(docs),
    "mix": lambda docs, labels: mixing.mix(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_pass_through(spark, name):
    docs = odd.documents(spark)
    out = OPERATORS[name](docs, odd.labels(spark))
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.collect()
    assert rows
    for r in rows:
        assert all(r[c] == f"{c} of {r['doc_id']}" for c in odd.CLASHING) and r["lang"] == "en"
    if name == "redact":
        assert Counter(r["doc_id"] for r in rows) == Counter(d for d, _, _ in odd.texts())


@pytest.mark.parametrize("name", OPERATORS)
def test_nothing_of_nothing(spark, name):
    docs = odd.documents(spark, [])
    assert OPERATORS[name](docs, odd.labels(spark)).collect() == []
