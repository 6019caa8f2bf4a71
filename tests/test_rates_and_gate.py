"""Queries against their SQL on small tables with odd rows."""

import datetime as dt

import oracle
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from quillspan.plans import curation, review  # noqa: F401
from quillspan.plans.views import with_views
from quillspan.registry import ORACLES, QUERIES


def check(spark, folder, name, **tables):
    for table, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{table}.parquet")
    assert oracle.difference(QUERIES[name](spark, str(folder)), oracle.connect(str(folder)), with_views(ORACLES[name])) == ""


def test_fractions_of_a_second_round(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    times = (0.4, 0.5, 0.6, 1.5, 300.25, 900.5, 900.6, 901.5, 1800.49)
    rows = [{"event_id": i, "ts": at(s), "user_id": 1, "event_type": "error", "value": 1.0, "props": "{}"} for i, s in enumerate(times)]
    check(spark, tmp_path, "login_rate_window", events=rows)


@pytest.mark.parametrize("name", ["lg02_language_chunk_ratio", "lg06_language_admission", "lg07_revalidation_report"])
def test_blank_texts_have_no_row(spark, tmp_path, name):
    texts = ("the end of the line is in the text", " \n\t ", "", None, "le texte de la page est à côté")
    rows = [{"doc_id": i, "text": t, "lang": "fr" if i == 4 else "en", "source": "a", "n_chars": len(t or "")} for i, t in enumerate(texts)]
    check(spark, tmp_path, name, documents=rows)
