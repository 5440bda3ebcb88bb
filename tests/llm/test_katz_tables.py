"""The stored model against the one that lives in a query."""

import pytest

from gateloom.llm import katz, katz_tables


def test_stored_model_gives_the_same_scores(spark, docs, tmp_path):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    katz_tables.write_tables(one, str(tmp_path / "m"), 4)
    got = {r["doc_id"]: r for r in katz_tables.scored(spark, str(tmp_path / "m"), one).collect()}
    want = {r["doc_id"]: r for r in katz.katz_scores(one).collect()}
    assert set(got) == set(want)
    for i, r in want.items():
        assert got[i]["n_tokens"] == r["n_tokens"] and got[i]["score"] == pytest.approx(r["score"], abs=1e-6)


def test_an_empty_model(spark, docs, empty, tmp_path):
    katz_tables.write_tables(empty, str(tmp_path / "m"), 4)
    assert all(r["score"] == pytest.approx(0.0) for r in katz_tables.scored(spark, str(tmp_path / "m"), docs.limit(3)).collect())
