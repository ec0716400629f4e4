from veristrata.catalog import CORE_QUERIES
from veristrata.catalog.ledger_queries import LENSES


def test_questions_without_any_coverage_are_reported(spark, tmp_path):
    rows = [
        ("r", "questions", "Q1", "covered_by:breadth"), ("r", "questions", " Q1 ", " Covered_By:Primary"), ("r", "questions", "Q2", "addresses"), ("r", "questions", "Q2", None),
        ("r2", "questions", "Q1", "COVERED_BY:COUNTER "), ("r", "questions", None, "covered_by:breadth"), ("r", "questions", " ", "covered_by:breadth"), ("r", "claims", "C1", "covered_by:breadth"),
    ]
    spark.createDataFrame(rows, "run_key string, source_kind string, source_id string, relation string").write.parquet(str(tmp_path / "record_edges.parquet"))
    got = [(r.record, r.detail) for r in CORE_QUERIES["coverage_missing"](spark, str(tmp_path)).collect()]
    have = {("r/Q1", "breadth"), ("r/Q1", "primary"), ("r2/Q1", "counter")}
    assert len(got) == len(set(got)) and set(got) == {(q, x) for q in ("r/Q1", "r/Q2", "r2/Q1") for x in LENSES} - have
