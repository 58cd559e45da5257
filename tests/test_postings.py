"""Rule one and buckets: bad days, completeness and length."""

from laborlens.operators import postings

SCHEMA = "rid string, day int, event_id bigint, comp int, dlen int"
ROWS = [
    ("a", 0, 1, 1, 10), ("a", 3, 2, 2, 10), ("a", 6, 3, 2, 20), ("a", 5, 4, 2, 20), ("a", 7, 5, 1, 5),
    ("b", -1, 6, 3, 9), ("b", -1, 7, 3, 9), ("b", None, 8, 3, 9), ("b", 2, 9, 3, 9), ("b", 1, 10, None, 99),
    ("c", None, 11, 1, 1), ("c", None, 12, 1, 1),
]


def test_rule_one_prefers_complete_then_long_then_good_days(spark):
    got = {r.rid: (r.day, r.event_id, r.rule1_dups) for r in postings.rule_one(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got == {"a": (5, 4, 4), "b": (2, 9, 4), "c": (None, 11, 1)}


def test_bad_days_have_buckets_of_their_own(spark):
    got = {tuple(r) for r in postings.bucketed(spark.createDataFrame(ROWS, SCHEMA), 7).collect()}
    assert got == {
        ("a", 0, 4, 0, 6, 4), ("a", 1, 1, 7, 7, 5),
        ("b", 1_000_000, 1, -1, -1, 6), ("b", 1_000_001, 1, -1, -1, 7), ("b", 1_000_002, 1, None, None, 8), ("b", 0, 2, 1, 2, 9),
        ("c", 1_000_000, 1, None, None, 11), ("c", 1_000_001, 1, None, None, 12),
    }
