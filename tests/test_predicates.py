import pytest

from lodestrata.functions.predicates import where

ROWS = [(1, "ab", 0), (2, "", 5), (3, None, None), (4, "AB", -1)]


@pytest.mark.parametrize(
    ("field", "op", "value", "ids"),
    [("s", "eq", "ab", [1]), ("s", "eq", None, [3]), ("s", "ne", "ab", [2, 3, 4]), ("s", "contains", "b", [1]), ("s", "contains", "", [1, 4]), ("s", "starts_with", "A", [4]), ("s", "ends_with", "b", [1]), ("s", "in", ["ab", None], [1, 3]), ("s", "not_in", ["ab"], [2, 3, 4]), ("s", "in", [], []), ("n", "gt", -2, [2, 4]), ("n", "lt", 9, [2, 4])],
)
def test_null_and_falsy_rules(spark, field, op, value, ids):
    d = spark.createDataFrame(ROWS, "id int, s string, n int")
    assert sorted(r["id"] for r in d.where(where(field, op, value)).collect()) == ids


def test_unknown_operator():
    with pytest.raises(ValueError):
        where("s", "like", "x")
