"""Rules as rows, compiled to one pass a table."""

import pytest

from chronoweave.operators import quality as ql

SCHEMA = "table string, rule string, kind string, field string, low double, high double, allowed array<string>"


def test_rules_of_every_kind(spark):
    df = spark.createDataFrame([(1, "ab", 5, "o"), (2, None, None, "o"), (3, "abcdef", -1, "p"), (4, "", 99, "o"), (None, "zz", 5, None)], "id long, s string, v int, owner string")
    rules = [("t", "e", "enum", "s", None, None, ["ab", "zz"]), ("t", "r", "range", "v", 0.0, 10.0, None), ("t", "up", "range", "v", None, 50.0, None), ("t", "l", "length", "s", 1.0, 3.0, None),
             ("t", "p", "pattern", "s", None, None, ["^a"]), ("t", "q", "required", "s", None, None, None), ("t", "c", "cap", "owner", None, 2.0, None)]
    got = sorted((r.key or "", r.rule, r.n) for r in ql.rule_violations({"t": (df, "id")}, spark.createDataFrame(rules, SCHEMA)).collect())
    assert got == [("", "p", 1), ("2", "q", 1), ("3", "e", 1), ("3", "l", 1), ("3", "r", 1), ("4", "e", 1), ("4", "l", 1), ("4", "p", 1), ("4", "r", 1), ("4", "up", 1), ("o", "c", 3)]
    assert ql.rule_violations({"t": (df.limit(0), "id")}, spark.createDataFrame(rules, SCHEMA)).count() == 0
    assert ql.rule_violations({"t": (df, "id")}, spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        ql.rule_violations({"t": (df, "id")}, spark.createDataFrame([("t", "x", "odd", "s", None, None, None)], SCHEMA))
