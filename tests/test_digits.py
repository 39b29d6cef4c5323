"""Doubles of any size as text, as the twins write them."""

import duckdb
from pyspark.sql import functions as F

from panelspark.plans.registry import nine_digits


def test_nine_digits_are_those_of_the_twin(spark):
    cases = {"a": "pow(-0.5, 0.3)", "b": "0.00012345678951", "c": "-98765432.1", "d": "cast('inf' as double)", "e": "cast('-inf' as double)", "f": "cast(null as double)", "g": "cast(0 as double)"}
    got = spark.sql("select " + ", ".join(f"cast({x} as double) as {c}" for c, x in cases.items()))
    want = duckdb.sql("select " + ", ".join(f"printf('%.8e', cast({x} as double)) as {c}" for c, x in cases.items())).fetchall()[0]
    assert tuple(got.select(*(nine_digits(F.col(c)).alias(c) for c in cases)).first()) == want
