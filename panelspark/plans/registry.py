"""How queries are registered: one result on the Spark side and, where SQL can express it, one for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .base import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_TYPES = {"int": ("int", "INTEGER"), "big": ("bigint", "BIGINT"), "str": ("string", "VARCHAR"), "date": ("date", "DATE"), "bool": ("boolean", "BOOLEAN")}


def nine_digits(x: Column) -> Column:
    """Nine digits of ``x`` as the twins' ``printf`` writes them. A NaN comes from arithmetic (the power of a loss of more than everything),
    whose NaN has the sign bit set, and is written with it; infinities are ``inf``."""
    wide = F.when(F.isnan(x), "-nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf")
    return F.when(x.isNotNull(), F.coalesce(wide, F.format_string("%.8e", x)))


def query(name: str, columns: str, sql: str | None = None, digits: int = 6):
    """Register a function of ``Tables``. ``columns`` lists ``name`` (as it is), ``name:type``, ``name~`` (a double,
    rounded to ``digits``, as the engines add in different orders), ``name!`` (a double to the nearest float, for values that lie
    between two decimals), or ``name%`` (a double of any size, nine digits of it as text). A last ``*~`` stands for all other columns, doubles."""

    def wrap(make: Callable[[Tables], DataFrame]):
        spark_side, sql_side = [], []
        for c in columns.split():
            if c == "*~":
                spark_side.append((c, digits))
                named = ", ".join(f'"{n}"' for n, _ in spark_side[:-1])
                sql_side.append(f"round(CAST(COLUMNS(* EXCLUDE ({named})) AS DOUBLE), {digits}) + 0.0")
            elif c.endswith("~"):
                c = c[:-1]
                spark_side.append((c, digits))
                sql_side.append(f'round(CAST("{c}" AS DOUBLE), {digits}) + 0.0 AS "{c}"')
            elif c.endswith("!"):
                c = c[:-1]
                spark_side.append((c, "!"))
                sql_side.append(f'CAST(CAST("{c}" AS FLOAT) AS DOUBLE) AS "{c}"')
            elif c.endswith("%"):
                c = c[:-1]
                spark_side.append((c, "%"))
                sql_side.append(f"""printf('%.8e', CAST("{c}" AS DOUBLE)) AS "{c}\"""")
            elif c.endswith("^"):
                c = c[:-1]
                spark_side.append((c, -digits))
                sql_side.append(f'round(ln(CAST("{c}" AS DOUBLE)), {digits}) + 0.0 AS "{c}"')
            elif ":" in c:
                c, kind = c.split(":")
                spark_side.append((c, _TYPES[kind][0]))
                sql_side.append(f'CAST("{c}" AS {_TYPES[kind][1]}) AS "{c}"')
            else:
                spark_side.append((c, None))
                sql_side.append(f'"{c}"')

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = make(Tables(spark, sf_dir))
            out = []
            named = {c for c, _ in spark_side}
            for c, how in [(n, how) for c, how in spark_side for n in ([c] if c != "*~" else [n for n in df.columns if n not in named])]:
                if how == "!":
                    out.append(F.col(c).cast("float").cast("double").alias(c))
                    continue
                if how == "%":
                    out.append(nine_digits(F.col(c).cast("double")).alias(c))
                    continue
                x = F.ln(F.col(c)) if isinstance(how, int) and how < 0 else F.col(c)
                how = abs(how) if isinstance(how, int) else how
                out.append((F.round(x.cast("double"), how) + F.lit(0.0)).alias(c) if isinstance(how, int) else x.cast(how).alias(c) if how else x)
            return df.select(*out)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"SELECT {', '.join(sql_side)} FROM ({oracle(sql)})"
        return make

    return wrap
