"""Scalar rules written once and rendered as Spark SQL or as the SQL of the cross-check engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Dialect:
    """Renders the few functions whose spelling differs."""

    def __init__(self, spark: bool) -> None:
        self.spark = spark

    def quote(self, text: str) -> str:
        text = text.replace("\\", "\\\\") if self.spark else text
        return "'" + text.replace("'", "\\'" if self.spark else "''") + "'"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        by = by if self.spark else by.replace("$1", "\\1").replace("$2", "\\2")
        return f"regexp_replace({x}, {self.quote(pattern)}, {self.quote(by)}{'' if self.spark else ', ' + self.quote('g')})"

    def matches(self, x: str, pattern: str) -> str:
        return f"{'rlike' if self.spark else 'regexp_matches'}({x}, {self.quote(pattern)})"

    def extract(self, x: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.quote(pattern)}, {group})"

    def count(self, x: str, pattern: str) -> str:
        return f"regexp_count({x}, {self.quote(pattern)})" if self.spark else f"len(regexp_extract_all({x}, {self.quote(pattern)}))"

    def numbers(self, text: str) -> str:
        """Decimal literals marked with # as doubles."""
        import re

        return re.sub(r"([0-9.]+)#", r"\1D" if self.spark else r"CAST(\1 AS DOUBLE)", text)

    def double(self, x: str) -> str:
        return f"CAST({x} AS DOUBLE)"


SPARK, DUCK = Dialect(True), Dialect(False)
Step = tuple[str, str]


def apply_steps(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Add one column after the other; later steps see the earlier ones."""
    for name, text in steps:
        df = df.withColumn(name, F.expr(text))
    return df


def sql_steps(base: str, steps: list[Step]) -> str:
    """The same as nested selects over the query text `base`."""
    for name, text in steps:
        base = f"SELECT *, {text} AS {name} FROM ({base})"
    return base
