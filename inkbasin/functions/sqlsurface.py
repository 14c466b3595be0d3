"""The scalar functions and a table function for `spark.sql`: `register(spark)` and use them by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from inkbasin import rules
from inkbasin.functions import classify, numbers, text

#: Functions of Columns by the name that SQL knows them by, with the names and types of their parameters; without lambdas, which have no SQL text.
SCALARS: dict[str, tuple[Callable[..., Column], str]] = {
    "ink_file_name": (text.file_name, "path STRING"), "ink_extension": (text.extension, "path STRING"), "ink_stem": (text.stem, "path STRING"), "ink_normalize_stem": (text.normalize_stem, "path STRING"), "ink_stem_prefix": (text.stem_prefix, "name STRING"),
    "ink_normalize_tag": (text.normalize_tag, "value STRING"), "ink_strip_markup": (text.strip_markup, "value STRING"), "ink_person": (text.person, "name STRING"), "ink_prompt_hash": (text.prompt_hash, "prompt STRING"), "ink_pdf_month": (text.pdf_month, "date STRING"),
    "ink_output_filename": (text.output_filename, "source STRING, extracted_at STRING, source_hash STRING"), "ink_file_type": (classify.file_type, "path STRING"), "ink_session_id": (text.session_id, "path STRING"),
    "ink_normalize_number": (numbers.normalize_number, "value STRING"),
}


class Numbers:
    """ink_numbers(text): a row (pos, number, raw) for each number of a text, in order; with a second argument true, distinct ones only."""

    @staticmethod
    def analyze(text: AnalyzeArgument, distinct: AnalyzeArgument | None = None) -> AnalyzeResult:
        from pyspark.sql import types as T

        if not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise ValueError("ink_numbers takes a text")
        if distinct is not None and not (distinct.isConstantExpression and isinstance(distinct.dataType, T.BooleanType)):
            raise ValueError("the second argument of ink_numbers is true or false")
        return AnalyzeResult(T.StructType().add("pos", T.IntegerType()).add("number", T.DoubleType()).add("raw", T.StringType()))

    def __init__(self):
        import re

        self.pattern = re.compile(rules.NUMBER.replace("(?i)", ""), re.I)
        self.factors = rules.SUFFIXES

    def eval(self, text, distinct=False):
        met, pos = set(), 0
        for m in self.pattern.finditer(text or ""):
            try:
                value = float(m[1].replace(",", "")) * self.factors.get((m[2] or "").lower(), 1.0)
            except ValueError:
                continue
            if distinct and value in met:
                continue
            met.add(value)
            pos += 1
            yield pos, value, m[0]


def body(spark: SparkSession, function: Callable[..., Column], parameters: str) -> tuple[str, str]:
    """What a function of Columns does as a SQL expression over its parameters, and its type."""
    names = [p.split()[0] for p in parameters.split(", ")]
    one = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {p.split()[1]}) AS {p.split()[0]}" for p in parameters.split(", ")))
    made = one.select(function(*(F.col(n) for n in names)).alias("out"))
    sql = made._jdf.queryExecution().analyzed().projectList().head().child().sql()
    for n in names:
        sql = sql.replace(f"__auto_generated_subquery_name.{n}", n)
    return sql, made.schema["out"].dataType.simpleString()


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; returns their names."""
    for name, (function, parameters) in SCALARS.items():
        sql, kind = body(spark, function, parameters)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {sql}")
    spark.udtf.register("ink_numbers", F.udtf(Numbers))
    return [*SCALARS, "ink_numbers"]
