"""The library's expressions as SQL functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from siltstone.functions import strings
from siltstone.functions.markup import clean


#: SQL functions whose body is an expression, as name, parameters and body.
EXPRESSIONS = (
    ("accentless", "t STRING", f"regexp_replace(translate(t, '{strings._ACCENTED}', '{strings._PLAIN}'), '\\\\p{{M}}', '')"),
    ("token_count", "t STRING", "greatest(1, cast(bround(length(t) / 3.5D) AS int))"),
    ("url_host", "u STRING", "lower(regexp_replace(regexp_replace(u, '^https?://', ''), '/.*$', ''))"),
    ("letter_grade", "share DOUBLE", "CASE WHEN share >= 85 THEN 'A' WHEN share >= 70 THEN 'B' WHEN share >= 50 THEN 'C' WHEN share >= 30 THEN 'D' ELSE 'F' END"),
)


def register_udfs(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; returns their names.

    What an expression can say is a SQL function, which Catalyst puts in place of
    the call; only Unicode's compatibility form and HTML cleaning run in Python.
    """
    for name, parameters, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")

    @F.pandas_udf("string")
    def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    @F.pandas_udf("string")
    def cleaned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(clean, na_action="ignore")

    spark.udf.register("nfkc", nfkc)
    spark.udf.register("sanitised_html", cleaned)
    return [name for name, *_ in EXPRESSIONS] + ["nfkc", "sanitised_html"]
