"""Compatibility folding of text: the one helper that Spark's own functions lack."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .rules import confusables


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def folded(text: Column) -> Column:
    """Text in compatibility form with look-alike letters as ASCII; ASCII texts never reach Python."""
    table = confusables()
    wide = F.when(text.rlike(r"[^\x00-\x7F]"), _nfkc(text)).otherwise(text)
    return F.translate(wide, "".join(table), "".join(table.values()))
