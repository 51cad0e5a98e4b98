"""Unicode normal forms, which Spark has no function for, in Arrow batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarryline.functions import text as T

# Styles of quotes, dashes and spaces, and what they fold to.
STYLES, PLAIN = "‘’“”‐–—−", "''\"\"----"


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def fold(text: Column) -> Column:
    """NFKC, quotes and dashes of one style, white space collapsed and stripped, lower case."""
    return T.norm_text(F.translate(nfkc(text), STYLES, PLAIN))
