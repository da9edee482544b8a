"""Arrow column functions around Unicode tables: charset decoding, punycode, and the two compatibility foldings."""
from __future__ import annotations

import codecs
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _codec(name: str | None) -> str:
    try:
        found = codecs.lookup(name or "utf-8").name
    except LookupError:
        found = "utf-8"
    return "cp949" if found == "euc_kr" else found


@F.pandas_udf(StringType())
def decode_html_udf(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes to text in the given charset, undecodable bytes replaced."""
    return pd.Series([None if b is None else bytes(b).decode(_codec(c), errors="replace") for b, c in zip(body, charset)], dtype=object)


def _spelled(label: str | None) -> str | None:
    if label is None or not label.startswith("xn--"):
        return label
    try:
        return label[4:].encode("ascii").decode("punycode")
    except (UnicodeError, ValueError):
        return None


@F.pandas_udf(StringType())
def idn_decode_udf(label: pd.Series) -> pd.Series:
    """Punycode label to its letters; NULL when it cannot be decoded."""
    return label.map(_spelled)


@F.pandas_udf(StringType())
def fold_udf(text: pd.Series) -> pd.Series:
    """NFKC form, case folded."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def strip_marks_udf(text: pd.Series) -> pd.Series:
    """NFKD form without combining marks."""
    fold = lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return text.map(fold)
