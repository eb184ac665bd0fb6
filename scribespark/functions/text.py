"""Tokens and normal forms of transcripts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column | str) -> Column:
    """Words between white space (ASCII), none empty; null for null."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


#: How a word error rate may clean both texts first, by method; white space stays as it is.
STRIPPED = {
    "basic": lambda x: x,
    "ignore_punctuation": lambda x: F.regexp_replace(x, r"\p{Punct}", ""),
    "normalized": lambda x: F.regexp_replace(F.lower(x), r"\p{P}", ""),
}


def without_punctuation(text: Column | str) -> Column:
    """ASCII punctuation removed, white space folded to single blanks."""
    return F.array_join(tokens(STRIPPED["ignore_punctuation"](text)), " ")


def normalized(text: Column | str) -> Column:
    """Lower case, Unicode punctuation removed (symbols stay), white space folded."""
    return F.array_join(tokens(STRIPPED["normalized"](text)), " ")
