"""Text rules shared by every operator.

Fixed values (must be identical in the Spark plans and in the SQL
checks, see plans/oracle.py):

* sentence rule: ``[^.!?\\n]+[.!?]*`` - a run of non-terminators followed
  by its terminators; newline always ends a sentence.
* token rule: ``[\\p{L}\\p{N}]+`` applied to the lower-cased text.
* default passage id separator ``@@``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
SENTENCE_RE = r"[^.!?\n]+[.!?]*"
TOKEN_RE = r"[\p{L}\p{N}]+"
PSG_SEP = "@@"


def sentences(text: Column) -> Column:
    """ARRAY<STRING> of trimmed, non-empty sentences."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE_RE), 0)
    trimmed = F.transform(raw, lambda s: F.trim(s))
    return F.filter(trimmed, lambda s: F.length(s) > 0)


def tokens(text: Column) -> Column:
    """ARRAY<STRING> of lower-cased word tokens."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN_RE), 0)


def normalise(text: Column, sep_cols: list[Column] | None = None, sep: str = "") -> Column:
    """Optional concat of several fields with ``sep`` (default none),
    then newline and tab replaced by a space."""
    if sep_cols:
        text = F.concat_ws(sep, *([text] + list(sep_cols)))
    return F.translate(F.coalesce(text, F.lit("")), "\n\t", "  ")
