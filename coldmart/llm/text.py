"""Column expressions over texts that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the contracts: what counts as white space around words and lines.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; ``lower`` alone would also touch other alphabets."""
    pure = F.length(text) == F.octet_length(text)
    return F.when(pure, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart that share an id. Rows equal in both have equal results anyway."""
    return F.struct(doc_id.cast("string").alias("id"), F.xxhash64(text).alias("text"))
