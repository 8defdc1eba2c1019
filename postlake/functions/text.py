"""Text helpers that stay in built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters with marks and their plain letters.
MARKED = "àáâãäåāăąçćčďèéêëēęěìíîïīñńňòóôõöōřśšťùúûüūůýÿźżž"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiinnnoooooorsstuuuuuuyyzzz"


def folded(c: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(c), MARKED, PLAIN)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, without marks."""
    return F.regexp_extract_all(folded(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))
