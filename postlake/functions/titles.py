"""Title tokens and the program policy that reads them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators that count as a space in titles, in filters and in the program policy.
SEPARATORS = "-_/\\,.:;()[]{}–—|+&"
POLICY_SEPARATORS = "-‐‑–—/(),"
# Words of clinical externships, postings reviewed as co-ops, and seasons.
EXTERN = ("extern", "externs", "externship", "externships")
CLINICAL = (
    "nurse", "nursing", "radiology", "radiologic", "pharmacy", "pharmacist", "respiratory care", "respiratory therapy", "surgical tech", "surgical technologist", "patient care",
    "medical assistant", "sonography", "sonographer", "imaging technologist", "clinical laboratory", "laboratory technologist",
)
COOP_URLS = tuple(f"https://careers.ibm.com/en_us/careers/jobdetail?jobid={n}" for n in (128639, 128709, 128792))
SEASONS = ("spring", "summer", "fall", "winter")


def padded(title: Column, separators: str = SEPARATORS) -> Column:
    """Lower case, separators as spaces, one space before and after; runs of spaces stay."""
    plain = F.translate(F.coalesce(title, F.lit("")), separators, " " * len(separators))
    return F.concat(F.lit(" "), F.lower(F.trim(plain) if separators == SEPARATORS else plain), F.lit(" "))


def has_any(tokens: Column, words) -> Column:
    """Whether padded tokens hold one of the words, or phrases, as whole tokens."""
    found = F.lit(False)
    for w in words:
        found |= tokens.contains(f" {w} ")
    return found


def clinical_extern(title: Column) -> Column:
    tokens = padded(title, POLICY_SEPARATORS)
    return has_any(tokens, EXTERN) & has_any(tokens, CLINICAL)


def plain_type(employment_type: Column) -> Column:
    return F.lower(F.translate(F.coalesce(employment_type, F.lit("")), "_- /", ""))


def coop_by_posting(employment_type: Column, url: Column) -> Column:
    """A co-op by its type or by a reviewed url; the topic is another way to be one."""
    found = plain_type(employment_type).contains("coop")
    for prefix in COOP_URLS:
        found |= F.startswith(F.lower(F.coalesce(url, F.lit(""))), F.lit(prefix))
    return found
