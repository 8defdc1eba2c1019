"""Fill-in-middle transformation over an Aho-Corasick scan of class-changing characters and sentinels.

One automaton holds the three sentinels and the ASCII characters at which the class of a unit changes: the line feed for
characters and lines, white space for words. One pass over a text gives its events. What lies between two events needs no
look: in a gap, units are counted by arithmetic (as many as characters, or one). So a short sorted list of (place,
rank) pairs is all that the look-up of a cut by its rank needs: a bisection, then a step within the gap. The same automaton
finds the sentinels in an output, which restores the text.

A text is cut at two seeded ranks into prefix, middle and suffix, and written in one of two orders with sentinels between, or left
plain. A text that already holds a sentinel stays plain, so an output holds each sentinel once and the text comes back exactly:
no sentinel can arise across a join, as each begins with ``<``, ends with ``>`` and holds neither inside.

Defined cases: a null text counts as empty and is plain; a null id is hashed as empty text; repeated rows give equal results; a
cut may fall at either end, and the two may agree; texts are read whole; an empty table gives an empty result;
columns of any other name are left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, pick, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: ASCII characters at which a unit's class changes. A word keeps the white space after it, a line its line feed.
CHANGES = {"char": "\n", "word": "\t\n\v\f\r ", "line": "\n"}


class Scan:
    def __init__(self, unit: str = "char"):
        import ahocorasick

        self.unit = unit
        self.automaton = ahocorasick.Automaton()
        for sentinel in (PREFIX, SUFFIX, MIDDLE):
            self.automaton.add_word(sentinel, sentinel)
        for c in CHANGES[unit]:
            self.automaton.add_word(c, "")
        self.automaton.make_automaton()

    def units(self, text: str) -> tuple[list[int], list[int], bool]:
        """(places, ranks, whether a sentinel occurs): the units before places[i] number ranks[i]; the last pair ends the text."""
        places, ranks, found = [0], [0], False
        for last, sentinel in self.automaton.iter(text):
            if sentinel:
                found = True
                continue
            place = last + 1
            if self.unit == "char":
                rank = ranks[-1] + place - places[-1]
            elif self.unit == "word" and len(places) > 1 and place == places[-1] + 1:
                places[-1] = place  # one more character of white space after the same word
                continue
            else:
                rank = ranks[-1] + 1
            places.append(place)
            ranks.append(rank)
        rest = len(text) - places[-1]
        if rest:
            places.append(len(text))
            ranks.append(ranks[-1] + (rest if self.unit == "char" else 1))
        return places, ranks, found

    def place(self, places: list[int], ranks: list[int], rank: int) -> int:
        """Where the text is cut after so many units."""
        i = bisect_right(ranks, rank) - 1
        return places[i] + rank - ranks[i]

    def restore(self, output: str, form: str) -> str:
        if form == "plain":
            return output
        at = {sentinel: (last + 1 - len(sentinel), last + 1) for last, sentinel in self.automaton.iter(output) if sentinel}
        (p, prefix), (s, suffix), (m, middle) = at[PREFIX], at[SUFFIX], at[MIDDLE]
        if form == "psm":
            return output[prefix:s] + output[middle:] + output[suffix:m]
        return output[prefix:m] + output[middle:] + output[suffix:p]


def transform(scan: Scan, text: str, key: str, plain_from: int = 90, spm_below: int = 20) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix's characters, middle's characters, output) of a text; key seeds its cuts."""
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    places, ranks, found = scan.units(text)
    n = ranks[-1]
    if not text or found or h3 % 100 >= plain_from:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = scan.place(places, ranks, first), scan.place(places, ranks, second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_below:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "char", seed: int = 1, plain_from: int = 90, spm_below: int = 20, with_text: bool = True) -> DataFrame:
    """One row per row of docs: id_col, n (units), form, prefix_chars, middle_chars, output_sha256, restored_sha256, and with_text output."""
    rows = pick(docs, id_col, text_col).toDF("id", "text").select("id", F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("key"), "text")
    fields = [(id_col, rows.schema["id"].dataType), ("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output_sha256", "string"), ("restored_sha256", "string")]

    def make():
        scan = Scan(unit)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()

        def f(ids, keys, texts):
            n, forms, prefixes, middles, outputs, digests, restored = [], [], [], [], [], [], []
            for key, text in zip(keys.to_pylist(), texts):
                units, form, a, b, output = transform(scan, text.as_py() or "", key, plain_from, spm_below)
                n.append(units)
                forms.append(form)
                prefixes.append(a)
                middles.append(b)
                digests.append(digest(output))
                restored.append(digest(scan.restore(output, form)))
                if with_text:
                    outputs.append(output)
            found = [ids, pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()), pa.array(middles, pa.int64()), pa.array(digests, pa.string()), pa.array(restored, pa.string())]
            return [*found, pa.array(outputs, pa.string())] if with_text else found

        return f

    return map_texts(rows, make, [*fields, ("output", "string")] if with_text else fields)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT *, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    return fill_in_middle(table(spark, sf_dir, "documents"), with_text=False)
