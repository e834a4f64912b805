"""Fill-in-middle transformation of texts by one regular-expression match per row.

A text is a run of units.  ``regexp_count`` gives their number n, two hashed
draws give the cuts a <= b, and a pattern made for the row,
``(unit{a})(unit{b-a})(rest)`` with possessive counts, captures prefix, middle
and suffix in one match, whose replacement is already the output.  Possessive
counts keep no positions to go back to, so a match walks the text once, without
recursion, whatever its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import column, free_name, text_column

# A letter run or any other single code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
FIELDS = ["n", "form", "prefix_chars", "middle_chars", "output"]


@dataclass(frozen=True)
class Marks:
    """Sentinels and shares: of 100 texts ``plain`` stay as they are and ``spm`` of the others start with the suffix."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    plain_percent: int = 10
    spm_percent: int = 20


def draws(key: Column, seed: int = 1, count: int = 4) -> list[Column]:
    """Unsigned 32-bit draws of a row: groups of eight digits of the sha256 of ``seed:key``; a null key counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    digest = F.sha2(text, 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def transformed(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = UNIT, seed: int = 1,
                marks: Marks = Marks()) -> DataFrame:
    """``docs`` with one more struct column (last) of ``FIELDS``: units, form, code points of the parts, and the output.

    Forms: ``plain`` is the text itself, ``psm`` puts prefix, suffix, middle
    behind their marks, ``spm`` suffix, prefix, middle.  Null and empty texts
    and texts that hold a mark are plain, so each output can be undone
    (:func:`restored`); plain rows have null parts.  Rows of equal key and text
    get equal outputs, a null key draws like an empty one.  Columns of ``docs``
    stay as they are, whatever their names.  Nothing is shuffled.

    ``unit`` must match any code point, so that units cover the whole text.
    """
    names = ["_fim_text", "_fim_n", "_fim_form", "_fim_pattern", "_fim_out", "_fim"]
    t, n, form, pattern, out, fim = (free_name(docs, x) for x in names)
    h = draws(column(docs, key), seed)
    p, s, m = marks.prefix, marks.suffix, marks.middle
    rows = docs.withColumn(t, text_column(docs, text))
    rows = rows.withColumn(n, F.regexp_count(F.col(t), F.lit(unit)).cast("long"))
    held = [F.contains(F.col(t), F.lit(x)) for x in (p, s, m)]
    plain = (F.col(n) == 0) | held[0] | held[1] | held[2] | (h[2] % 100 >= 100 - marks.plain_percent)
    rows = rows.withColumn(
        form, F.when(plain, "plain").when(h[3] % 100 < marks.spm_percent, "spm").otherwise("psm"))
    cuts = [h[i] % (F.col(n) + 1) for i in (0, 1)]
    a, b = F.least(*cuts), F.greatest(*cuts)
    counted = [F.concat(F.lit(f"((?:{unit}){{"), k.cast("string"), F.lit("}+)")) for k in (a, b - a)]
    rows = rows.withColumn(pattern, F.concat(F.lit(r"(?s)\A"), *counted, F.lit(r"(.*)\z")))
    sp, ss, sm = (re.sub(r"([\\$])", r"\\\1", x) for x in (p, s, m))  # as they stand in a replacement
    filled = {"psm": f"{sp}$1{ss}$3{sm}$2", "spm": f"{ss}$3{sp}$1{sm}$2"}
    swapped = F.when(F.col(form) == "plain", F.col(t)).otherwise(
        F.regexp_replace(F.col(t), F.col(pattern), F.when(F.col(form) == "spm", filled["spm"]).otherwise(filled["psm"])))
    rows = rows.withColumn(out, swapped)
    # marks stand once each in an output that is not plain, so their places give the parts' lengths
    at = {x: F.instr(F.col(out), F.lit(x)) for x in (p, s, m)}
    after_prefix = F.when(F.col(form) == "psm", at[s]).otherwise(at[m])
    cut = F.col(form) != "plain"
    parts = {
        "n": F.col(n), "form": F.col(form),
        "prefix_chars": F.when(cut, (after_prefix - at[p] - len(p)).cast("long")),
        "middle_chars": F.when(cut, (F.char_length(F.col(out)) + 1 - at[m] - len(m)).cast("long")),
        "output": F.col(out)}
    return rows.withColumn(fim, F.struct(*[v.alias(k) for k, v in parts.items()])).drop(t, n, form, pattern, out)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The exact text of an output of :func:`transformed`, from output and form alone."""
    p, s, m = (rf"\Q{x}\E" for x in (marks.prefix, marks.suffix, marks.middle))
    return (
        F.when(form == "psm", F.regexp_replace(output, F.lit(rf"(?s)\A{p}(.*?){s}(.*?){m}(.*)\z"), F.lit("$1$3$2")))
        .when(form == "spm", F.regexp_replace(output, F.lit(rf"(?s)\A{s}(.*?){p}(.*?){m}(.*)\z"), F.lit("$2$3$1")))
        .otherwise(output))
