"""Fill-in-middle texts by injected markers: a delimiter after every unit, counted and split at by Spark's own functions.

The delimiter is escaped where a text has it, appended after every code point by one regular expression, counted, and the
text is cut at two of the delimiters by ``substring_index``; the parts are freed of delimiters and escapes again and put
together in the order of the form. Every row is worked on by itself, so nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, so many are transformed, and of 100 of those so many begin with the suffix.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: The delimiter, the character that escapes, and the letters that stand for either after it.
DELIMITER, ESCAPE = "\x1f", "\x1b"
_DELIMITER_AS, _ESCAPE_AS = ESCAPE + "u", ESCAPE + "e"
#: An escaped character, or one of any other kind, line ends included.
_UNIT = f"(?s){ESCAPE}.|[^{ESCAPE}]"


def _replace(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def mark_units(text: Column) -> Column:
    """text with a delimiter after each of its code points, its own delimiters and escapes escaped."""
    escaped = _replace(_replace(text, ESCAPE, _ESCAPE_AS), DELIMITER, _DELIMITER_AS)
    return F.regexp_replace(escaped, _UNIT, "$0" + DELIMITER)


def count_units(marked: Column) -> Column:
    """How many delimiters a marked text has."""
    return (F.octet_length(marked) - F.octet_length(_replace(marked, DELIMITER, ""))).cast("int")


def unmark(part: Column) -> Column:
    """A part of a marked text as plain text."""
    return _replace(_replace(_replace(part, DELIMITER, ""), _DELIMITER_AS, DELIMITER), _ESCAPE_AS, ESCAPE)


def _cut(text: Column, delimiter: str, count: Column | int) -> Column:
    return F.call_function("substring_index", text, F.lit(delimiter), count if isinstance(count, Column) else F.lit(count))


def _parts(marked: Column, n: Column, first: Column, second: Column) -> tuple[Column, Column, Column]:
    """(prefix, middle, suffix): the units up to first, those from there up to second, and the rest."""
    upto = _cut(marked, DELIMITER, second)
    return unmark(_cut(marked, DELIMITER, first)), unmark(_cut(upto, DELIMITER, first - second)), unmark(_cut(marked, DELIMITER, second - n - 1))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four groups of eight hexadecimal digits of the sha256 of ``seed:doc_id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of: the parts are found by the markers alone."""
    spm = form == "spm"
    prefix = _cut(_cut(output, PREFIX, -1), MIDDLE, 1)
    suffix = _cut(_cut(output, SUFFIX, -1), MIDDLE, 1)
    # Whichever part comes first ends where the other's marker begins.
    prefix, suffix = F.when(spm, prefix).otherwise(_cut(prefix, SUFFIX, 1)), F.when(spm, _cut(suffix, PREFIX, 1)).otherwise(suffix)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, _cut(output, MIDDLE, -1), suffix))


def fill_in_middle(docs: DataFrame, seed: int = 1, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of docs.

    A text of n code points is cut after two drawn numbers of them, 0 to n, the draws being a hash of the seed and the id.
    Form is plain (output is the text; no lengths) for empty texts, texts that contain a marker and 100 - ``transformed``
    of 100 documents; of 100 others ``suffix_first`` are spm, the rest psm.

    A null text is empty; a text may be as long as a cell allows, as rows are cut one by one (with its markers it takes
    twice its bytes while it is cut); control characters, the delimiter included, come back as they were; a null id is
    drawn as an empty one; rows with one id get the same draws, and equal rows equal results, one each; an empty table
    gives none. Other columns are never read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    rows = rows.withColumn("marked", mark_units(F.col("text"))).withColumn("n", count_units(F.col("marked")))
    ends = F.pmod(h1, F.col("n") + 1).cast("int"), F.pmod(h2, F.col("n") + 1).cast("int")
    has_marker = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("n") == 0) | has_marker | (h3 % 100 >= transformed)
    form = F.when(plain, "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"), F.least(*ends).alias("first"), F.greatest(*ends).alias("second"))
    prefix, middle, suffix = _parts(F.col("marked"), F.col("n"), F.col("first"), F.col("second"))
    head, tail = F.concat(F.lit(PREFIX), prefix), F.concat(F.lit(SUFFIX), suffix)
    made = F.when(F.col("form") == "spm", F.concat(tail, head, F.lit(MIDDLE), middle)).otherwise(F.concat(head, tail, F.lit(MIDDLE), middle))
    cut = F.col("form") != "plain"
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n"),
        "form",
        F.when(cut, F.col("first")).cast("long").alias("prefix_chars"),
        F.when(cut, F.col("second") - F.col("first")).cast("long").alias("middle_chars"),
        F.when(cut, made).otherwise(F.col("text")).alias("output"),
    )
