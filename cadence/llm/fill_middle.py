"""Fill-in-the-middle transformation by one counted match per text.

``regexp_count`` gives the number of units of a text; two numbers drawn from its
id say how many of them are prefix and middle. A pattern made for the row repeats
the unit possessively that many times in two groups and leaves the rest to a
third, so a single match cuts the text, and its replacement orders the parts.
Possessive repeats neither backtrack nor recurse: a text of a million units takes
no deeper a stack than one of ten.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: a word with the white space before it, or white space at the end.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: Marks before prefix, suffix and middle; they must differ and none may occur in another.
MARKS = ("<P>", "<S>", "<M>")
#: Texts of a hundred that are cut, cut texts of a hundred in suffix-first order, and the seed of the draws.
RATE, SPM_RATE, SEED = 50, 80, 42


def draw(doc_id: Column, at: int, seed: int = SEED) -> Column:
    """The ``at``-th (from 1) 32-bit number drawn for an id: eight digits of a sha256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * at - 7, 8), 16, 10).cast("long")


def parts(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> tuple[Column, Column, Column]:
    """Prefix, middle and suffix of an output column, found by its marks; null for plain ones."""
    p, s, m = marks
    o, spm, cut = F.col(output), F.col(form) == "spm", F.col(form) != "plain"
    before = F.substring_index(o, m, 1)
    first = F.when(spm, F.expr(f"substr(substring_index(`{output}`, '{p}', 1), {len(s) + 1})")).otherwise(
        F.expr(f"substr(substring_index(`{output}`, '{s}', 1), {len(p) + 1})"))
    second = F.when(spm, F.substring_index(before, p, -1)).otherwise(F.substring_index(before, s, -1))
    return (F.when(cut, F.when(spm, second).otherwise(first)), F.when(cut, F.substring_index(o, m, -1)),
            F.when(cut, F.when(spm, first).otherwise(second)))


def fill_in_middle(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED,
                   marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, text, n, form, output), a row for each row of ``docs`` (doc_id, text).

    ``n`` counts the units of the whole text. ``form`` is plain (output is the text)
    or one of psm (prefix, suffix, middle) and spm (suffix, prefix, middle). Empty
    texts and texts that hold a mark stay plain; a null text is empty. The draws
    depend on doc_id alone: repeated rows and texts of one id are drawn alike, a
    null id draws as an empty one. A part may be empty. An empty table gives no
    rows; other columns, whatever their names, are not read."""
    p, s, m = marks
    if len(set(marks)) < 3 or any("'" in x or not x for x in marks):
        raise ValueError("marks must be three different texts without apostrophes")
    plain_mark = "|".join(map(re.escape, marks))
    d = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    form = (F.when((F.col("text") == "") | F.col("text").rlike(plain_mark) | (draw(F.col("doc_id"), 3, seed) % 100 >= rate), "plain")
             .when(draw(F.col("doc_id"), 4, seed) % 100 < spm_rate, "spm").otherwise("psm"))
    one, two = (draw(F.col("doc_id"), i, seed) % (F.col("n") + 1) for i in (1, 2))
    d = d.select("*", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    unit = f"(?:{UNIT})"
    pattern = F.concat(F.lit(rf"(?s)\A({unit}{{"), F.col("a").cast("string"), F.lit(rf"}}+)({unit}{{"),
                       (F.col("b") - F.col("a")).cast("string"), F.lit(r"}+)(.*)\z"))
    p, s, m = (x.replace("\\", "\\\\").replace("$", "\\$") for x in marks)  # as replacement text
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    return d.select("doc_id", "text", "n", "form", output.alias("output"))


def query(spark, sf_dir: str) -> DataFrame:
    """op11: all ``documents``; the restored text is put together from output and form alone."""
    d = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text")
    prefix, middle, suffix = parts("output", "form")
    d = d.select("*", prefix.alias("prefix"), middle.alias("middle"), suffix.alias("suffix"))
    restored = F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat("prefix", "middle", "suffix"))
    return d.select("doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"),
                    F.char_length("middle").cast("long").alias("middle_chars"),
                    F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


_H = ", ".join(f"CAST('0x' || substr(d, {8 * i - 7}, 8) AS BIGINT) AS h{i}" for i in (1, 2, 3, 4))

#: The same rows from lists of units.
SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
h AS (SELECT *, len(u) AS n, {_H} FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
             WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle,
        array_to_string(u[b + 1:], '') AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p"""
