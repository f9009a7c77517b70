"""Line dedup: repeated windows of three consecutive lines lose their later occurrences.

DataFrame functions only. Windows are hashed to 128 bits inside a text, the first
occurrence of each hash is a map-side minimum, and only windows that occur again are
joined back, so a window in a third of all texts is a split join, never a group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepchange.llm.common import written

LINES = 3


def _window_hashes(lines: Column, n: int) -> Column:
    """For each window of n lines with some non-blank line: its first line's number and two hashes of its lines'."""
    numbers = F.when(F.size(lines) >= n, F.sequence(F.lit(0), F.size(lines) - n)).otherwise(F.array().cast("array<int>"))

    def hashed(line: Column) -> Column:
        return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"), (F.trim(line) != "").alias("live"))

    def window(each: Column, i: Column) -> Column:
        part = F.slice(each, i + 1, n)
        return F.struct(i.alias("at"), F.xxhash64(part["h1"]).alias("h1"), F.xxhash64(part["h2"]).alias("h2"), F.exists(part["live"], lambda x: x).alias("live"))

    # The lines' hashes are an array of one element, so that each line is hashed once
    return F.flatten(F.transform(F.array(F.transform(lines, hashed)), lambda each: F.filter(F.transform(numbers, lambda i: window(each, i)), lambda w: w["live"])))


def duplicate_lines(documents: DataFrame, n: int = LINES) -> DataFrame:
    """(doc_id, text_hash, lines): the numbers of the lines to remove, texts without any left out.

    A window is n consecutive lines (parts of the text between line feeds, compared as they are, n-1 line feeds
    included) of which one has a character other than a space. Of equal windows the first by doc_id (null first),
    then by text hash and line, stays; each line under any other occurrence goes. Rows alike in doc_id and text are
    one document. Null and empty texts and texts under n lines have no windows.
    """
    lines = F.split(F.col("text"), "\n", -1)
    windows = (
        documents.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(_window_hashes(lines, n)).alias("w"))
        .select("doc_id", "text_hash", "w.at", "w.h1", "w.h2")
    )
    windows = written(windows, "windows")
    place = F.struct("doc_id", "text_hash", "at")
    # The greatest place tells whether there is a second one: a text read twice is not
    firsts = (
        windows.groupBy("h1", "h2")
        .agg(F.min(place).alias("first"), F.max(place).alias("last"))
        .where(F.col("first") != F.col("last"))
        .select("h1", "h2", "first")
    )
    # Written, so that the join's sides are plain exchanges, of which hot windows can be split
    later = windows.join(written(firsts, "firsts"), ["h1", "h2"]).where(place != F.col("first"))
    return (
        later.groupBy("doc_id", "text_hash")
        .agg(F.collect_set("at").alias("starts"))
        .select(
            "doc_id",
            "text_hash",
            F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + n - 1))))).alias("lines"),
        )
    )


def dedup_lines(documents: DataFrame, n: int = LINES) -> DataFrame:
    """The documents, all columns and rows, with the later windows' lines cut out of `text`.

    A document whose lines all go keeps an empty text; null stays null. See duplicate_lines.
    """
    held = documents.select(F.struct(*documents.columns).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"))
    cut = duplicate_lines(documents, n).select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), "lines")
    joined = held.join(cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("text_hash") == F.col("cut_hash")), "left")
    text = F.when(F.col("lines").isNull(), F.col("row.text")).otherwise(without_lines(F.col("row.text"), F.col("lines")))
    return joined.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in documents.columns])


def without_lines(text: Column, gone: Column) -> Column:
    """The text less the lines with these numbers, ascending: kept runs lie between one number and the next."""
    lines = F.split(text, "\n", -1)
    bounds = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    pieces = F.transform(
        F.sequence(F.lit(1), F.size(gone) + 1),
        lambda i: F.slice(lines, F.element_at(bounds, i) + 2, F.element_at(bounds, i + 1) - F.element_at(bounds, i) - 1),
    )
    return F.concat_ws("\n", F.flatten(pieces))


def report(documents: DataFrame, n: int = LINES) -> DataFrame:
    """Per row: doc_id, lines of the text (null: 0), the kept text's length and md5, and whether lines went."""
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1, F.lit(0)).cast("long")
    counted = documents.select("doc_id", "text", n_lines.alias("n_lines"), F.length("text").alias("before"))
    return dedup_lines(counted, n).select(
        "doc_id",
        "n_lines",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("kept_md5"),
        (F.col("before") != F.length("text")).alias("changed"),
    )


ORACLE_SQL = """
WITH lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL
), windows AS (
  SELECT doc_id, i, array_to_string(l[i : i + 2], chr(10)) AS w
  FROM lines, unnest(range(1, len(l) - 1)) AS u(i)
), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM windows WHERE trim(replace(w, chr(10), ''), ' ') <> ''
), gone AS (
  SELECT doc_id, list_distinct(flatten(list(range(i, i + 3)))) AS g FROM firsts WHERE k > 1 GROUP BY doc_id
), kept AS (
  SELECT d.doc_id, d.text AS before,
    CASE WHEN g IS NULL THEN d.text ELSE array_to_string(
      [string_split(d.text, chr(10))[i] FOR i IN range(1, len(string_split(d.text, chr(10))) + 1) IF NOT list_contains(g, i)], chr(10)) END AS text
  FROM documents d LEFT JOIN gone ON d.doc_id = gone.doc_id
)
SELECT doc_id, CAST(coalesce(len(string_split(before, chr(10))), 0) AS BIGINT) AS n_lines,
  CAST(coalesce(length(text), 0) AS BIGINT) AS kept_chars, md5(coalesce(text, '')) AS kept_md5,
  length(before) <> length(text) AS changed
FROM kept
"""
