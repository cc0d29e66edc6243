"""Line-first quality rules, in DataFrame functions only.

Each line is held against rules for navigation, boilerplate and punctuation; failing lines go, and
a document that loses more than ``MAX_LOST`` of its word characters is rejected, as is one that
fails the base rules (too few words, too many words in repeated windows of five).

Defined cases: null is the empty text, which has no words and fails the base rules; repeated rows
are judged alike; texts of any length are judged whole; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quotemill.llm import common

WINDOW = 5
MIN_WORDS, MAX_REPEATED = 10, 20
#: Of a document's word characters, in hundredths, that it may lose with failing lines.
MAX_LOST = 50
SYMBOLS = "#*$%&|<>"
#: Marks between the entries of navigation lines, and phrases of boilerplate.
SEPARATORS, MIN_SEPARATORS = "|»›•·", 3
BOILERPLATE = "(cookie policy|accept cookies|javascript|all rights reserved|terms of (use|service)|privacy policy|click here|sign (in|up)|log ?in|subscribe|newsletter|read more|lorem ipsum|copyright|is licensed under)"
#: Symbols and exclamation marks of a line's characters, in hundredths; words that a line without any punctuation may have.
MAX_SYMBOLS, MAX_SHOUTS, MAX_UNPUNCTUATED = 10, 5, 30
_STOPS = ".,;:!?…。！？"


def _count(line: Column, chars: str) -> Column:
    return F.length(line) - F.length(F.translate(line, chars, ""))


def _line_fails(line: Column) -> Column:
    size = F.length(line)
    spaces = _count(line, " ")
    return (
        (_count(line, SEPARATORS) >= MIN_SEPARATORS)
        | (_count(line, SYMBOLS) * 100 > size * MAX_SYMBOLS)
        | (_count(line, "!") * 100 > size * MAX_SHOUTS)
        | ((spaces >= MAX_UNPUNCTUATED) & (_count(line, _STOPS) == 0))
        | F.lower(line).rlike(BOILERPLATE)
    )


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words in windows that occur twice or more, counted once each."""
    dealt = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(sorted_: Column) -> Column:
        again = F.filter(sorted_, lambda x, k: (x["h"] == F.get(sorted_, k - 1)["h"]) | (x["h"] == F.get(sorted_, k + 1)["h"]))
        starts = F.sort_array(F.transform(again, lambda x: x["i"]))
        return F.aggregate(F.transform(F.array(starts), lambda s: F.aggregate(s, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("at")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["at"])).alias("n"), x.alias("at")), lambda acc: acc["n"])), F.lit(0).cast("long"), lambda a, b: a + b)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(dealt), covered), 1))


def line_quality(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and verdicts, and ``cleaned``: the text without failing lines."""
    spaces = F.lit(common.SPACES)
    has_word = lambda x: F.btrim(x, spaces) != ""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_t"))
    split = base.select("doc_id", "_t", common.words_of(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n", -1), has_word).alias("_l"))
    w = F.col("_w")
    # xxhash64 of the window's words: equal windows have equal hashes, and 64 bits tell the others of a text apart.
    at = lambda i, k: F.get(w, i + k)
    hashes = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    counted = split.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate("_t", common.SPACES, "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        "_w",
        hashes.alias("_h"),
        F.array_join(F.filter("_l", lambda x: ~_line_fails(x)), "\n").alias("cleaned"),
    )
    repeated = counted.withColumn("n_repeat_words", _repeat_words(F.col("_w"), F.col("_h")))
    kept_chars = F.length(F.translate("cleaned", common.SPACES, ""))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)
    return (
        repeated.withColumn("lost_chars", (F.col("word_chars") - kept_chars).cast("long"))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") * 100 <= F.col("word_chars") * MAX_LOST))
        .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "cleaned")
    )


def line_quality_query(spark, sf_dir: str) -> DataFrame:
    return line_quality(common.documents(spark, sf_dir)).drop("cleaned")


def _sql_count(x: str, chars: str) -> str:
    return f"(length({x}) - length(translate({x}, '{chars}', '')))"


ORACLE_SQL = f"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM base)),
places AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), (SELECT unnest(range({WINDOW})) AS k)),
reps AS (SELECT doc_id, count(*) AS n FROM places GROUP BY 1),
counts AS (
  SELECT base.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    {_sql_count("t", SYMBOLS)}::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words,
    array_to_string(list_filter(l, lambda x: NOT ({_sql_count("x", SEPARATORS)} >= {MIN_SEPARATORS} OR {_sql_count("x", SYMBOLS)} * 100 > length(x) * {MAX_SYMBOLS}
      OR {_sql_count("x", "!")} * 100 > length(x) * {MAX_SHOUTS} OR ({_sql_count("x", " ")} >= {MAX_UNPUNCTUATED} AND {_sql_count("x", _STOPS)} = 0)
      OR regexp_matches(lower(x), '{BOILERPLATE}'))), chr(10)) AS cleaned
  FROM base LEFT JOIN reps USING (doc_id)),
judged AS (
  SELECT *, word_chars - length(regexp_replace(cleaned, '[\\x20\\x09-\\x0D]', '', 'g')) AS lost_chars, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEATED} AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, NOT base_failed AND lost_chars * 100 <= word_chars * {MAX_LOST} AS kept FROM judged
"""
