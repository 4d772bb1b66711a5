"""Quality rules, line first: clean the lines, then judge what is left of the document.

Everything is a DataFrame expression on one row, so no shuffle is needed and a long
text costs no other task anything.  Repeated word windows are found by sorting the
window hashes of the row, not by comparing windows with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and phrases of the line rules.
SPACES = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
TERMINAL = '.!?…:;)]"”»。！？'
SEPARATORS = r"[|»›•][^|»›•]*[|»›•]"
NAVIGATION = r"(?i)^[^a-z]*(home|menu|log in|login|sign in|sign up|next|previous|read more|click here|share|search|back to top|contact us|about us)([^a-z]|\z)"
BOILERPLATE = ["cookie policy", "use of cookies", "uses cookies", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "subscribe to our", "lorem ipsum"]

#: A document is rejected if it loses more than this share of its word characters (in tenths).
LOST_TENTHS = 3


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule; a line without a word breaks none.

    Punctuation: it must end a sentence, hold at most one symbol in ten words and not be
    in capitals throughout (three words or more).  Navigation: two separators, or a short
    line that opens with a menu word.  Boilerplate: a stock phrase of notices.
    """
    # Word counts come last in each rule, for the few lines that all else lets through.
    words = F.regexp_count(line, F.lit(WORD))
    last = F.substring(F.rtrim(line, F.lit(SPACE_CHARS)), -1, 1)
    symbols = line.rlike(SYMBOL) & (F.regexp_count(line, F.lit(SYMBOL)) * 10 > words)
    shouted = ~line.rlike("[a-z]") & line.rlike("[A-Z]") & (words >= 3)
    navigation = line.rlike(SEPARATORS) | (line.rlike(NAVIGATION) & (words <= 6))
    low = F.lower(line)
    phrase = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in BOILERPLATE])
    return line.rlike(WORD) & (~F.contains(F.lit(TERMINAL), last) | symbols | shouted | navigation | phrase)


def _word_chars(text: Column) -> Column:
    return F.char_length(F.array_join(F.split(text, SPACES + "+"), ""))


def quality_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` plus the counts, ``cleaned`` (the surviving lines), ``base_failed`` and ``kept``.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` (lines with a word equal to
    an earlier line) and ``n_repeat_words`` (words in three-word windows that occur twice
    or more, the first included) describe the input text.  ``base_failed``: under 50
    words, or more than half of them repeat.  ``kept`` is false for those, and for
    documents whose failing lines hold more than three tenths of the word characters.

    A null text counts as empty: no words, so it is rejected.  Every row is judged alone;
    repeated rows get equal verdicts, an empty table gives an empty table, and input
    columns named like a result are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "cleaned"]
    carried = [c for c in docs.columns if c.lower() not in names]
    lines = F.split(text, "\n")
    solid = F.filter(lines, lambda x: x.rlike(WORD))
    d = docs.select(
        F.struct(*carried).alias("_row"),
        F.array_remove(F.split(text, SPACES + "+"), "").alias("_w"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        solid.alias("_l"),
        F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x).alias("fails"))).alias("_j"),
    )
    # Each step below refers to an array of the step before more than once, which keeps the steps apart.
    n = F.size("_w")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    three = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    d = d.select(
        "_row",
        "n_symbols",
        F.array_join(F.transform(F.filter("_j", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned"),
        F.aggregate(F.filter("_j", lambda x: x["fails"]), F.lit(0), lambda a, x: a + _word_chars(x["line"])).alias("_lost"),
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(starts, lambda i: F.struct(three(i).alias("h"), i.alias("i")))).alias("_s"),
    )
    same = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    d = d.withColumn("_p", F.sort_array(F.transform(F.filter("_s", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))).drop("_s")
    step = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3))))
    d = d.withColumn("n_repeat_words", F.aggregate(step, F.lit(0), lambda a, x: a + x).cast("long")).drop("_p")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    verdict = ~failed & (F.col("_lost") * 10 <= F.col("word_chars") * LOST_TENTHS)
    # A filter on the verdict would else be copied below all these steps, with every step spelled out in it.
    verdict = verdict & (F.monotonically_increasing_id() >= 0)
    return d.withColumn("base_failed", failed).withColumn("kept", verdict).select("_row.*", *names)


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS ws, string_split(text, chr(10)) AS ls,
        len(regexp_extract_all(text, '{SYMBOL}')) AS n_symbols FROM d),
good AS (SELECT doc_id, ws, n_symbols, list_filter(ls, lambda l: regexp_matches(l, '{WORD}')) AS solid,
        list_filter(ls, lambda l: NOT (regexp_matches(l, '{WORD}') AND (
            NOT contains('{TERMINAL}', right(rtrim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1))
            OR len(regexp_extract_all(l, '{SYMBOL}')) * 10 > len(regexp_extract_all(l, '{WORD}'))
            OR (len(regexp_extract_all(l, '{WORD}')) >= 3 AND NOT regexp_matches(l, '[a-z]') AND regexp_matches(l, '[A-Z]'))
            OR regexp_matches(l, '{SEPARATORS}')
            OR (len(regexp_extract_all(l, '{WORD}')) <= 6 AND regexp_matches(l, '{NAVIGATION}'))
            OR len(list_filter({BOILERPLATE}, lambda p: contains(lower(l), p))) > 0))) AS cleaned FROM w),
p AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i + 1], ws[i + 2], ws[i + 3]) AS n FROM p),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n >= 2 GROUP BY doc_id),
m AS (SELECT good.doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
        (len(solid) - len(list_distinct(solid)))::BIGINT AS n_dup_lines, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words,
        len(regexp_replace(coalesce(array_to_string(cleaned, ''), ''), '{SPACES}+', '', 'g')) AS left_chars
      FROM good LEFT JOIN r ON good.doc_id = r.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (word_chars - left_chars) * 10 <= word_chars * {LOST_TENTHS} AS kept
FROM m
"""
