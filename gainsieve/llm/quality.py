"""Line-first cleaning of documents, in DataFrame functions only.

Every line is judged by itself: by its punctuation, by signs of navigation and by
boilerplate phrases. Lines that fail are removed; a document that loses too much of its
text, or fails the base measures, is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gainsieve.llm.common import BLANKS, fenced, others, words_of

SYMBOLS = "#*$%&|<>"
#: Phrases of lines that belong to the site or the licence, not to the text (lower case).
BOILERPLATE = [
    "all rights reserved",
    "licensed under the",
    "is licensed under",
    "terms of service",
    "terms of use",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "uses cookies",
    "enable javascript",
    "click here",
    "subscribe to our",
    "sign up for",
    "lorem ipsum",
]
SEPARATOR = r"[|»«›‹·•→>]"
#: The end of a word in marks no sentence puts there: symbols, or a run of ! and ?.
MARKED_END = r"(?:[#*$%&|<>]|[!?][!?])[.,;:]?[\x20\x09-\x0D]"
#: Only lines with one of these can fail the punctuation and navigation rules.
ODD = r"[#*$%&|<>»«›‹·•→]|[!?][!?]"
WORD = r"[^\x20\x09-\x0D]+"
SENTENCE_END = r"""[.!?…:;。！？]["'”’»)\]]*$"""

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*MEASURES, "base_failed", "kept", "n_lines", "n_bad_lines", "clean_chars"]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def bad_line(line: Column, lowered: Column, marked_share: float, separators: int, title_words: int) -> Column:
    """Whether a line fails a rule; ``lowered`` is the line in lower case, or null if it is too long for a notice.

    Punctuation: at least ``marked_share`` of the words end in symbols or runs of ``!?``.
    Navigation: at least ``separators`` separator signs, or at most ``title_words`` words
    of which none ends a sentence and one holds a separator. Boilerplate: a known phrase.
    """
    words = _count(line, WORD)
    marked = _count(F.concat(line, F.lit(" ")), MARKED_END)
    signs = _count(line, SEPARATOR)
    phrase = F.coalesce(reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(p)) for p in BOILERPLATE]), F.lit(False))
    menu = (signs >= 1) & (words <= title_words) & ~F.btrim(line, F.lit(BLANKS)).rlike(SENTENCE_END)
    many_marked = F.when(marked > 0, marked >= marked_share * words).otherwise(False)
    return phrase | F.when(line.rlike(ODD), (signs >= separators) | menu | many_marked).otherwise(False)


def clean_documents(
    df: DataFrame,
    text: str = "text",
    least_words: int = 50,
    repeat_percent: int = 50,
    least_left: float = 0.5,
    marked_share: float = 0.3,
    separators: int = 3,
    title_words: int = 12,
    notice_chars: int = 300,
    clean_text: str = "clean_text",
) -> DataFrame:
    """The rows of ``df`` with the measures, the verdict and the text without failed lines.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    n_lines, n_bad_lines, clean_chars`` and ``clean_text``; columns that already have one of
    these names are replaced. ``kept`` is false when ``base_failed`` or when the lines left
    hold less than ``least_left`` of the characters in words. Boilerplate phrases count in
    lines of at most ``notice_chars`` characters; longer lines are prose that mentions one.

    A null or blank text has no words, fails and has an empty clean text. Repeated rows are
    each judged alike; an empty table gives an empty table. Lines are separated by ``\\n`` alone.
    All work is per row and in the JVM: no shuffle, no Python.

    Repeated windows are looked for by hash first; only documents in which a hash repeats sort
    their windows as text, so the count is exact.
    """
    rows = df.select(F.struct(*others(df, *RESULTS, clean_text)).alias("row"), F.coalesce(df[f"`{text}`"], F.lit("")).alias("t"))
    rows = rows.select("row", "t", words_of(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    starts = F.slice("w", 1, F.greatest(F.size("w") - 2, F.lit(0)))
    rows = rows.withColumn("h", F.transform(starts, lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))))
    rows = rows.withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda _, i: F.struct(F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("g"), i.alias("i")))),
        ),
    )
    same = lambda x, i: F.coalesce(F.get("s", i - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("s", i + 1)["g"] == x["g"], F.lit(False))
    found = F.sort_array(F.transform(F.filter("s", same), lambda x: x["i"]))
    covered = F.aggregate(
        found,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    lowered = F.transform("lines", lambda x: F.struct(x.alias("line"), F.when(F.length(x) <= notice_chars, F.lower(x)).alias("low")))
    judged = F.transform(lowered, lambda x: F.struct(x["line"].alias("line"), bad_line(x["line"], x["low"], marked_share, separators, title_words).alias("bad")))
    rows = rows.select("row", "t", "lines", F.size("w").alias("n"), fenced(F.coalesce(covered, F.lit(0))).alias("repeats"), judged.alias("judged"))
    rows = rows.withColumn("left", F.array_join(F.transform(F.filter("judged", lambda x: ~x["bad"]), lambda x: x["line"]), "\n"))
    chars = lambda c: F.length(_without(F.col(c), BLANKS))
    rows = rows.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        chars("t").cast("long").alias("word_chars"),
        F.when(F.col("t").rlike(f"[{SYMBOLS}]"), F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("repeats").cast("long").alias("n_repeat_words"),
        ((F.col("n") < least_words) | (100 * F.col("repeats").cast("long") > repeat_percent * F.col("n"))).alias("base_failed"),
        F.size("judged").cast("long").alias("n_lines"),
        F.size(F.filter("judged", lambda x: x["bad"])).cast("long").alias("n_bad_lines"),
        chars("left").cast("long").alias("clean_chars"),
        F.col("left").alias(clean_text),
    )
    kept = ~F.col("base_failed") & (F.col("clean_chars") >= least_left * F.col("word_chars"))
    return rows.select("row.*", *MEASURES, "base_failed", fenced(kept).alias("kept"), "n_lines", "n_bad_lines", "clean_chars", clean_text)
