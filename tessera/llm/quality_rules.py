"""Line-first cleaning of documents, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: White space that parts words, as characters and as a pattern of words.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Fixed values of the line rules.
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: A line of this many words or more must hold a full stop, question or exclamation mark or the like.
PROSE_WORDS = 12
SENTENCE_MARKS = ".?!…。！？:;"
#: Percent of words that may carry a symbol, or be bars between menu items.
MAX_SYMBOL_WORDS_PERCENT = 30
MAX_LOST_PERCENT = 40
#: Up to this many different repeated windows their places are found one by one, beyond by sorting.
FEW = 32
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "subscribe to our newsletter",
    "sign up for our",
    "click here to",
    "share this page",
    "powered by",
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text; none for a text of white space."""
    for c in SPACES[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def window_hashes(words: Column) -> Column:
    """A hash of each window of three words."""
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))


def repeated_words(hashes: Column) -> Column:
    """How many words stand in 3-word windows that the text holds twice or more, the first occurrence included.

    ``hashes``: of the windows in order. Those that repeat are found by sorting; then their places, and the words that
    the windows at these places cover.
    """

    def places(twice: Column) -> Column:
        few = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda p: F.array_contains(twice, F.get(hashes, p)))
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(twice) <= FEW, few).otherwise(_let(pairs, paired))

    def paired(pairs: Column) -> Column:
        here = lambda i: F.get(pairs, i)["h"]
        twice = F.filter(pairs, lambda x, i: (x["h"] == here(i - 1)) | (x["h"] == here(i + 1)))
        return F.sort_array(F.transform(twice, lambda x: x["p"]))

    def below(spots: Column) -> Column:
        span = F.transform(spots, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(spots, i + 1) - p, F.lit(3))))
        return F.aggregate(span, F.lit(0), lambda a, x: a + x)

    def repeats(ranked: Column) -> Column:
        return F.array_distinct(F.filter(ranked, lambda h, i: h == F.get(ranked, i - 1)))

    found = _let(_let(F.sort_array(hashes), repeats), lambda twice: _let(places(twice), below))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(found)


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def line_fails(line: Column) -> Column:
    """Whether a line breaks a rule.

    Prose rule: 12 words or more and no sentence mark. Navigation: over 30 percent as many bars, symbols or angle
    brackets as words. Shouting: 12 words or more, all in upper case, or over 30 percent as many exclamation marks as
    words. Boilerplate: one of the fixed phrases. Words are counted only where a rule needs them.
    """

    def phrases(low: Column) -> Column:
        found = F.lit(False)
        for p in BOILERPLATE:
            found = found | F.contains(low, F.lit(p))
        return found

    n = n_words(line)
    bangs = F.length(line) - F.length(F.replace(line, F.lit("!"), F.lit("")))
    return (
        (~F.rlike(line, F.lit(f"[{SENTENCE_MARKS}]")) & (n >= PROSE_WORDS))
        | (F.contains(line, F.lit("!")) & (bangs * 100 > n * MAX_SYMBOL_WORDS_PERCENT))
        | (~F.rlike(line, F.lit(r"\p{Ll}")) & F.rlike(line, F.lit(r"\p{Lu}")) & (n >= PROSE_WORDS))
        | (F.rlike(line, F.lit(f"[{SYMBOLS}]")) & (_symbols(line) * 100 > n * MAX_SYMBOL_WORDS_PERCENT))
        | _let(F.lower(line), phrases)
    )


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def clean_text(text: Column) -> Column:
    """The lines of a text that break no rule, joined by newlines."""
    return F.array_join(F.filter(_lines(text), lambda x: ~line_fails(x)), "\n")


def assess(docs: DataFrame) -> DataFrame:
    """Base statistics and the verdict on every row of ``docs``, behind its doc_id and text.

    Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost_words (long), base_failed, kept
    (boolean). base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. kept: the base
    holds and the failed lines carry 40 percent of the words or less; ``clean_text`` gives what is left of a text.
    Null texts count as empty and fail; null doc_ids and repeated rows stay; extra columns are ignored. 3-word windows
    are told apart by 64-bit hashes within a text. All in built-in expressions, with no shuffle.
    """
    text = F.col("text")
    bad = F.filter(_lines(text), line_fails)
    of_words = _let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), F.length(F.array_join(w, "")).alias("chars"), _let(window_hashes(w), repeated_words).alias("repeated")))
    base = docs.select("doc_id", text_of().alias("text")).withColumn("__words", of_words)
    base = base.select(
        "doc_id", "text", F.col("__words.n").cast("long").alias("n_words"), F.col("__words.chars").cast("long").alias("word_chars"),
        _symbols(text).cast("long").alias("n_symbols"),
        _let(_lines(text), lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
        F.col("__words.repeated").cast("long").alias("n_repeat_words"),
        F.aggregate(F.transform(bad, n_words), F.lit(0), lambda a, x: a + x).cast("long").alias("n_lost_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED_PERCENT)
    return base.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("n_lost_words") * 100 <= F.col("n_words") * MAX_LOST_PERCENT))
