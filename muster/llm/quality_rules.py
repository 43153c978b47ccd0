"""Line-first quality rules, in built-in functions only.

Every line is judged first: lines with runs of symbols or shouting (punctuation), separator
lists (navigation) and short site notices (boilerplate) fail and are removed; then a document
that lost too much of its text, or that breaks one of the two document rules, is rejected.

Defined results: a null text has no words and no lines; it is rejected like an empty one.
Repeated rows each get their own, equal result. Other columns are kept as they are unless
they carry the name of a result column, which then replaces them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import SPACED_WORD, let

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """Thresholds of the rules; the expressions hold no nested repeats, and every SQL engine reads them."""

    fewest_words: int = 10
    most_repeat_percent: int = 20
    window: int = 5
    symbols: str = r"[#*$%&|<>]"
    #: A line fails where three words in a row end in symbols or in repeated exclamation marks.
    punctuation: str = (r"(?:[#*$%&<>]{2}|!!)(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D#*$%&<>!]*"
                        r"(?:[#*$%&<>]{2,}|!{2,})){2}(?:[\x20\x09-\x0D]|\z)")
    #: A line fails if it holds at least three separators, as menus and link lists do.
    navigation: str = r"[|»·][^|»·]*[|»·][^|»·]*[|»·]"
    #: A short line fails if it is a notice of the site rather than part of the text.
    boilerplate: str = (r"(?i)\b(?:cookies?|javascript|privacy policy|terms of (?:use|service)|"
                        r"subscribe|newsletter|log ?in|sign (?:in|up)|click here|read more)\b")
    notice_chars: int = 120
    #: A document is rejected if failing lines hold more than this share of its word characters.
    most_lost: float = 0.5


def repeated_words(words: Column, window: int) -> Column:
    """Words inside a window of ``window`` words that stands at least twice in the document.

    Windows are compared by 64-bit hashes of their words' hashes, within one document.
    """
    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spots(pairs: Column) -> Column:
            again = F.filter(pairs, lambda p, k: (
                F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False))
                | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False))))
            return F.sort_array(F.transform(again, lambda p: p["i"]))

        def total(starts: Column) -> Column:
            fresh = F.transform(starts, lambda s, k: F.least(
                F.lit(window), F.coalesce(F.get(starts, k + 1) - s, F.lit(window))))
            return F.aggregate(fresh, F.lit(0).cast("long"), lambda a, b: a + b)

        return let(let(ordered, spots), total)

    def count(hashes: Column) -> Column:
        # the last, incomplete windows are cut off again
        windows = F.slice(F.transform(hashes, lambda h, i: F.xxhash64(
            h, *[F.get(hashes, i + k) for k in range(1, window)])),
            1, F.greatest(F.size(hashes) - (window - 1), F.lit(0)))
        return let(windows, lambda w: F.when(
            F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(covered(w)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), count)


def line_fails(line: Column, rules: Rules) -> Column:
    return (line.rlike(rules.punctuation) | line.rlike(rules.navigation)
            | ((F.length(line) <= rules.notice_chars) & line.rlike(rules.boilerplate)))


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def judge(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """Add the counts, ``base_failed``, ``lost`` (share of word characters in failing lines),
    ``clean_text`` (the lines that passed) and ``kept``."""
    body = F.coalesce(F.col(text), F.lit(""))

    def lines_of(lines: Column) -> Column:
        worded = F.filter(lines, lambda x: x.rlike(SPACED_WORD))
        failing = F.filter(lines, lambda x: line_fails(x, rules))
        return F.struct(
            let(worded, lambda w: F.size(w) - F.size(F.array_distinct(w))).cast("long").alias("dup"),
            word_chars(F.array_join(failing, "\n")).alias("lost"))

    def words_of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n"),
            F.length(F.array_join(words, "")).cast("long").alias("chars"),
            repeated_words(words, rules.window).alias("repeat"))

    found = docs.withColumn("__w", let(F.regexp_extract_all(body, F.lit(SPACED_WORD), F.lit(0)), words_of))
    found = found.withColumn("__l", let(F.split(body, "\n"), lines_of))
    found = found.withColumns({
        "n_words": F.col("__w.n"), "word_chars": F.col("__w.chars"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, rules.symbols, ""))).cast("long"),
        "n_dup_lines": F.col("__l.dup"), "n_repeat_words": F.col("__w.repeat"),
        "clean_text": F.array_join(F.filter(F.split(body, "\n"), lambda x: ~line_fails(x, rules)), "\n"),
        "lost": F.col("__l.lost")}).drop("__w", "__l")
    failed = ((F.col("n_words") < rules.fewest_words)
              | (100 * F.col("n_repeat_words") > rules.most_repeat_percent * F.col("n_words")))
    lost = F.coalesce(F.try_divide("lost", "word_chars"), F.lit(0.0))
    found = found.withColumn("base_failed", failed).withColumn("lost", lost)
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= rules.most_lost))


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with their own columns and whole text."""
    columns = docs.columns
    bare = docs.select(F.struct(*columns).alias("__doc"), F.col(text).alias("__text"))
    return judge(bare, "__text", rules).where(F.col("kept")).select("__doc.*")
