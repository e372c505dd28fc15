"""Quality rules, line first: drop failing lines, then reject documents that lose too much.

Everything is one projection per document: no shuffle, no Python. A line fails by the first rule that holds:

* ``punctuation``: it does not end like a sentence, or marks (``! ?`` repeated, symbols) are too many for its words;
* ``navigation``: separators (``|`` and the like) stand between most of its words;
* ``boilerplate``: the fixed phrases of consent banners, scripts and page furniture are many for its words.

Lines without a word are neither counted nor removed. Null text counts as empty: no words, base fails, not kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obslab.llm.common import let, text_of, words_of

# Fixed values of the rules.
SYMBOLS = "[#*$%&|<>]+"
ENDINGS = r"[\p{Po}\p{Pe}\p{Pf}\p{Nd}“]"
UNFINISHED = r"[#*%&@/\\·•]"
BLANKS = " \t\x0b\x0c\r"
SEPARATORS = "[|»›•·→]"
MARKS = "[#*$%&<>!]"
PHRASES = (
    "accept all cookies", "add to cart", "all rights reserved", "back to top", "click here", "cookie policy",
    "enable javascript", "forgot your password", "lorem ipsum", "privacy policy", "read more", "share on facebook",
    "sign up for our newsletter", "skip to content", "terms of use", "we use cookies",
)
REPEAT_WINDOW = 3


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the documents' loss."""

    least_words: int = 50
    most_repeat_percent: int = 50
    marks_per_word: float = 0.5
    separators_per_word: float = 0.2
    ending_from_words: int = 8
    words_per_phrase: int = 16
    most_lost: float = 0.5


def repeat_words(words: Column) -> Column:
    """Number of words that lie in a three-word window found twice or more, all its places counted."""

    def windows(w: Column) -> Column:
        starts = F.when(F.size(w) >= REPEAT_WINDOW, F.sequence(F.lit(0), F.size(w) - REPEAT_WINDOW))
        hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + F.lit(k)) for k in range(REPEAT_WINDOW))))
        return F.coalesce(hashes, F.array().cast("array<bigint>"))

    def placed(h: Column) -> Column:
        return F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return (x.h.eqNullSafe(F.get(s, k - 1).h)) | (x.h.eqNullSafe(F.get(s, k + 1).h))

        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x.i))

    def covered(p: Column) -> Column:
        def fresh(x: Column, k: Column) -> Column:
            return F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(REPEAT_WINDOW)))

        return F.aggregate(F.transform(p, fresh), F.lit(0).cast("bigint"), lambda total, g: total + g)

    # Most texts repeat no window; only the others are sorted.
    return let(let(words, windows), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), let(let(placed(h), repeated), covered)).otherwise(F.lit(0).cast("bigint")))


def count_marks(text: Column, pattern: str) -> Column:
    """How many characters match ``pattern``, a class of single characters."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{pattern.rstrip('+')}+", ""))


def count_phrase(low: Column, phrase: str) -> Column:
    """How many times ``phrase`` stands in the lower-case text."""
    return F.floor((F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / len(phrase))


def line_fault(line: Column, rules: LineRules) -> Column:
    """Name of the first rule that the line breaks, else null. Cheap tests guard those that count words."""
    n = F.size(words_of(line))
    crowded = F.when(count_marks(line, SEPARATORS) > rules.separators_per_word * n, "navigation").when(
        count_marks(line, MARKS) > rules.marks_per_word * n, "punctuation"
    )
    def phrased(low: Column) -> Column:
        found = reduce(add, [count_phrase(low, p) for p in PHRASES])
        return F.when(reduce(or_, [low.contains(p) for p in PHRASES]), found * rules.words_per_phrase >= n).otherwise(False)

    def unended(last: Column) -> Column:
        return ~last.rlike(ENDINGS) | last.rlike(UNFINISHED)

    return F.coalesce(
        F.when(let(F.lower(line), phrased), "boilerplate"), F.when(line.rlike(f"{SEPARATORS}|{MARKS}"), crowded),
        F.when(let(F.right(F.rtrim(line, F.lit(BLANKS)), F.lit(1)), unended), F.when(n >= rules.ending_from_words, "punctuation")),
    )


def quality_rules(df: DataFrame, rules: LineRules = LineRules(), text: str = "text", into: str = "quality") -> DataFrame:
    """All rows and columns, plus one struct column ``into``; a column that has its name already is replaced.

    It holds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_text (the lines
    that passed, in order, and all lines without a word), faults (rule names of the lines removed, in order),
    lost (share of the characters on worded lines that went) and kept. Repeated rows are judged alike, each by itself;
    an empty table gives an empty table.
    """
    source = text_of(text)

    def judged(t: Column) -> Column:
        lines = F.transform(
            F.split(t, "\n"),
            lambda line: F.struct(
                line.alias("line"), line.rlike(r"[^\x20\x09-\x0D]").alias("worded"), line_fault(line, rules).alias("fault")
            ),
        )

        def told(rows: Column) -> Column:
            worded = F.filter(rows, lambda r: r.worded)
            failed = F.filter(worded, lambda r: r.fault.isNotNull())
            total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda s, r: s + F.length(r.line))
            names = F.transform(worded, lambda r: r.line)
            return F.struct(
                (F.size(names) - F.size(F.array_distinct(names))).cast("bigint").alias("n_dup_lines"),
                F.transform(failed, lambda r: r.fault).alias("faults"),
                F.array_join(
                    F.transform(F.filter(rows, lambda r: ~r.worded | r.fault.isNull()), lambda r: r.line), "\n"
                ).alias("clean_text"),
                F.coalesce(F.try_divide(total(failed), total(worded)), F.lit(0.0)).alias("lost"),
            )

        return let(lines, told)

    def counted(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)).alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        )

    parts = F.struct(let(words_of(source), counted).alias("counts"), judged(source).alias("lines"))
    counts, lines = F.col(into).counts, F.col(into).lines
    base = (counts.n_words < rules.least_words) | (100 * counts.n_repeat_words > rules.most_repeat_percent * counts.n_words)
    quality = F.struct(
        counts.n_words.alias("n_words"), counts.word_chars.alias("word_chars"),
        count_marks(source, SYMBOLS).cast("bigint").alias("n_symbols"), lines.n_dup_lines.alias("n_dup_lines"),
        counts.n_repeat_words.alias("n_repeat_words"), base.alias("base_failed"), lines.clean_text.alias("clean_text"),
        lines.faults.alias("faults"), lines.lost.alias("lost"), (~base & (lines.lost <= rules.most_lost)).alias("kept"),
    )
    return df.withColumn(into, parts).withColumn(into, quality)
