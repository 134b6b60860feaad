"""Text functions: tokenizers, token filters, title and category rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinfold.functions.vectors import let

# Patterns and characters that decide the results.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
DIGITS_PATTERN = r"^\p{Nd}+$"
NON_BLANK_PATTERN = r"(?U)\S"
STORY_PATTERN = r"【([^\n]*?)[（|】]"
CATEGORY_PREFIX_CHARS = "即時"
LABEL_PREFIX = "__label__"

# The default English list of Spark ML's StopWordsRemover.
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
what's when's where's who's why's would
"""


def word_tokens(text: Column) -> Column:
    """Lower-cased runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def filter_tokens(tokens: Column) -> Column:
    """Drop one-character tokens and tokens made of digits only."""
    return F.filter(tokens, lambda w: (F.length(w) > 1) & ~w.rlike(DIGITS_PATTERN))


def default_stop_words(language: str = "english") -> list[str]:
    if language != "english":
        raise ValueError("only the English list is built in; pass any other list of words")
    return ENGLISH_STOP_WORDS.split()


def remove_stop_words(tokens: Column, words: list[str]) -> Column:
    """Drop tokens that are in ``words``, keeping repeats of the others.

    Up to a few hundred words become one hashed IN test per token.
    """
    if not words:
        return tokens
    return F.filter(tokens, lambda w: ~w.isin(list(words)))


def term_counts(tokens: Column) -> Column:
    """Distinct tokens of one row with their counts, ``ARRAY<STRUCT<term, n>>``.

    Counting happens inside the row (sort, then run lengths), so no token is
    shuffled before the per-term totals.
    """

    def run_starts(ordered: Column) -> Column:
        return F.filter(
            F.transform(ordered, lambda w, i: F.struct(w.alias("term"), i.alias("at"))),
            lambda s: (s["at"] == 0) | (s["term"] != F.get(ordered, s["at"] - 1)),
        )

    def run_lengths(starts: Column, total: Column) -> Column:
        return F.transform(
            starts,
            lambda s, i: F.struct(
                s["term"].alias("term"),
                (F.coalesce(F.get(starts, i + 1)["at"], total) - s["at"]).cast("bigint").alias("n"),
            ),
        )

    return let(
        F.sort_array(tokens),
        lambda ordered: let(run_starts(ordered), lambda starts: run_lengths(starts, F.size(ordered))),
    )


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(NON_BLANK_PATTERN)


def story_of_title(title: Column) -> Column:
    """Text between the opening bracket and the first closing mark, else null."""
    return F.when(title.rlike(STORY_PATTERN), F.regexp_extract(title, STORY_PATTERN, 1))


def strip_leading_chars(value: Column, chars: str = CATEGORY_PREFIX_CHARS) -> Column:
    """Remove any leading run of the given characters (a set, not a prefix)."""
    return F.ltrim(value, F.lit(chars))
