"""Column expressions on text: tokens, shingles, samples and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import SAMPLE_CHARS

# Runs of letters, digits and underscores, or one other
# character that is no blank in any script; and the blanks that part words.
WORD_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85]"
BLANK_PATTERN = r"(?U)[\s\x1c-\x1f]+"


def required_text(column: str | Column) -> Column:
    """Text that must be present: the job stops at a null."""
    text = F.col(column) if isinstance(column, str) else column
    return F.when(
        text.isNull(), F.raise_error(F.lit("the text column holds a null; filter or fill it first"))
    ).otherwise(text.cast("string"))


def lenient_text(column: str | Column) -> Column:
    """Any value as text; a null reads as ``None``."""
    value = F.col(column) if isinstance(column, str) else column
    return F.coalesce(value.cast("string"), F.lit("None"))


def words_and_marks(text: Column) -> Column:
    """Words and punctuation marks in order and with repeats, case kept."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def word_tokens(text: Column) -> Column:
    """The set of words and punctuation marks."""
    return F.array_distinct(words_and_marks(text))


def blank_tokens(text: Column) -> Column:
    """Words between blanks, in order and with repeats."""
    return F.filter(F.split(text, BLANK_PATTERN), lambda word: word != "")


def word_runs(words: Column, n: int) -> Column:
    """Runs of ``n`` words joined by a blank; none when there are fewer words.

    ``words`` must be a plain column, since it is used once per word of a run.
    """
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    runs = F.slice(words, F.lit(1), count)
    for at in range(2, n + 1):
        runs = F.zip_with(
            runs, F.slice(words, F.lit(at), count), lambda run, word: F.concat(run, F.lit(" "), word)
        )
    return runs


def word_shingles(words: Column, n: int) -> Column:
    """The set of such runs."""
    return F.array_distinct(word_runs(words, n))


def sample(text: Column, chars: int = SAMPLE_CHARS) -> Column:
    """The first characters for display, marked when something was left out."""
    return F.when(
        F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("..."))
    ).otherwise(text)


def lines(text: Column) -> Column:
    """Lines of a text, without an empty one after a closing line break."""
    parts = F.split(text, r"\R")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(
        parts
    )
