"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a word in the tokenisers here.
WORD = "[\\p{L}\\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def ngrams(words: Column, n: int) -> Column:
    """Runs of ``n`` words, joined by spaces."""

    def runs(w: Column) -> Column:
        count = F.size(w) - n + 1
        joined = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(count >= 1, joined).otherwise(F.array().cast("array<string>"))

    # As a variable of a lambda, the words are made once and not for every run.
    return F.transform(F.array(words), runs)[0]


def strip_html(html: Column) -> Column:
    """Text of a page without scripts, styles and tags, blanks collapsed; entities stay as they are."""
    bare = F.regexp_replace(html, "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]*>", " "), "[ \\t\\n\\r]+", " "))


def upper_eszett(text: Column) -> Column:
    """Upper case with SS for the sharp s."""
    return F.upper(F.replace(text, F.lit("ß"), F.lit("ss")))
