"""Text expressions: whitespace handling, tokenizing, stopwords."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. The token and thousands patterns and the word list decide which terms exist, so
# changing any of them changes every score.
TOKEN_PATTERN = r"[a-z]+|\d+(?:\.\d+)?"
THOUSANDS_PATTERN = r"(?<=\d),(?=\d{3}\b)"
STOPWORDS = tuple(
    """
    a about after all also an and any are as at be been before being between both but by
    can could did do does doing during each for from had has have having how if in into is
    it its itself may might more most much must of on or other our over should so some such
    than that the their them then there these they this those through to under up was we
    were what when where which while who whom why will with would you your
    """.split()
)

# Every character that counts as whitespace, the control separators and NBSP included.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B)))
              + "\u2028\u2029\u202f\u205f\u3000")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once for all its uses in ``body``.

    A column used inside a lambda is otherwise merged into it and evaluated for every element. ``element_at`` keeps the
    type of the element; ``get`` works it out again for each row, through all that ``body`` nests.
    """
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


def strip(c: Column) -> Column:
    """Remove all leading and trailing whitespace (plain ``trim`` only removes spaces)."""
    return F.trim(c, F.lit(WHITESPACE))


def tokens(text: Column) -> Column:
    """Lowercase words and numbers; thousands separators are joined, signs and currency dropped."""
    # (?U) makes \d and \b follow Unicode.
    joined = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?U)" + THOUSANDS_PATTERN, "")
    return F.regexp_extract_all(joined, F.lit("(?U)" + TOKEN_PATTERN), F.lit(0))


def without_stopwords(toks: Column) -> Column:
    return F.filter(toks, lambda t: ~t.isin(*STOPWORDS))


def tokenize(text: Column, stopwords: bool = True) -> Column:
    """Tokens of ``text``; ``stopwords=True`` removes the fixed list."""
    toks = tokens(text)
    return without_stopwords(toks) if stopwords else toks
