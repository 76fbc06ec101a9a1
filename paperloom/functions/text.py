"""Text expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java's \w knows ASCII only; this class is what \w means for Unicode text.
WORD = r"([\p{L}\p{N}_]+)"


def words(text: Column) -> Column:
    """All longest runs of letters, digits and underscores of the lower-cased text; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def squeeze(text: Column) -> Column:
    """Ends trimmed and white-space runs made one space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def strip(text: Column) -> Column:
    """Without white space at either end; the built-in trim knows spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_and_abstract(title: Column, abstract: Column) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def latex_to_words(text: Column) -> Column:
    """Greek and other named symbols become their names, accents their letters, other commands and braces disappear."""
    text = F.regexp_replace(text, r"\\[`'^\"~=.Hcuvbdrk]\{?\s*\\?([A-Za-z])\}?", "$1")
    text = F.regexp_replace(text, r"\\(?:emph|text[a-z]{0,2}|math[a-z]{0,4}|rm|it|bf|em|left|right|cite|ref|label|footnote)\b\*?", " ")
    text = F.regexp_replace(text, r"\\([A-Za-z]+)", " $1 ")
    text = F.regexp_replace(text, r"\\([%&_#$])", "$1")
    text = F.regexp_replace(text, r"[{}$~^]|\\\\", " ")
    return squeeze(text)


def starts(text: Column, lengths: Column) -> Column:
    """The prefixes of ``text`` with the given lengths, no longer than the text."""
    return F.transform(F.filter(lengths, lambda n: n <= F.length(text)), lambda n: F.substring(text, F.lit(1), n))
