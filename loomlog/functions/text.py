"""Text building blocks that agree with how log tools written for ECMAScript engines read text.

Java's white space, word boundaries, dots and line ends differ from theirs; these pieces spell the differences out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Inside a character class: white space.
WS = r" \t\n\x0B\f\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
#: White space, its opposite, any character of a line. Java tries a class's parts one by one: printable ASCII is told by the first.
S, NS, ANY = rf"[\x00-\x20\x7f-\x{{ffff}}&&[{WS}]]", rf"[\x21-\x7e[^{WS}]]", r"[\x20-\x7e[^\n\r\x{2028}\x{2029}]]"
#: Word boundaries before and after a word character, and of either kind (ASCII words).
B1, B2 = r"(?<!\w)", r"(?!\w)"
B = rf"(?:{B1}(?=\w)|(?<=\w){B2})"


def sub(text: Column, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, pattern, replacement)


def rtrim(text: Column) -> Column:
    return sub(text, rf"{S}+\z", "")


def trim(text: Column) -> Column:
    return sub(text, rf"^{S}+|{S}+\z", "")


def blank(text: Column) -> Column:
    return trim(text) == ""


def token_count(text: Column) -> Column:
    """Maximal runs of anything but white space."""
    return F.regexp_count(text, F.lit(f"{NS}+")).cast("long")


def line_count(text: Column) -> Column:
    """Parts between line feeds; none in an empty text."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, "\n", -1))).cast("long")


def char_count(text: Column) -> Column:
    """UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def replace_each(text: Column, pattern: str, rewrite) -> Column:  # noqa: ANN001
    """Replace every match by ``rewrite(match)``, a function from Column to Column."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    tail = F.transform(found, lambda m, i: F.concat(rewrite(m), F.get(parts, i + 1)))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(F.get(parts, F.lit(0)), F.array_join(tail, "")))


def number_text(number: Column) -> Column:
    """A double as the shortest decimal, without a trailing ".0"."""
    return sub(number.cast("string"), r"\.0\z", "")
