"""Text columns: tokens, HTML, normalisation, folding.  Built-in expressions; pandas only where none exists."""

from __future__ import annotations

import html
import html.entities
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A token is a run of letters and digits of any script (the underscore is neither).
TOKEN = r"[\p{L}\p{N}]+"
#: White space as Python's \s means it, for Java patterns.
WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WS_INLINE = r"[ \t\x0b\f\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Elements that make a text HTML, that are dropped with their content, and that break lines.
HTML_HINTS = ("p", "div", "br", "span", "body", "html")
DROPPED = ("script", "style", "head", "noscript")
BLOCKS = ("p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "hr", "section", "article", "table", "ul", "ol")


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))


def spaced(text: Column) -> Column:
    """The tokens as one text, a blank between two: faster to pass on than a list."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " "))


def looks_like_html(text: Column) -> Column:
    return text.rlike(r"(?i)<\s*(" + "|".join(HTML_HINTS) + r")\b")


def strip_markup(markup: Column) -> Column:
    """Comments, then elements that carry no text, then tags; block tags become line breaks; entities stay."""
    out = F.regexp_replace(markup, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?is)<\s*(" + "|".join(DROPPED) + r")\b[^>]*>.*?<\s*/\s*\1\s*>", "")
    out = F.regexp_replace(out, r"(?i)<\s*/?\s*(?:" + "|".join(BLOCKS) + r")\b[^>]*>", "\n")
    return F.regexp_replace(out, r"<[^>]+>", "")


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


#: A character reference: decimal, hexadecimal, or a name of up to 32 letters and digits.
REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][0-9A-Za-z]{0,31};?)"
#: What the numbers 128 to 159 mean, by the HTML standard (code page 1252; five stand for themselves).
WINDOWS = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
#: The standard's named references, of Python's table; those that may stand without a semicolon are in it so, too.
NAMES = html.entities.html5


def _names(wanted: Iterable[str]) -> Column:
    """A map from names to what they stand for: one constant of the plan, made from one string."""
    told = "\x1e".join(f"{name}\x1f{NAMES[name]}" for name in sorted(wanted))
    return F.str_to_map(F.lit(told), F.lit("\x1e"), F.lit("\x1f"))


def _numbered(reference: Column) -> Column:
    """The character of a numeric reference: the replacement character where there is none, nothing for controls."""
    digits = F.regexp_extract(reference, r"^#[xX]?0*([0-9a-fA-F]*);?$", 1)
    hexadecimal = F.lower(F.substring(reference, 2, 1)) == "x"
    n = F.when(F.length(digits) > 8, F.lit(0x110000).cast("long")).when(digits == "", F.lit(0).cast("long")).when(hexadecimal, F.conv(digits, 16, 10).cast("long")).otherwise(F.conv(digits, 10, 10).cast("long"))
    none = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    # white space but the form feed stays, other controls and non-characters go
    control = n.between(1, 8) | n.between(0xE, 0x1F) | (n == 0xB) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(none, F.lit(0x20).cast("long")).otherwise(n)), 8, "0")), "UTF-32")
    return F.when(none, "\ufffd").when(n == 13, "\r").when(n.between(128, 159), F.substring(F.lit(WINDOWS), (n - 127).cast("int"), F.lit(1))).when(control, "").otherwise(char)


def _named(reference: Column) -> Column:
    """What a name stands for; else the longest name without semicolon that it begins with, and the rest; else itself."""
    whole = F.try_element_at(_names(NAMES), reference)
    short = _names(n for n in NAMES if not n.endswith(";"))
    ends = F.filter(F.sequence(F.least(F.length(reference), F.lit(7)), F.lit(2), F.lit(-1)), lambda i: F.try_element_at(short, reference.substr(F.lit(1), i)).isNotNull())
    end = F.try_element_at(F.when(F.length(reference) >= 2, ends), F.lit(1))
    part = F.concat(F.try_element_at(short, reference.substr(F.lit(1), end)), reference.substr(end + 1, F.length(reference)))
    return F.coalesce(whole, part, F.concat(F.lit("&"), reference))


def decode_references(text: Column) -> Column:
    """All character references of HTML, by name and by number, decoded once; built-in functions alone.

    Texts are cut at their references, which are decoded each and joined with what lies between.
    """
    found = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    decoded = F.transform(found, lambda r: F.when(r.startswith("#"), _numbered(r)).otherwise(_named(r)))
    joined = F.array_join(F.transform(F.zip_with(F.split(text, REFERENCE, -1), decoded, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: F.concat(x["a"], F.coalesce(x["b"], F.lit("")))), "")
    return F.when(text.contains("&"), joined).otherwise(text)


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def html_to_text(markup: Column, built_in: bool = True) -> Column:
    """Text of HTML; references are decoded last, so an escaped tag stays text.

    Spark 4.1 may fail to plan a Python function over an expression with lambdas that a row uses twice: what goes on to
    ``normalise`` in one expression is decoded with ``built_in=False``, in the worker that NFKC needs anyway.
    """
    return decode_references(strip_markup(markup)) if built_in else _unescape(strip_markup(markup))


def normalise_spacing(text: Column) -> Column:
    """Line ends, page marks ([*12] anywhere, *12 alone on a line), runs of blanks, at most one empty line, no edges."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"\[\*\d+\]", "")
    out = F.regexp_replace(out, r"(?m)^[ \t]*\*\d+[ \t]*$", "")
    out = F.regexp_replace(out, WS_INLINE + "+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.regexp_replace(out, rf"^{WS}+|{WS}+$", "")


def normalise(text: Column) -> Column:
    """NFKC, then spacing.  ASCII texts need no NFKC, so only the others are sent to Python."""
    return normalise_spacing(F.when(text.rlike(r"[^\x00-\x7f]"), _nfkc(text)).otherwise(text))


def snippet(text: Column, width: int = 220) -> Column:
    """One line of at most width characters, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, WS + "+", " "))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, width)), F.lit("…")))


def fold_query(query: Column, unicode_fold: bool = True) -> Column:
    """The form in which queries are compared: one space for runs, no edges, case folded."""
    flat = F.regexp_replace(F.regexp_replace(query, WS + "+", " "), "^ | $", "")
    return _casefold(flat) if unicode_fold else F.lower(flat)
