"""Column expressions over headline text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Company suffixes removed, in this order.
COMPANY_SUFFIXES = [" Inc.", " Corp.", " Corporation", " Ltd.", " Limited", " LLC", ","]


def normalise(col: Column) -> Column:
    """Lower-cased text with runs of white space collapsed and the ends trimmed; null stays null."""
    return F.lower(F.trim(F.regexp_replace(col, r"\s+", " ")))


def normalise_or_empty(col: Column) -> Column:
    return normalise(F.coalesce(col, F.lit("")))


def not_blank(col: Column) -> Column:
    return F.coalesce(F.trim(col), F.lit("")) != ""


def clean_name(col: Column) -> Column:
    for suffix in COMPANY_SUFFIXES:
        col = F.replace(col, F.lit(suffix), F.lit(""))
    return F.trim(col)


def article_hash(title: Column, url: Column) -> Column:
    return F.sha2(F.concat(normalise_or_empty(title), F.lit("|"), normalise_or_empty(url)), 256)


def domain(url: Column, lower: bool = True) -> Column:
    """Network location of a URL without ``www.``; the port stays, nothing found gives null."""
    host = F.replace(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), F.lit("www."), F.lit(""))
    host = F.trim(F.lower(host) if lower else host)
    return F.when(host != "", host)


def first_paragraph(content: Column, block_chars: int | None = None, other_chars: int | None = None) -> Column:
    """First block longer than 80 characters, else the text; with the arguments at most so many characters of either."""
    cut = lambda c, n: c if n is None else F.substring(c, 1, n)
    ends = r"^\s+|\s+$"
    whole = F.regexp_replace(F.coalesce(content, F.lit("")), ends, "")
    blocks = F.transform(F.split(whole, r"\n{2,}|\r\n\r\n"), lambda b: F.regexp_replace(b, ends, ""))
    block = F.get(F.filter(blocks, lambda b: F.length(b) > 80), F.lit(0))
    return F.coalesce(cut(block, block_chars), cut(whole, other_chars))


def _first_word(name: Column) -> Column:
    return F.regexp_extract(F.coalesce(name, F.lit("")), r"(\S+)", 1)


def _find(text: Column, needle: Column) -> Column:
    """1-based position of ``needle`` ignoring case; 0 when absent or when the needle is empty."""
    return F.when(needle != "", F.instr(F.lower(text), F.lower(needle))).otherwise(F.lit(0))


def choose_text(title: Column, paragraph: Column, name: Column) -> Column:
    """The paragraph if it is longer than 100 characters and mentions the firm or its first word, else the title."""
    name = F.coalesce(name, F.lit(""))
    mentions = (name == "") | (_find(paragraph, name) > 0) | (_find(paragraph, _first_word(name)) > 0)
    return F.when((F.length(paragraph) > 100) & mentions, paragraph).otherwise(title)


def split_target(text: Column, name: Column) -> Column:
    """Struct (left, target, right) around the firm; short sides are padded with the whole text."""
    word = _first_word(name)
    at_name, at_word = _find(text, name), _find(text, word)
    at = F.when(at_name > 0, at_name).otherwise(at_word)
    size = F.when(at_name > 0, F.length(name)).otherwise(F.length(word))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    filled = lambda c: F.when(trimmed(c) == "", F.lit(" ")).otherwise(trimmed(c))
    left = F.when(at > 0, filled(F.substring(text, F.lit(1), at - 1))).otherwise(filled(text))
    right = F.when(at > 0, filled(F.substring(text, at + size, F.length(text)))).otherwise(F.lit(" "))
    target = F.when(at > 0, F.substring(text, at, size)).otherwise(name)
    short = (F.length(trimmed(left)) < 3) | (F.length(trimmed(right)) < 3)
    return F.struct(
        F.when(short, text).otherwise(left).alias("left"),
        target.alias("target"),
        F.when(short, text).otherwise(right).alias("right"),
    )


def stars(p: Column) -> Column:
    """p-value with three decimals and significance stars; null gives N/A."""
    shown = F.format_string("%.3f", p)
    return (
        F.when(p.isNull() | F.isnan(p), F.lit("N/A"))
        .when(p < 0.01, F.concat(shown, F.lit("***")))
        .when(p < 0.05, F.concat(shown, F.lit("**")))
        .when(p < 0.10, F.concat(shown, F.lit("*")))
        .otherwise(shown)
    )
