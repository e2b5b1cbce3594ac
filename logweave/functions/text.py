"""Column expressions for log text; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.formats import WILDCARD, LogFormat

# The code points a Unicode-aware strip removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Splits at a run of the blanks above; U+001C..U+001F are not in \s.
_BLANK_RUN = "(?U)[\\s\\x1c-\\x1f]+"

# Joins the captured headers of one regular-expression pass.
_FIELD_MARK = "\u0001"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def joined_headers(line: Column, fmt: LogFormat, pattern: str) -> Column:
    """All headers from one regular-expression pass: written joined by a mark, then split."""
    joined = _FIELD_MARK.join(f"${{{header}}}" for header in fmt.headers)
    return F.split(F.regexp_replace(line, F.lit(pattern), F.lit(joined)), _FIELD_MARK)


def header_fields(line: Column, first_choice: Column, fmt: LogFormat) -> Column:
    """Array with one string per header, null where the line does not match.

    ``first_choice`` is ``joined_headers`` with the fast pattern, which settles nearly every
    matching line.  The rest are checked with the existence pattern before the backtracking
    one runs.  Lines that hold the mark itself are read group by group.
    """
    marked = F.contains(line, F.lit(_FIELD_MARK))
    possible = line.rlike(fmt.exists_regex)
    by_group = F.array(
        *[F.regexp_extract(line, fmt.java_regex, fmt.group_index[h]) for h in fmt.headers]
    )
    return (
        F.when((F.size(first_choice) == F.lit(len(fmt.headers))) & ~marked, first_choice)
        .when(possible & marked, by_group)
        .when(possible, joined_headers(line, fmt, fmt.java_regex))
    )


def matches_format(line: Column, fmt: LogFormat) -> Column:
    return strip(line).rlike(fmt.exists_regex)


def mask(text: Column, patterns: Iterable[str]) -> Column:
    """Replace each pattern in turn by the wildcard."""
    for pattern in patterns:
        text = F.regexp_replace(text, F.lit(f"(?Ud){pattern}"), F.lit(WILDCARD))
    return text


def tokens(text: Column) -> Column:
    """Blank-separated tokens; none for blank text."""
    return F.filter(F.split(text, _BLANK_RUN), lambda t: t != F.lit(""))


def template_text(content: Column, patterns: Iterable[str]) -> Column:
    """Masked content with single blanks between tokens."""
    return strip(F.regexp_replace(mask(content, patterns), F.lit(_BLANK_RUN), F.lit(" ")))


def token_count(text: Column) -> Column:
    """Tokens in text that already has single blanks."""
    return F.when(text == F.lit(""), F.lit(0)).otherwise(
        F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + F.lit(1)
    )


# Characters that count as digits though they are no decimal digits: superscripts, circled digits.
_OTHER_DIGITS = "".join(c for c in map(chr, range(0x110000)) if c.isdigit() and not c.isdecimal())


def has_digit(token: Column) -> Column:
    return token.rlike(f"[\\p{{Nd}}{_OTHER_DIGITS}]")


def literal_count(template_tokens: Column) -> Column:
    return F.size(F.filter(template_tokens, lambda t: t != F.lit(WILDCARD)))


def matched_literals(template_tokens: Column, line_tokens: Column) -> Column:
    """Positions where the template has a literal that the line repeats."""
    hits = F.zip_with(
        template_tokens,
        line_tokens,
        lambda a, b: (a != F.lit(WILDCARD)) & (a == b),
    )
    return F.size(F.filter(hits, lambda hit: hit))


def similarity(template_tokens: Column, line_tokens: Column) -> Column:
    """Share of positions with an equal literal, for token lists of one length."""
    return matched_literals(template_tokens, line_tokens) / F.size(template_tokens)


def merge_tokens(left: Column, right: Column) -> Column:
    """Keep equal positions, put the wildcard elsewhere."""
    return F.zip_with(left, right, lambda a, b: F.when(a == b, a).otherwise(F.lit(WILDCARD)))


def parameter_pattern(template: Column) -> Column:
    """Regular expression whose groups are the gaps of a template."""
    normal = F.regexp_replace(template, F.lit("<.{1,5}>"), F.lit(WILDCARD))
    escaped = F.regexp_replace(normal, F.lit("([^A-Za-z0-9])"), F.lit("\\\\$1"))
    spaced = F.regexp_replace(escaped, F.lit(r"\\ +"), F.lit(r"\\s+"))
    return F.concat(F.lit("(?Ud)^"), F.replace(spaced, F.lit(r"\<\*\>"), F.lit("(.*?)")), F.lit("$"))


def wildcard_count(template: Column) -> Column:
    normal = F.regexp_replace(template, F.lit("<.{1,5}>"), F.lit(WILDCARD))
    return ((F.length(normal) - F.length(F.replace(normal, F.lit(WILDCARD), F.lit("")))) / 3).cast("int")


def parameters(content: Column, pattern: Column, gaps: Column) -> Column:
    """Texts in the template's gaps; none where there are no gaps or no match."""
    found = F.transform(
        F.sequence(F.lit(1), gaps),
        lambda i: F.call_function("regexp_extract", content, pattern, i),
    )
    return F.when((gaps > 0) & F.regexp_like(content, pattern), found).otherwise(
        F.array().cast("array<string>")
    )


def contains_any(text: Column, keywords: Iterable[str]) -> Column:
    """Case-insensitive substring test for any of the keywords."""
    lowered = F.lower(text)
    hit = F.lit(False)
    for keyword in sorted({k.lower() for k in keywords}):
        hit = hit | F.contains(lowered, F.lit(keyword))
    return hit


def event_mentions(text: Column) -> Column:
    """Distinct ``EventN`` names in order of first mention."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\bEvent\d+\b"), F.lit(0)))
