"""Text functions as Column expressions: cleaning, keys, tokens, overlap, redaction, dates in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Line ends to LF, no blanks before them, at most one empty line and one blank in a row, trimmed."""
    for pattern, by in (("\\r\\n?", "\n"), ("[ \\t]+\\n", "\n"), ("\\n{3,}", "\n\n"), ("[ \\t]{2,}", " "), ("\\A\\s+|\\s+\\z", "")):
        text = F.regexp_replace(text, pattern, by)
    return text


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)))


def blank_share(text: Column) -> Column:
    """White space per 10,000 characters, rounded half up; an empty text is all white space."""
    n = F.length(text)
    blanks = n - F.length(F.regexp_replace(text, "\\s", ""))
    return F.when(n == 0, 10000).otherwise(F.floor((blanks * 20000 + n) / (2 * n)))


def language_hint(text: Column) -> Column:
    """Of the first 5,000 characters: over 15 % beyond ASCII is non_en, ten ASCII words or more en, else null."""
    head = F.substring(text, 1, 5000)
    odd = F.length(head) - F.length(F.regexp_replace(head, "[^\\x00-\\x7F]", ""))
    words = F.size(F.regexp_extract_all(head, F.lit("[A-Za-z]+"), F.lit(0)))
    return F.when(odd > 0.15 * F.length(head), "non_en").when(words >= 10, "en")


def norm(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9+#./&\\- ]+", " "), " +", " "))


def tokens(text: Column) -> Column:
    """The distinct tokens of a text; single letters are none."""
    return F.array_distinct(F.filter(F.split(norm(text), "[^a-z0-9+#]+"), lambda t: (F.length(t) > 1) | t.rlike("^[0-9]$")))


def token_f1(a: Column, b: Column) -> Column:
    """Overlap of two token arrays: 1 if both are empty, 0 if one is."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def containment(needle: Column, haystack: Column) -> Column:
    return F.when(F.size(needle) == 0, 1.0).otherwise(F.size(F.array_intersect(needle, haystack)) / F.size(needle))


def line_keys(text: Column) -> Column:
    """Lines in lower case, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.lower(x))), lambda x: x != "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


#: This engine's own list of what is hidden in texts, in order; ``values.CREDENTIALS`` is the log lines'.
SECRETS = (
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[EMAIL]"),
    ("(?i)bearer +[A-Za-z0-9._-]+", "Bearer [REDACTED]"),
    ("(?i)(password|secret|token|api_key) *[=:] *[^ \\n,;]+", "[REDACTED]"),
    ("\\+?[0-9][0-9 ()-]{8,}[0-9]", "[PHONE]"),
)


def redact(text: Column) -> Column:
    for pattern, by in SECRETS:
        text = F.regexp_replace(text, pattern, by)
    return text


def year_tokens(text: Column) -> Column:
    """The distinct years from 1970 to 2049, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit("\\b(?:19[7-9][0-9]|20[0-4][0-9])\\b"), F.lit(0))))


def holds_token(text: Column, needle: Column) -> Column:
    """The needle, in lower case, stands alone in the text: java isn't in javascript."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), "[^a-z0-9+#]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), needle, F.lit(" ")))
