"""Visible text of web pages by expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose text is not shown, and tags that end a line.
HIDDEN = ("script", "style", "head", "noscript", "xml")
BLOCKS = "p|div|br|tr|li|h[1-6]|table|ul|ol|section|article|header|footer|title"
REFERENCE = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{0,30})(?:;|\\b)"
#: What is done to the text in the end, in order: control characters, bars at a line's end and begin, blanks, empty lines.
CLEANING = (("[\\x00-\\x08\\x0e-\\x1f]", ""), ("(\\n\\s*)\\|\\s*", "$1"), ("[ \\t]*\\|[ \\t]*(\\n|\\z)", "$1"), ("[ \\t]+", " "), (" *\\n *", "\n"), ("\\n{3,}", "\n\n"), ("\\A\\s+|\\s+\\z", ""))


def unescaped(text: Column) -> Column:
    """Character references as characters: by number, or by a name of HTML 4. Unknown ones stay."""
    named = F.create_map(*[F.lit(x) for name, point in sorted(name2codepoint.items()) for x in (name, chr(point))])

    def read(ref: Column) -> Column:
        bare = F.regexp_replace(ref, "^&|;$", "")
        number = F.when(bare.rlike("^#[xX]"), F.conv(F.substring(bare, 3, 9), 16, 10)).when(bare.startswith("#"), F.substring(bare, 2, 9)).try_cast("int")
        sign = F.when(number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        return F.coalesce(sign, F.try_element_at(named, bare), ref)

    parts = F.arrays_zip(F.split(text, REFERENCE).alias("text"), F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), read).alias("sign"))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.coalesce(p["sign"], F.lit("")))), "")).otherwise(text)


def visible(html: Column) -> Column:
    """Text outside hidden elements and comments: a line for each block, `` | `` between the cells of a row, one blank in a row, one empty line at most."""
    hidden = "|".join(f"<{tag}\\b.*?</{tag}\\s*>" for tag in HIDDEN)
    text = F.regexp_replace(F.regexp_replace(html, "(?is)<!--.*?-->", ""), f"(?is){hidden}", "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[\\r\\n]", " "), f"(?i)</?(?:{BLOCKS})\\b[^>]*>", "\n"), "(?i)<t[dh]\\b[^>]*>", " | ")
    text = F.replace(unescaped(F.regexp_replace(text, "(?s)<[^>]*>", "")), F.lit("\xa0"), F.lit(" "))
    for pattern, by in CLEANING:
        text = F.regexp_replace(text, pattern, by)
    return text
