"""Reading of markup in JVM expressions: XML attributes, cover ids, book numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What stands before a book's number in an identifier; it ends at a closing bracket.
IDENTIFIER_PREFIXES = (
    "Unspecified (uid:",
    "Unspecified (epubmerge-id:",
    "Unspecified (BookId:",
    "URN (BookId:",
    ":urn:uuid:",
    "duokan-book-id:",
    "duokan-book-id (uuid_id:",
    "MOBI-ASIN (Unspecified:",
    "calibre (Unspecified:",
    "ISBN (Unspecified:",
    "ISBN (uid:",
    "uuid (uuid_id:",
    "UUID (BookId:",
)

# Fixed value: room for a book's number, its end mark included.
ISBN_LENGTH = 128


def attribute(markup: Column, tag: str, name: str) -> Column:
    """First value of an attribute of a tag, empty if absent. For text that need not be XML."""
    return F.regexp_extract(markup, rf'<{tag}\s[^>]*?{name}="([^"]*)"', 1)


def xml_value(xml: Column, *steps: str) -> Column:
    """Text of the first node on a path of local names, whatever the namespaces; well-formed XML only."""
    return F.xpath_string(xml, F.lit("/" + "".join(f"/*[local-name()='{s}']" for s in steps)))


def xml_attribute(xml: Column, name: str, *steps: str) -> Column:
    return F.xpath_string(xml, F.lit("/" + "".join(f"/*[local-name()='{s}']" for s in steps) + f"/@{name}"))


def cover_id(meta: Column) -> Column:
    """Id of a cover: what follows ``cover:`` (in any case), from the first letter or digit on; null for other text."""
    at = F.locate(":", meta)
    found = F.regexp_replace(F.substring(meta, at + 1, F.length(meta)), "^[^0-9A-Za-z]+", "")
    return F.when((at > 0) & (F.lower(F.substring(meta, F.lit(1), at - 1)) == "cover"), found)


def isbn(text: Column) -> Column:
    """A book's number: what stands between a known prefix and the next closing bracket; empty if none.

    The first prefix of the table that occurs, in any case, decides, at its first place; a number of
    ``ISBN_LENGTH`` or more bytes, or without a bracket behind it, is none.
    """
    out = None
    for prefix in IDENTIFIER_PREFIXES:
        at = F.locate(prefix.lower(), F.lower(text))
        rest = F.substring(text, at + len(prefix), F.length(text))
        value = F.substring_index(rest, ")", 1)
        found = F.when(F.contains(rest, F.lit(")")) & (F.octet_length(value) < ISBN_LENGTH), value).otherwise("")
        out = F.when(at > 0, found) if out is None else out.when(at > 0, found)
    return out.otherwise("")
