"""Identity and location expressions: content-addressed ids, qualified names, coordinates, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import location

#: The object-identifier namespace of name-based UUIDs.
NAMESPACE_OID = "6ba7b8129dad11d180b400c04fd430c8"


def uuid5(name: Column, namespace: str = NAMESPACE_OID) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def symbol_id(qualified_name: Column, file_path: Column, line: Column) -> Column:
    """Id of a function: its qualified name, file and line, whatever the column."""
    return uuid5(F.concat(qualified_name, F.lit("@"), file_path, F.lit(":"), line.cast("string")))


def qualified_name(container: Column, name: Column) -> Column:
    """container::name, or name without a container; an empty container counts."""
    return F.concat_ws("::", container, name)


def call_qualified_name(detail: Column, name: Column) -> Column:
    """detail::name if there is a detail, else name."""
    return F.concat_ws("::", F.nullif(detail, F.lit("")), name)


def detailed_name(detail: Column, name: Column) -> Column:
    """detail::name, with nothing before the colons where detail is missing."""
    return F.concat(F.coalesce(detail, F.lit("")), F.lit("::"), name)


def path_of_uri(uri: Column) -> Column:
    """Path of a file URI, percent-decoded; other URIs as they are."""
    decoded = F.url_decode(F.replace(F.regexp_replace(uri, r"^file://", ""), F.lit("+"), F.lit("%2B")))
    return F.when(uri.startswith("file://"), decoded).otherwise(uri)


def location_of_range(uri: Column, start: Column, end: Column) -> Column:
    """One-based location of a zero-based range; its length only if it ends on its line."""
    length = F.when(start["line"] == end["line"], end["character"] - start["character"])
    return location(path_of_uri(uri), start["line"] + 1, start["character"] + 1, length)


def location_of_position(uri: Column, position: Column) -> Column:
    return location(path_of_uri(uri), position["line"] + 1, position["character"] + 1)


def request_position(line: Column) -> Column:
    """Zero-based number of a one-based one; never below 0."""
    return F.greatest(line - 1, F.lit(0))


# Languages by file extension; anything else is plaintext.
LANGUAGES = {
    "c": "c", "h": "c", "hpp": "c", "hxx": "c", "cpp": "cpp", "cxx": "cpp", "cc": "cpp", "rs": "rust", "py": "python",
    "js": "javascript", "ts": "typescript", "java": "java", "go": "go",
}


def language_of(path: Column) -> Column:
    """Language by extension; plaintext for others."""
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.regexp_extract(path, r"\.([^.]+)$", 1)), F.lit("plaintext"))


# Kinds of symbols by number that keep their name; all others are functions.
KINDS = {6: "Method", 9: "Constructor", 12: "Function", 13: "Variable"}


def reference_kind(kind: Column) -> Column:
    out = F.lit("Function")
    for number, name in KINDS.items():
        out = F.when(kind == number, name).otherwise(out)
    return out
