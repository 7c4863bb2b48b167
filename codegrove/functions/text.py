"""Text, hashing and projection helpers as pure Catalyst expressions (inventory F1-F28, S5, S6, P25)."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix -> language used for parsing.
PARSE_LANGUAGES = {
    "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript",
    "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "cpp": "cpp", "cc": "cpp",
    "cxx": "cpp", "c": "c", "h": "c", "php": "php",
}
# Suffix -> language shown in index listings.
LISTING_LANGUAGES = {
    "py": "python", "js": "javascript", "ts": "typescript", "jsx": "javascript",
    "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "cpp": "cpp", "c": "c",
    "h": "c", "hpp": "cpp", "rb": "ruby", "php": "php", "swift": "swift", "kt": "kotlin",
    "scala": "scala", "cs": "csharp",
}
# Every character Python counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Remove white space at both ends, Unicode spaces included."""
    return F.btrim(text, F.lit(WHITESPACE))


def present(text: Column) -> Column:
    """NULL for an empty string, so that ``concat_ws`` skips it."""
    return F.nullif(text, F.lit(""))


def suffix(path: Column) -> Column:
    """Lower-cased file suffix without the dot ('' when there is none)."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def _language(path: Column, table: dict[str, str]) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), suffix(path))


def parse_language(path: Column) -> Column:
    """Language used by the parsers, NULL when the suffix is unknown."""
    return _language(path, PARSE_LANGUAGES)


def listing_language(path: Column) -> Column:
    """Language shown in listings, ``unknown`` as a fallback."""
    return F.coalesce(_language(path, LISTING_LANGUAGES), F.lit("unknown"))


# A token: letters and digits up to a camel-case border or the last capital of an acronym. The pattern consumes its text, which is
# several times faster than looking for empty matches between the tokens.
TOKEN = r"(?:[a-z](?![A-Z])|[A-Z](?![A-Z][a-z])|[0-9])*[a-zA-Z0-9]"


def tokens(text: Column, min_length: int = 1) -> Column:
    """split identifiers on punctuation, camel case and acronym borders; lower-case."""
    words = F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda w: F.lower(w))
    return words if min_length <= 1 else F.filter(words, lambda w: F.length(w) >= min_length)


def tokens_local(text: str) -> list[str]:
    """The same split for one query string on the driver."""
    return [word.lower() for word in re.findall(TOKEN, text)]


def word_count(text: Column) -> Column:
    """Number of white-space separated words (token count of the mock embedding)."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """four characters per token."""
    return F.floor(F.length(text) / 4).cast("long")


def content_hash(text: Column, length: int | None = None) -> Column:
    """SHA-256 in hex, optionally only its first characters."""
    digest = F.sha2(text, 256)
    return digest if length is None else F.substring(digest, 1, length)


def quick_hash(path: Column, mtime: Column, size: Column) -> Column:
    """fingerprint of path, modification time and size."""
    return F.md5(F.concat_ws(":", path, mtime.cast("string"), size.cast("string")))


def document_key(doc_id: Column) -> Column:
    """storage key of a document."""
    return F.md5(doc_id)


def line_count(start: Column, end: Column) -> Column:
    """lines of a span, both ends included."""
    return end - start + 1


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first``..``last`` (1-based, clamped) of a text."""
    parts = lines(text)
    start = F.greatest(first, F.lit(1))
    stop = F.least(last, F.size(parts))
    return F.array_join(F.slice(parts, start, F.greatest(stop - start + 1, F.lit(0))), "\n")


def truncated(text: Column, limit: int) -> Column:
    """P25: first ``limit`` characters followed by an ellipsis when something was cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def highlighted(text: Column, terms: Iterable[str]) -> Column:
    """wrap each query term in ``<mark>`` tags, ignoring case."""
    words = sorted({t for t in terms if t}, key=lambda t: (-len(t), t))
    if not words:
        return text
    pattern = "(?i)(" + "|".join(re.escape(w) for w in words) + ")"
    return F.regexp_replace(text, pattern, "<mark>$1</mark>")


def file_header(
    path: Column, unit_type: Column, qualified: Column, signature: Column, doc: Column
) -> Column:
    """comment block put in front of a chunk."""
    first_line = present(strip(F.split_part(doc, F.lit("\n"), F.lit(1))))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("# File: "), path),
        F.concat(F.lit("# "), unit_type, F.lit(": "), qualified),
        F.concat(F.lit("# Signature: "), present(signature)),
        F.concat(F.lit("# "), first_line),
    )


def inline_header(
    signature: Column, qualified: Column, unit_type: Column, doc: Column, doc_limit: int | None = None
) -> Column:
    """F16: one-line context of an embedding chunk; the description is cut only where ``doc_limit`` says so."""
    shown = present(doc) if doc_limit is None else truncated(present(doc), doc_limit)
    return F.concat_ws(
        " | ",
        F.concat(F.lit("Signature: "), present(signature)),
        F.concat(F.lit("Name: "), present(qualified)),
        F.concat(F.lit("Type: "), unit_type),
        F.concat(F.lit("Doc: "), shown),
    )


def embedding_text(before: Column, content: Column, after: Column) -> Column:
    """chunk text with its surrounding context."""
    return F.concat_ws("\n\n", present(before), content, present(after))


def unit_embedding_text(signature: Column, doc: Column, content: Column, limit: int | None = None) -> Column:
    """signature, docstring and content (its first ``limit`` characters, if given), as one string for the model."""
    return F.concat_ws(" ", present(signature), present(doc), content if limit is None else F.substring(content, 1, limit))


def glob_regex(pattern: str) -> str:
    """Shell-style glob as an anchored Java regular expression."""
    out = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[" and "]" in pattern[i + 2:]:
            close = pattern.index("]", i + 2)
            body = pattern[i + 1:close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = close
        else:
            out.append(re.escape(ch))
        i += 1
    return "^(?s:" + "".join(out) + ")$"


def matches_glob(path: Column, pattern: str) -> Column:
    """Whole-path glob test (``fnmatch`` style)."""
    return path.rlike(glob_regex(pattern))


def matches_name(path: Column, pattern: str) -> Column:
    """Glob test against the trailing path parts (``PurePath.match`` style)."""
    body = "/".join(glob_regex(p)[5:-2].replace(".*", "[^/]*") for p in pattern.split("/"))
    return path.rlike(f"(^|/){body}$")


def mentions_any(path: Column, parts: Iterable[str]) -> Column:
    """True when one of the substrings occurs in the path."""
    test = F.lit(False)
    for part in parts:
        test = test | path.contains(part)
    return test
