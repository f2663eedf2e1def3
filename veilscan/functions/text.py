"""String expressions: file names, validation, clean-up, tokens, sentences, chunks."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilscan.settings import DEFAULT_OPTIONS, SPACE, Options

# Wording of the validation and extraction errors.
UNSUPPORTED_MESSAGE = "Unsupported file type. Allowed types: {allowed}."
TOO_LARGE_MESSAGE = "File is too large. Maximum size is {limit} MB."
BLANK_MESSAGE = "The uploaded document does not contain readable text."
BAD_CSV_MESSAGE = "The CSV could not be parsed."
TRUNCATION_MARK = "\n\n[Content truncated for model context limit.]"

# Words ignored when a question is turned into search terms.
STOP_WORDS = (
    "the", "is", "are", "a", "an", "to", "of", "for", "in", "on", "and", "or",
    "what", "which", "who", "where", "when", "how", "tell", "about", "document",
)
TERM_PATTERN = "[A-Za-z0-9_@.-]+"


def file_name(path: Column) -> Column:
    """Last component of a path; trailing slashes do not count."""
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def file_extension(path: Column) -> Column:
    """Lower-case suffix with its dot; '' when the name has none.

    The suffix needs a name before it and a character after it, so ``.pdf`` and
    ``report.`` have no suffix.
    """
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+(\.[^.]+)\z", 1))


def upload_error(path: Column, size: Column, options: Options = DEFAULT_OPTIONS) -> Column:
    """Validation message for an upload, or NULL when it is acceptable."""
    allowed = ", ".join(options.allowed_extensions)
    return F.when(
        ~file_extension(path).isin(*options.allowed_extensions),
        F.lit(UNSUPPORTED_MESSAGE.format(allowed=allowed)),
    ).when(
        size > options.max_upload_mb * 1024 * 1024,
        F.lit(TOO_LARGE_MESSAGE.format(limit=options.max_upload_mb)),
    )


def content_hash(content: Column) -> Column:
    """SHA-256 of the bytes (or of the UTF-8 form of a string), in hex."""
    return F.sha2(content.cast("binary"), 256)


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8 when valid, else as Latin-1."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def is_blank(text: Column) -> Column:
    """True for NULL and for text without a non-whitespace character."""
    return F.coalesce(~text.rlike(f"[^{SPACE}]"), F.lit(True))


def sql_text(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strip_sql(text: str) -> str:
    edges = sql_text(f"^[{SPACE}]|[{SPACE}]\\z")
    runs = sql_text(f"^[{SPACE}]+|[{SPACE}]+\\z")
    return f"case when {text} rlike {edges} then regexp_replace({text}, {runs}, '') else {text} end"


def strip(text: str) -> Column:
    """Remove leading and trailing whitespace (all Unicode whitespace)."""
    return F.expr(strip_sql(text))


def compact_sql(text: str) -> str:
    return f"trim(regexp_replace({text}, {sql_text(f'[{SPACE}]+')}, ' '))"


def compact(text: Column) -> Column:
    """Collapse every whitespace run to one space and strip the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def truncate(text: Column, limit: int = DEFAULT_OPTIONS.max_input_chars) -> Column:
    """Clip to ``limit`` characters with a visible mark."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATION_MARK))
    ).otherwise(text)


def safe_filename(value: Column) -> Column:
    """Replace runs of unsafe characters by '_' and strip '_' at both ends."""
    return F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9_.-]+", "_"), r"^_+|_+\z", "")


# Decimal digits of every script beyond ASCII, with their values (from Unicode data).
WIDE_DIGITS = "".join(chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd")
WIDE_VALUES = "".join(str(unicodedata.decimal(c)) for c in WIDE_DIGITS)

ASCII_DIGITS_SQL = (
    "regexp_replace(case when {v} rlike '[^\\\\x00-\\\\x7f]' "
    f"then translate({{v}}, '{WIDE_DIGITS}', '{WIDE_VALUES}') else {{v}} end, '[^0-9]', '')"
)
LUHN_SQL = (
    "element_at(transform(array(" + ASCII_DIGITS_SQL + "), "
    "d_ -> length(d_) between 13 and 19 and luhn_check(d_)), 1)"
)


def passes_luhn(value: str) -> Column:
    """Luhn check over the decimal digits of the value (any script), 13 to 19 of them."""
    return F.expr(LUHN_SQL.format(v=value))


def search_terms_sql(question: str) -> str:
    stop = ", ".join(sql_text(w) for w in STOP_WORDS)
    tokens = f"regexp_extract_all(lower({question}), {sql_text(TERM_PATTERN)}, 0)"
    return f"array_distinct(filter({tokens}, t -> length(t) > 2 and t not in ({stop})))"


def search_terms(question: str) -> Column:
    """Distinct lower-case tokens of more than two characters that are no stop words."""
    return F.expr(search_terms_sql(question))


def sentences_sql(text: str) -> str:
    return f"split({text}, {sql_text(f'(?<=[.!?])[{SPACE}]+|\\n+')}, -1)"


def sentences(text: str) -> Column:
    """Split after '.', '!' or '?' followed by whitespace, and at newlines."""
    return F.expr(sentences_sql(text))


def chunk_count(text: Column, options: Options = DEFAULT_OPTIONS) -> Column:
    """Number of fixed-stride chunks; 0 for blank text."""
    step = options.chunk_size - options.chunk_overlap
    n = F.ceil((F.length(text) - options.chunk_overlap) / step)
    return (
        F.when(is_blank(text), F.lit(0))
        .when(F.length(text) <= options.chunk_size, F.lit(1))
        .otherwise(n)
        .cast("int")
    )


#: What ends a piece of text, coarse to fine: blank lines, sentences, words, and any character.
PIECE_ENDS = (r"\n{2,}", f"[.!?][{SPACE}]+|\\n+", f"[{SPACE}]+")


def pieces_sql(text: str, limit: int) -> str:
    """Array of pieces that make up the text, none longer than ``limit``.

    Paragraphs are pieces; one that is too long is cut into its sentences, a sentence that is too long into its
    words, and only a word that is too long anywhere.  Each piece keeps the space after it.
    """
    def parts(pattern: str, of: str) -> str:
        return f"regexp_extract_all({of}, {sql_text('(?s)' + pattern)}, 0)"

    def cut(level: int, of: str) -> str:
        if level == len(PIECE_ENDS):
            return parts(f".{{1,{limit}}}", of)
        part = f"piece_{level}"
        found = parts(f".+?(?:{PIECE_ENDS[level]}|\\z)", of)
        return f"flatten(transform({found}, {part} -> if(length({part}) <= {limit}, array({part}), {cut(level + 1, part)})))"

    return cut(0, text)
