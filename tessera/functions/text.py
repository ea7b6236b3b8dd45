"""Text functions on columns: tokens, query terms, LIKE, globs, ids, normalisation."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
QUERY_GAP = r"[^A-Za-z0-9_.$/@:-]+"


def _folding() -> tuple[str, str]:
    """Letters with marks up to U+024F and the plain letters that they fold to."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) > 1 and c == c.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


FOLD_FROM, FOLD_TO = _folding()


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), FOLD_FROM, FOLD_TO)


def tokens(text: Column) -> Column:
    """The runs of letters and digits, folded."""
    return F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0))


def fold_word(text: str) -> str:
    return text.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def query_terms(query: str) -> list[str]:
    return [t for t in re.split(QUERY_GAP, query) if t]


def query_phrases(query: str, most: int = 32) -> list[list[str]]:
    """A full-text query: terms of two characters or more, each a phrase of its tokens."""
    out = [re.findall(r"[^\W_]+", fold_word(t)) for t in [t for t in query_terms(query) if len(t) >= 2][:most]]
    return [p for p in out if p]


def query_terms_column(query: Column, least: int = 2, most: int = 32) -> Column:
    return F.slice(F.filter(F.split(query, QUERY_GAP), lambda t: F.length(t) >= least), 1, most)


def like_any_case(column: Column, pattern: str) -> Column:
    """LIKE with the case of letters ignored; % and _ in the pattern are wildcards."""
    return column.ilike(pattern)


def escaped_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def path_prefix(column: Column, prefix: str | None, strict: bool = False) -> Column:
    """strict: the prefix as it stands (it reaches the scan); else as a LIKE pattern, case ignored."""
    if not prefix:
        return F.lit(True)
    return column.startswith(prefix) if strict else like_any_case(column, prefix + "%")


def ordered_terms_pattern(query: str) -> str:
    """%t1%t2%...% of the first four terms."""
    return "%" + "%".join(query_terms(query)[:4]) + "%"


def glob_regex(glob: str) -> str:
    """A glob as a regular expression for whole strings; * crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := glob.find("]", i + 1)) > 0:
            inner = glob[i:end]
            out += "[" + ("^" + inner[1:] if inner[:1] == "!" else inner).replace("\\", "\\\\") + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return f"(?s)^(?:{out})$"


def matches_any(column: Column, globs: list[str] | tuple[str, ...]) -> Column:
    return column.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs)) if globs else F.lit(False)


def stable_id(*parts: Column | str, length: int = 20) -> Column:
    """An id that depends on nothing but its parts: hex digits of a hash."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("")) for p in parts)), 256), 1, length)


def normalized_lines(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def is_binary(content: Column, sample: int = 4096, share: float = 0.08) -> Column:
    """Binary bytes: a NUL anywhere, or too many control characters among the first `sample` bytes."""
    latin = F.decode(content, "ISO-8859-1")
    head = F.substring(latin, 1, sample)
    controls = F.length(head) - F.length(F.regexp_replace(head, "[\\x00-\\x08\\x0e-\\x1f]", ""))
    return F.coalesce(latin.contains("\x00") | (controls > share * F.greatest(F.length(head), F.lit(1))), F.lit(False))


def snippet(text: Column, chars: int = 700) -> Column:
    """The trimmed text, cut with an ellipsis behind `chars`."""
    trimmed = F.trim(text)
    return F.when(F.length(trimmed) > chars, F.concat(F.rtrim(F.substring(trimmed, 1, chars)), F.lit("…"))).otherwise(trimmed)


def fetch_text(text: Column, chars: int = 16_000) -> Column:
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit("\n...[truncated]"))).otherwise(text)


def header_key(text: Column) -> Column:
    """What running headers have in common: digits as #, blanks collapsed, lower case."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[0-9]+", "#"), r"\s+", " "), 1, 180)


def clean_page_text(text: Column) -> Column:
    """Joins words hyphenated at line ends, drops blanks at line ends, and keeps one empty line of several."""
    text = F.regexp_replace(normalized_lines(text), r"(\p{L})-\n(\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(text, "[ \\t]+\n", "\n"), "\n{3,}", "\n\n"))
