"""Column functions for text and URLs, with Python-compatible Unicode rules.

All of these are built-in Spark expressions (JVM side, whole-stage codegen);
no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() / str.strip() treat as
# whitespace: U+0009 to U+000D, U+001C to U+0020, U+0085, U+00A0, U+1680,
# U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
# Written with \x{..} escapes only, so the same class runs in Java regex
# (Spark) and RE2 (DuckDB oracles).
PY_SPACE = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)

#: The same characters, for functions that take them as a list.
PY_SPACE_CHARS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                                   0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# A character that is not a word character (letter, number, underscore).
# Used for whole-word tests that must agree between Java and RE2.
NOT_WORD = r"[^\p{L}\p{N}_]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """str.strip(): drop leading and trailing Unicode whitespace.

    ``F.trim`` removes only U+0020, so a tab, NBSP or U+2003 would stay. Only the ends
    are looked at: a pattern would run over the whole of a long text.
    """
    return F.btrim(_col(c), F.lit(PY_SPACE_CHARS))


def norm_key(c) -> Column:
    """lower().strip(): the normalisation of dedupe keys."""
    return py_strip(F.lower(_col(c)))


def collapse_space(c) -> Column:
    """re.sub(r'\\s+', ' ', text)."""
    return F.regexp_replace(_col(c), f"{PY_SPACE}+", " ")


def clean_text(c) -> Column:
    """Collapse whitespace, join runs of single ASCII letters, strip.

    "P y t h o n" becomes "Python"; two real one-letter words merge too
    ("a b" to "ab"), as in the reference. Null gives "".
    """
    collapsed = collapse_space(F.coalesce(_col(c), F.lit("")))
    joined = F.regexp_replace(collapsed, r"(?U)(?<=\b[A-Za-z]) (?=[A-Za-z]\b)", "")
    return py_strip(joined)


def clip(c, n: int = 8000) -> Column:
    """First n characters (code points)."""
    return F.substring(_col(c), 1, n)


def n_cut(c, n: int = 8000) -> Column:
    """How many characters clipping removed."""
    return F.greatest(F.length(_col(c)) - F.lit(n), F.lit(0)).cast("long")


def canonical_url(c) -> Column:
    """Cut the query string: url.split('?')[0]; the fragment stays."""
    return F.substring_index(_col(c), "?", 1)


def absolute_url(href, base: str, always: bool = False) -> Column:
    """Prefix the site base unless the link is absolute (or always)."""
    h = _col(href)
    if always:
        return F.concat(F.lit(base), h)
    return F.when(h.startswith("http"), h).otherwise(F.concat(F.lit(base), h))


def clean_listing_title(c) -> Column:
    """First line, text before "PLN", stripped."""
    first_line = F.substring_index(_col(c), "\n", 1)
    return py_strip(F.substring_index(first_line, "PLN", 1))


def quote_plus(c) -> Column:
    """urllib.parse.quote_plus: Spark's url_encode leaves '*' and encodes '~',
    Python does the reverse."""
    enc = F.url_encode(_col(c))
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def py_regex_escape(s: str) -> str:
    """Escape a literal keyword for a Java pattern built on the driver: every
    character that is not a letter, digit or underscore is backslash-quoted."""
    return "".join(ch if (ch.isalnum() or ch == "_") else "\\" + ch for ch in s)
