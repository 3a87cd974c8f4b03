"""Text expressions. All are Column -> Column and stay inside generated code.

Spark's ``trim`` removes U+0020 only and Java's regex ``\\w`` is ASCII, so the helpers here name
their character classes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must equal the specified behaviour.
SPACE = "[ \\t\\r\\n]+"
WORD = "[^\\p{P}\\p{Z}\\p{C}]"
DIGITS = "\\p{Nd}+"
MENTION = "(?<![\\p{L}\\p{N}._%+-])@([\\p{L}\\p{N}._-]+(?:@[A-Za-z0-9.-]+)?)"
# The normalisation chain, applied top to bottom.
NORMAL_FORM = [
    ("\\s+([:.,?])", "$1"),
    ("\\s*\\(\\s+", " ("),
    ("\\s+\\)", ")"),
    (f"({WORD})\\(", "$1 ("),
    ("\\s+\\(s\\)", "(s)"),
    (f"({WORD})>", "$1 >"),
    (f"({DIGITS})~({DIGITS})", "$1 ~ $2"),
    (f"({DIGITS}) - ({DIGITS})", "$1 ~ $2"),
    (" ~ ", "–"),
    ('"(.*?)"', "“$1”"),
    ("'s", "’s"),
]
RANGE_DASH = (f"({DIGITS}\\s*)–(\\s*{DIGITS})", "$1 ~ $2")
NAVIGATION_WIDTH = 59
# Lines of an alert and what stands for missing parts.
ALERT_PATH, ALERT_FILE, ALERT_TEXT, ALERT_CODE = "경    로: ", "\n파 일 명: ", "\n코 멘 트: ", "\n코멘트ID: "
NO_VALUE, NO_FILE = "-", "PDF"


def collapse(col: Column) -> Column:
    """Strip the ends and turn inner runs of tab, CR, LF and space into one space."""
    return F.trim(F.regexp_replace(col, SPACE, " "))


def strip(col: Column) -> Column:
    """Remove characters up to U+0020 at both ends."""
    return F.regexp_replace(col, "^[\\x00-\\x20]+|[\\x00-\\x20]+$", "")


def canon(col: Column) -> Column:
    """Key used to compare names: trimmed, upper case."""
    return F.upper(strip(col))


def without_space(col: Column) -> Column:
    return F.regexp_replace(col, "\\s+", "")


def blank_to_null(col: Column) -> Column:
    return F.when(F.length(strip(col)) > 0, col)


def normalize_text(col: Column) -> Column:
    out = collapse(col)
    for pattern, replacement in NORMAL_FORM:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def content_hash(col: Column) -> Column:
    """Hash of a plain sentence; number ranges are spelled one way first."""
    return F.upper(F.sha2(F.regexp_replace(col, *RANGE_DASH), 256))


def node_hash(children: Column) -> Column:
    """Hash of a mixed-content block: ``children`` is array<struct<tag,text>>, tag '' for text."""
    seeds = F.transform(
        children,
        lambda child: F.concat(
            F.coalesce(child["tag"], F.lit("")), F.regexp_replace(child["text"], *RANGE_DASH)
        ),
    )
    return F.upper(F.sha2(F.array_join(seeds, ""), 256))


def translation_hash(col: Column) -> Column:
    """Hash used by the translation dictionary; white space is collapsed on both sides."""
    return content_hash(collapse(col))


def mentions(col: Column) -> Column:
    """Distinct @mentions in order of appearance; addresses inside words do not count."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(MENTION), 1))


def without_mentions(col: Column) -> Column:
    bare = strip(F.regexp_replace(F.coalesce(col, F.lit("")), MENTION, ""))
    return F.regexp_replace(bare, "\\s{2,}", " ")


def notification(path: Column, name: Column, text: Column, code: Column) -> Column:
    """Text of an alert: path, file, comment and its number."""
    shown = F.coalesce(blank_to_null(code), F.lit(NO_VALUE))
    return F.concat(
        F.lit(ALERT_PATH),
        F.coalesce(blank_to_null(path), F.lit(NO_VALUE)),
        F.lit(ALERT_FILE),
        F.coalesce(blank_to_null(name), F.lit(NO_FILE)),
        F.lit(ALERT_TEXT),
        without_mentions(text),
        F.lit(ALERT_CODE),
        F.regexp_replace(shown, "^id", ""),
    )


def short_text(col: Column, width: int = 1000) -> Column:
    return F.left(strip(col), F.lit(width))


def nav_title(col: Column) -> Column:
    cut = F.concat(F.substring(col, 1, NAVIGATION_WIDTH), F.lit("..."))
    return F.when(F.length(col) > NAVIGATION_WIDTH, cut).otherwise(col)


def clean_cell(col: Column) -> Column:
    """Cell text: no-break spaces count as spaces, line breaks too, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(col, " ", " "), "[ \\t\\r\\n]+", " "))


def first_token(col: Column) -> Column:
    return F.element_at(F.split(collapse(col), " "), 1)


def filter_tokens(col: Column, dropped: tuple[str, ...] = ("review", "legal")) -> Column:
    """Drop class tokens; null when nothing is left."""
    kept = F.filter(F.split(collapse(col), " "), lambda t: ~t.isin(*dropped))
    return F.nullif(F.array_join(kept, " "), F.lit(""))


def add_token(col: Column, token: str) -> Column:
    return collapse(F.concat(F.coalesce(col, F.lit("")), F.lit(f" {token}")))


def has_token(col: Column, token: str) -> Column:
    return F.array_contains(F.split(F.coalesce(col, F.lit("")), SPACE), token)


def menu_steps(col: Column) -> Column:
    """Steps of a menu path written with arrows, brackets removed."""
    bare = F.regexp_replace(collapse(col), "[()\\[\\]「」]", "")
    return F.transform(F.split(bare, "→"), collapse)


def compose(col: Column, rules: list[tuple[str, str]]) -> Column:
    """Replace decomposed letters; rules run in order."""
    for old, new in rules:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def keyword_match(cols: list[Column], keyword: str) -> Column:
    """Case-insensitive contains over several columns; blank cells are shown as '-'."""
    needle = keyword.strip().lower()
    found = F.lit(False)
    for col in cols:
        shown = F.coalesce(F.nullif(col, F.lit("")), F.lit("-"))
        found = found | F.contains(F.lower(shown), F.lit(needle))
    return found


def parse_reply_time(col: Column) -> Column:
    """Three formats in order, else null."""
    text = strip(col)
    formats = ["yyyy-MM-dd'T'HH:mm[:ss][.SSSSSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm"]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def elapsed_label(ms: Column) -> Column:
    """Milliseconds below one second, else seconds with one place, halves up."""
    tenths = F.floor((ms + 50) / 100)
    seconds = F.format_string("%.1fs", tenths / F.lit(10.0))
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(seconds)


# Letters that serve as labels.
LABEL = "^([A-LR]):\\s*"


def mark_label(col: Column) -> Column:
    """Mark a leading letter label such as 'B: text' as not to be translated."""
    text = collapse(col)
    marked = F.concat(
        F.lit('<term translate="no">'),
        F.regexp_extract(text, LABEL, 1),
        F.lit("</term>:"),
    )
    rest = F.regexp_replace(text, LABEL, "")
    return F.when(
        text.rlike(LABEL), F.when(rest != "", F.concat(marked, F.lit(" "), rest)).otherwise(marked)
    ).otherwise(text)
