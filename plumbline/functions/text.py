"""Text column functions: trimming, folding, sentinels, casing, name tokens."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character a Unicode-aware strip removes.
WHITESPACE = "".join(chr(i) for i in range(0x10000) if chr(i).isspace())
# What trimming changes, what collapsing changes after it, and what collapsing changes alone.
SPACE_AT_ENDS = rf"\A[{WHITESPACE}]|[{WHITESPACE}]\z"
WIDE_SPACE = rf"[{WHITESPACE}]{{2}}|[{WHITESPACE}&&[^ ]]"
INNER_SPACES = rf"[^{WHITESPACE}](?:[{WHITESPACE}]{{2,}}|[{WHITESPACE}&&[^ ]])[^{WHITESPACE}]"

# --- fixed values -----------------------------------------------------------
# Three vocabularies of "missing, stored as text".  They differ on purpose:
# the cleaning policy is conservative, the upload path wider, the profile widest.
POLICY_SENTINELS = (
    "", "-", "--", "n/a", "na", "n.a.", "nan", "null", "none", "nil",
    "unknown", "unspecified", "not available", "not applicable", "?", "#n/a",
)
UPLOAD_SENTINELS = (
    "", "-", "--", "---", "?", "??", ".", "n/a", "n.a.", "na", "nan", "none",
    "null", "nil", "nd", "n/d", "#n/a", "#na", "#null!", "#div/0!", "#ref!",
    "#value!", "unknown", "unspecified", "undefined", "missing",
    "not available", "not applicable", "no data", "blank", "empty",
    "<na>", "<null>", "0000-00-00",
)
PROFILE_SENTINELS = (
    "", "-", "--", "?", "??", ".", "n/a", "n.a.", "na", "nan", "none", "null",
    "nil", "nd", "n/d", "#n/a", "#na", "#null!", "#div/0!", "#ref!", "#value!",
    "unknown", "unspecified", "undefined", "missing", "not available",
    "not applicable", "no data", "blank", "empty", "tbd", "tba", "pending",
    "<na>", "<null>", "\\n", "0000-00-00",
)
SENTINELS = {
    "policy": POLICY_SENTINELS,
    "upload": UPLOAD_SENTINELS,
    "profile": PROFILE_SENTINELS,
}

# Marks left when UTF-8 bytes are read as a single-byte code page.
MOJIBAKE_MARKERS = ("Ã", "Â", "â", "�", "ï»¿")

# Column-name words that say nothing about meaning.
NOISE_TOKENS = (
    "name", "names", "desc", "description", "txt", "text", "value", "val",
    "code", "cd", "field", "col", "column", "the", "of", "type",
)
# --- end of fixed values ----------------------------------------------------


def seldom(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` as a lambda, which is run but not compiled.  For branches that few cells
    take: written out for every column they slowed a whole pass (28 s, so 17 s over 6 x)."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    """Remove Unicode whitespace at both ends.

    The cheap test comes first: most cells begin and end with a printable
    ASCII character and are returned as they are.
    """
    return F.when(c.rlike(r"\A[^!-~]|[^!-~]\z"), F.btrim(c, F.lit(WHITESPACE))).otherwise(c)


def collapse(c: Column) -> Column:
    """Replace every whitespace run with one space."""
    return F.when(F.contains(c, F.lit("  ")) | c.rlike("[^ -~]"),
                  F.regexp_replace(c, "[" + WHITESPACE + "]+", " ")).otherwise(c)


def tidy(c: Column) -> Column:
    """``collapse(strip(c))`` behind one test; text without any whitespace or
    non-ASCII character is returned as it is, and plain spaces need no wide class."""
    def cut(t: Column) -> Column:
        wide = F.regexp_replace(F.btrim(t, F.lit(WHITESPACE)), "[" + WHITESPACE + "]+", " ")
        return F.when(t.rlike("[^ -~]"), wide).otherwise(F.regexp_replace(F.trim(t), "  +", " "))

    return F.when(c.rlike("[^!-~]"), seldom(c, cut)).otherwise(c)


def trims(c: Column) -> Column:
    """Whether ``strip`` changes the text.  The class of all whitespace is tested character
    by character, so that text of plain spaces and printable ASCII is kept away from it."""
    return F.when(c.rlike("[^ -~]"), c.rlike(SPACE_AT_ENDS)).otherwise(
        c.startswith(" ") | c.endswith(" "))


def collapses(c: Column, trimmed: bool = True) -> Column:
    """Whether ``collapse`` changes the text, after ``strip`` if ``trimmed``."""
    return F.when(c.rlike("[^ -~]"), c.rlike(INNER_SPACES if trimmed else WIDE_SPACE)).otherwise(
        F.contains(F.trim(c) if trimmed else c, F.lit("  ")))


def is_sentinel(c: Column, vocabulary: str = "profile") -> Column:
    """Whether the trimmed, lower-cased text is a spelling of 'missing'."""
    return F.lower(strip(c)).isin(*SENTINELS[vocabulary])


def fold_key(c: Column) -> Column:
    """Join key: lower case, every non-alphanumeric run one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


@lru_cache(maxsize=1)
def _accent_rules() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Derive the accent fold from Unicode decompositions."""
    source, target, multi = [], [], []
    for point in range(0x80, sys.maxunicode + 1):
        ch = chr(point)
        folded = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            source.append(ch)
            target.append(folded)
        elif len(folded) > 1:
            multi.append((ch, folded))
    return "".join(source), "".join(target), tuple(multi)


def ascii_fold(c: Column) -> Column:
    """Drop accents and every character with no ASCII form."""
    source, target, multi = _accent_rules()
    # forms of several letters are rare, so texts without one skip the look-up
    longer = F.create_map(*[F.lit(x) for pair in multi for x in pair])
    spelt = F.concat_ws("", F.transform(
        F.split(c, ""), lambda ch: F.coalesce(F.try_element_at(longer, ch), ch)))
    some = "[" + "".join(ch for ch, _ in multi) + "]"
    folded = F.translate(F.when(c.rlike(some), spelt).otherwise(c), source, target)
    folded = F.regexp_replace(folded, r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def normalise_category(c: Column) -> Column:
    """Fold a label so spelling variants share one key."""
    return F.regexp_replace(strip(F.lower(ascii_fold(c))), r"[\s_\-.]+", "")


def title_case(c: Column) -> Column:
    """Capitalise each letter that follows a non-letter, lower the rest."""
    chars = F.split(c, "")
    return F.concat_ws("", F.transform(
        chars,
        lambda ch, i: F.when(
            (i == 0) | ~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(ch)
        ).otherwise(F.lower(ch))))


def has_mojibake(c: Column) -> Column:
    hit = F.lit(False)
    for marker in MOJIBAKE_MARKERS:
        hit = hit | F.contains(c, F.lit(marker))
    return hit


def short_label(c: Column, limit: int = 44) -> Column:
    """One-line label, cut to ``limit`` characters with an ellipsis."""
    text = strip(collapse(c))
    return F.when(
        F.length(text) > limit,
        F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    ).otherwise(text)


def clean_label(c: Column) -> Column:
    """snake_case or kebab-case name to Title Case words."""
    return F.initcap(strip(collapse(F.regexp_replace(c, r"[_\-]+", " "))))


def tokens(c: Column) -> Column:
    """Lower-case words of a column name, split on camel humps and separators,
    with a crude singular."""
    parts = F.split(F.regexp_replace(c, r"(?<=[a-z0-9])(?=[A-Z])", " "),
                    r"[\s_\-.]+")
    words = F.filter(F.transform(parts, lambda p: F.lower(strip(p))),
                     lambda p: p != "")
    return F.transform(words, lambda p: F.when(
        (F.length(p) > 3) & p.endswith("s") & ~p.endswith("ss"),
        F.substring(p, F.lit(1), F.length(p) - 1)
    ).otherwise(p))


def canonical_name(c: Column) -> Column:
    return F.array_join(tokens(c), "_")


def meaning_tokens(c: Column) -> Column:
    """Distinct tokens without the decorative ones, unless none would be left."""
    all_tokens = F.array_distinct(tokens(c))
    kept = F.array_except(all_tokens, F.array(*[F.lit(t) for t in NOISE_TOKENS]))
    return F.when(F.size(kept) > 0, kept).otherwise(all_tokens)


def concept_name(c: Column) -> Column:
    """snake_case name with decorative tokens dropped, order kept."""
    all_tokens = tokens(c)
    kept = F.filter(all_tokens, lambda t: ~t.isin(*NOISE_TOKENS))
    return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(all_tokens), "_")


def naming_convention(c: Column) -> Column:
    """Which multi-word convention a column name follows."""
    s = strip(c)
    has_upper = F.lower(s) != s
    has_lower = F.upper(s) != s
    starts_upper = s.rlike(r"^\p{Lu}")
    return (
        F.when(s == "", "empty")
        .when(F.contains(s, F.lit(" ")), "spaced")
        .when(F.contains(s, F.lit("-")), "kebab-case")
        .when(F.size(tokens(s)) < 2, "single-word")
        .when(has_upper & ~has_lower, "SCREAMING_CASE")
        .when(F.contains(s, F.lit("_")) & has_lower & ~has_upper, "snake_case")
        .when(F.contains(s, F.lit("_")) & starts_upper, "Mixed_Pascal_Snake")
        .when(starts_upper, "PascalCase")
        .when(has_upper, "camelCase")
        .otherwise("other")
    )
