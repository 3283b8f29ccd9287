"""Text expressions, Column to Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The signs that count as blanks, non-ASCII ones included, which SQL trim keeps.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`, which keeps expressions small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    """Remove blanks of every kind from both ends."""
    return F.btrim(col(c), F.lit(BLANKS))


def strip_bare(c: Column | str) -> Column:
    """strip() for a plain column of mostly bare texts. One that begins and ends with a visible ASCII sign stays as it is; only the others are searched for blanks."""
    text = col(c)
    last = F.substring(text, -1, 1)
    visible = (text >= "!") & (text < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(visible, text).otherwise(strip(text))


def blank_to_null(c: Column | str) -> Column:
    """The stripped text, null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def empty_to_null(c: Column | str) -> Column:
    """Null for the empty text, the value as it is otherwise."""
    return F.nullif(col(c), F.lit(""))


def title_case(c: Column | str) -> Column:
    """Upper-case the first letter of each run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    capital = lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(run.substr(F.lit(2), F.length(run))))
    return F.array_join(F.transform(runs, capital), "")


def name_from_slug(slug: Column | str) -> Column:
    """A readable name for a slug that came without one."""
    return title_case(F.replace(col(slug), F.lit("-"), F.lit(" ")))


def safe_slug(c: Column | str) -> Column:
    """File-safe slug: letters, digits, '_' and single '-'; never empty."""
    kept = F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9_-]+", "-")
    trimmed = F.regexp_replace(F.regexp_replace(kept, r"-+", "-"), r"^-|-$", "")
    return F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("unknown"))


def tag_match_slug(slug: Column | str, name: Column | str) -> Column:
    """Slug used to recognise signal tags; unlike safe_slug it also replaces '_'."""
    source = F.coalesce(empty_to_null(slug), empty_to_null(name), F.lit(""))
    dashed = F.regexp_replace(F.lower(strip(source)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, r"^-|-$", "")


def display_name(c: Column | str) -> Column:
    """Name without the '(Commander)' suffix, inner blanks collapsed."""
    bare = F.regexp_replace(strip(c), r"(?i)\s*\(Commander\)\s*$", "")
    return strip(F.regexp_replace(bare, r"\s+", " "))


def name_candidates(c: Column | str) -> Column:
    """The full name, then the parts of a paired name in order, each once."""
    full = display_name(c)

    def parts(sep: str) -> Column:
        return F.filter(F.transform(F.split(full, sep), strip), lambda p: p != "")

    return F.array_distinct(F.concat(F.array(full), parts(r"\s+//\s+"), parts(r"\s+\+\s+")))


def search_text(c: Column | str) -> Column:
    """Lower case, every run of other signs one space, no outer blanks."""
    text = F.coalesce(col(c).cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def compact_text(c: Column | str) -> Column:
    return F.replace(search_text(c), F.lit(" "), F.lit(""))


def unique_texts(arr: Column | str) -> Column:
    """Stripped non-blank items in order, each once."""
    return F.array_distinct(F.filter(F.transform(col(arr), strip), lambda x: x.isNotNull() & (x != "")))


def page_url(template: str, slug: Column | str) -> Column:
    """Fill a page address template; blanks and slashes around the slug are dropped."""
    before, after = template.split("{slug}")
    bare = F.regexp_replace(strip(slug), r"^/+|/+$", "")
    return F.concat(F.lit(before), bare, F.lit(after))
