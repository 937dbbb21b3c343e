"""Names and slugs as Column expressions.

No Python UDF: the accent fold is a ``translate`` table and a map, built
once, by rule, from the compatibility decomposition of all of Unicode.
"""
from __future__ import annotations

import json
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import LINK_WORDS, REGULAR_SEASON, UNGROUPED, VOWELS


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """From the compatibility decomposition (NFKD) of every character: those
    that fold to one ASCII character (two strings for ``translate``) and those
    that fold to several (a map). What folds to nothing is dropped later."""
    one: dict[str, str] = {}
    many: dict[str, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if unicodedata.decomposition(ch):
            base = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
            if len(base) == 1:
                one[ch] = base
            elif base:
                many[ch] = base
    return "".join(one), "".join(one.values()), many


FOLD_FROM, FOLD_TO, FOLD_MANY = _fold_tables()


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _ranges(chars) -> str:
    """Character class of a set of characters, as code point ranges."""
    out, start, last = [], None, None
    for cp in [*sorted(map(ord, chars)), None]:
        if start is not None and cp != last + 1:
            out.append(f"\\x{{{start:X}}}-\\x{{{last:X}}}")
            start = None
        start, last = (cp if start is None else start), cp
    return "".join(out)


_MANY_CLASS = _ranges(FOLD_MANY)
_MANY_JSON = json.dumps(FOLD_MANY)


def _expand(t: Column) -> Column:
    """Characters that fold to several letters (ligatures, squared units),
    looked up one by one; only texts that hold one come here."""
    table = F.from_json(F.lit(_MANY_JSON), "map<string,string>")  # folded to one literal
    return F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def fold(text) -> Column:
    """ASCII of the compatibility decomposition; what has none is dropped."""
    t = F.coalesce(_c(text), F.lit(""))
    t = F.when(t.rlike(f"[{_MANY_CLASS}]"), _expand(t)).otherwise(t)
    return F.regexp_replace(F.translate(t, FOLD_FROM, FOLD_TO), r"[^\x00-\x7F]", "")


def slug(text) -> Column:
    """ASCII fold, lower, non-alphanumeric runs -> '-', trim '-'."""
    s = F.regexp_replace(F.lower(fold(text)), r"[^a-z0-9]+", "-")
    return F.regexp_replace(s, r"^-+|-+$", "")


def search_key(text) -> Column:
    """Accent- and case-free form used for name search."""
    return F.lower(fold(text))


def _title(text: Column) -> Column:
    """Python ``str.title`` on a column: a letter after a non-letter is
    upper case, every other letter lower case."""
    tokens = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    fixed = F.transform(tokens, lambda t: F.when(
        t.rlike(r"^\p{L}"), F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, F.lit(2), F.length(t))))
    ).otherwise(t))
    return F.array_join(fixed, "")


def display_name(raw) -> Column:
    """'SURNAMES, GIVEN' -> 'Given Surnames'; no comma -> title case."""
    name = F.trim(F.coalesce(_c(raw), F.lit("")))
    surname = F.trim(F.split_part(name, F.lit(","), F.lit(1)))
    given = F.trim(F.regexp_replace(name, r"^[^,]*,", ""))
    return (F.when(name == "", F.lit(""))
            .when(name.contains(","), F.concat(_title(given), F.lit(" "), _title(surname)))
            .otherwise(_title(name)))


def _is_acronym(word: Column) -> Column:
    letters = F.regexp_replace(word, r"[^\p{L}]", "")
    vowels = "(?iu)[" + VOWELS + "]"
    return word.contains(".") | ((F.length(letters) > 0) & (F.length(letters) <= 4) & ~letters.rlike(vowels))


def _cap_segments(word: Column) -> Column:
    """Capitalise the first letter of the word and of each part after - or '."""
    parts = F.regexp_extract_all(word, F.lit(r"([-'’]|[^-'’]+)"), 1)
    fixed = F.transform(parts, lambda p: F.when(
        p.rlike(r"^\p{L}"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))
    ).otherwise(p))
    return F.array_join(fixed, "")


def team_display_name(raw) -> Column:
    """acronyms upper, link words lower (not first), others capitalised."""
    words = F.split(F.coalesce(_c(raw), F.lit("")), r"\s+")
    links = F.array(*[F.lit(w) for w in LINK_WORDS])
    fixed = F.transform(words, lambda w, i: F.when(_is_acronym(w), F.upper(w))
                        .when((i > 0) & F.array_contains(links, F.lower(w)), F.lower(w))
                        .otherwise(_cap_segments(F.lower(w))))
    return F.when(_c(raw).isNull() | (_c(raw) == ""), F.lit("")).otherwise(F.array_join(fixed, " "))


def group_slug(name) -> Column:
    """quoted part, else the name without the regular-season words;
    ASCII, non-alphanumerics -> '-', empty -> 'ungrouped'."""
    n = F.coalesce(_c(name), F.lit(""))
    quoted = F.regexp_extract(n, r'"([^"]+)"', 1)
    raw = F.when(quoted != "", quoted).otherwise(F.replace(n, F.lit(REGULAR_SEASON), F.lit("")))
    s = F.regexp_replace(fold(F.trim(raw)), r"[^A-Za-z0-9]+", "-")
    s = F.regexp_replace(s, r"^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(UNGROUPED))
