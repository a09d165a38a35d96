"""Canonical names for regions that arrive in many spellings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The five macro-regions, keyed by their plain lower-case form.
MACRO_REGIONS = {
    "centro norte": "Centro-Norte",
    "centro oeste": "Centro-Oeste",
    "centro sudeste": "Centro-Sudeste",
    "nordeste": "Nordeste",
    "sudoeste": "Sudoeste",
}

ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
UNACCENTED = "aaaaaeeeeiiiiooooouuuucn"


def plain_label(c: Column | str, prefix: str = "macrorregi.o ") -> Column:
    """Lower case, no accents, ``_`` and ``-`` as blanks, without the leading ``prefix`` pattern."""
    c = F.col(c) if isinstance(c, str) else c
    text = F.translate(F.lower(F.trim(c)), ACCENTED, UNACCENTED)
    return F.regexp_replace(F.regexp_replace(text, "[_-]", " "), f"^{prefix}", "")


def canonical_label(
    c: Column | str, names: Mapping[str, str] = MACRO_REGIONS, prefix: str = "macrorregi.o "
) -> Column:
    """The canonical name for any spelling of it; missing for an unknown label."""
    pairs = [F.lit(text) for item in names.items() for text in item]
    return F.try_element_at(F.create_map(*pairs), plain_label(c, prefix))


def recode(c: Column | str, names: Mapping) -> Column:
    """Exact recode; a value outside ``names`` becomes missing."""
    c = F.col(c) if isinstance(c, str) else c
    result = None
    for old, new in names.items():
        result = F.when(c == old, new) if result is None else result.when(c == old, new)
    return result


def ordered_codes(c: Column | str, levels: list[str]) -> Column:
    """Position of a category in its ordered list of levels, counted from 1."""
    return recode(c, {level: rank for rank, level in enumerate(levels, start=1)})
