"""Column-name normalisation: a change of schema only, never a pass over the data."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame


def snake_name(name: str) -> str:
    """Lower snake case without accents or punctuation; never empty, never starting with a digit."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    plain = plain.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", plain)
    plain = re.sub(r"(?<=[A-Z])(?=[A-Z][a-z])", "_", plain)
    plain = re.sub(r"[^A-Za-z0-9]+", "_", plain).strip("_").lower()
    return plain if plain and not plain[0].isdigit() else f"x{plain}"


def unique_names(names: list[str]) -> list[str]:
    """Number the repeats of a name: ``a, a, a`` becomes ``a, a_2, a_3``."""
    seen: set[str] = set()
    result = []
    for name in names:
        candidate, count = name, 1
        while candidate in seen:
            count += 1
            candidate = f"{name}_{count}"
        seen.add(candidate)
        result.append(candidate)
    return result


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([snake_name(c) for c in df.columns]))
