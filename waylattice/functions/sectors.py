"""Sector identifiers, node identifiers and labels as column expressions."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that stand for a sector: a whole number, or one with zeros as decimals.
WHOLE = r"^[+-]?[0-9]+(\.0+)?$"


def sector_id(value: Column) -> Column:
    """Null and blank become null; whole numbers lose leading zeros and decimals and get two digits at least; other text is trimmed."""
    t = F.regexp_replace(value.cast("string"), r"^[\s\x{85}\x{a0}]+|[\s\x{85}\x{a0}]+$", "")
    digits = F.regexp_extract(t, r"^[+-]?0*([0-9]+?)(\.0+)?$", 1)
    sign = F.when(t.startswith("-") & (digits != "0"), "-").otherwise("")
    padded = F.when((F.length(digits) < 2) & (sign == ""), F.concat(F.lit("0"), digits)).otherwise(F.concat(sign, digits))
    return F.when(F.length(t) > 0, F.when(t.rlike(WHOLE), padded).otherwise(t))


def sector_id_of(value: object) -> str | None:
    """sector_id for a single value."""
    if value is None or value != value:
        return None
    t = str(value).strip()
    if re.match(WHOLE, t):
        n = int(t.split(".")[0])
        return f"{n:02d}"
    return t or None


def node_id(type_: Column, cluster: Column) -> Column:
    """type=<percent-encoded type>::cluster=<number>. Spark's encoder differs from percent-encoding in three characters."""
    encoded = F.replace(F.replace(F.replace(F.url_encode(type_), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    return F.concat(F.lit("type="), encoded, F.lit("::cluster="), cluster.cast("string"))


def node_id_of(type_: str, cluster: int) -> str:
    return f"type={quote(type_, safe='')}::cluster={int(cluster)}"


def label(value: Column) -> Column:
    """A spreadsheet label for comparison: whitespace collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(value.cast("string"), r"\s+", " ")))


def label_of(value: object) -> str | None:
    t = " ".join(str(value).split()).casefold() if value is not None and value == value else ""
    return t or None


def sheet_of(value: str) -> str | int:
    """A worksheet by name, or by number if it is one."""
    return int(value) if value.strip().isdigit() else value
