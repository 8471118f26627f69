"""Numbers with engineering suffixes and units, brought to SI."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Base units and the prefixes that datasheets write before them.
BASES = {"V": "V", "A": "A", "Ω": "Ω", "ohm": "Ω", "ohms": "Ω", "F": "F", "Hz": "Hz", "s": "s"}
PREFIX = {"p": 1e-12, "n": 1e-9, "µ": 1e-6, "u": 1e-6, "m": 1e-3, "": 1.0, "k": 1e3, "K": 1e3, "M": 1e6, "G": 1e9}
AS_THEY_ARE = {"°C": "°C", "°c": "°C", "C": "°C", "°F": "°F", "K": "K"}

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _units() -> dict[str, tuple[str, float]]:
    table = {p + b: (base, scale) for b, base in BASES.items() for p, scale in PREFIX.items()}
    table |= {p + b.lower(): (base, scale) for b, base in (("F", "F"),) for p, scale in PREFIX.items() if p}
    table |= {p + "Ohm" + s: ("Ω", scale) for p, scale in PREFIX.items() for s in ("", "s")}
    return table | {u: (base, 1.0) for u, base in AS_THEY_ARE.items()}


def number(text: Column) -> Column:
    """A number with thousands separators and a suffix p n µ u m k K M G; else the first number in the text; else null."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    base, suffix = F.regexp_extract(plain, rf"^({_NUMBER})\s*([pnµumkKMG]?)$", 1), F.regexp_extract(plain, rf"^({_NUMBER})\s*([pnµumkKMG]?)$", 2)
    scale = F.coalesce(*(F.when(suffix == p, F.lit(v)) for p, v in PREFIX.items()))
    found = F.regexp_extract(plain, f"({_NUMBER})", 1)
    return F.when(base != "", F.nullif(base, F.lit("")).try_cast("double") * scale).otherwise(F.nullif(found, F.lit("")).try_cast("double"))


def to_si(value: Column, unit: Column) -> Column:
    """``struct(value, unit, known)``; an unknown unit leaves both as they are. The unit is worked out once and looked up once."""
    table = F.create_map(*(c for u, (b, s) in sorted(_units().items()) for c in (F.lit(u), F.struct(F.lit(b).alias("b"), F.lit(s).alias("s")))))
    found = F.transform(F.array(F.trim(unit)), lambda name: F.struct(name.alias("name"), F.try_element_at(table, name).alias("hit")))
    made = lambda f: F.struct((value * F.coalesce(f["hit"]["s"], F.lit(1.0))).alias("value"), F.coalesce(f["hit"]["b"], f["name"]).alias("unit"), f["hit"].isNotNull().alias("known"))
    return F.get(F.transform(found, made), 0)


def quantity(text: Column) -> Column:
    """``3.3V``, ``-40 °C`` or ``10 kΩ`` as ``struct(value, unit, known)`` in SI; null if it doesn't begin with a number."""
    value = F.nullif(F.regexp_extract(F.replace(F.trim(text), F.lit(","), F.lit("")), f"^({_NUMBER})", 1), F.lit(""))
    unit = F.trim(F.regexp_replace(F.replace(F.trim(text), F.lit(","), F.lit("")), f"^{_NUMBER}", ""))
    return F.when(value.isNotNull(), to_si(value.try_cast("double"), unit))
