"""Quantities written in many units, as one unit of mass or of volume.

Text is read by a small grammar: amounts with a unit, added up when one follows another, ranges as their middle,
repetitions in brackets left out. Units are those of a table of measures and further spellings of them. Readings that
state no unit are decoded by a hidden Markov model (see :mod:`stockpot.operators.unit_states`).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lookalike import LATIN, LOOK

_SPELT = str.maketrans(LOOK, LATIN)

#: Spellings of the units besides the labels of the table of measures (fixed values).
SPELLINGS = {
    "g": ("gr", "gram", "grams", "gramme", "grammes"),
    "kg": ("kilo", "kilos", "kilogram", "kilograms", "kgs"),
    "jin": (),
    "liang": (),
    "oz": ("ounces", "ozs"),
    "lb": ("lbs", "pounds"),
    "ml": ("milliliter", "milliliters", "millilitre", "millilitres", "ccs"),
    "cl": ("centiliter", "centilitre"),
    "dl": ("deciliter", "decilitre"),
    "litre": ("liter", "liters", "litre", "litres", "ltr"),
    "tbsp": ("tbs", "tbsps", "tablespoon", "tablespoons"),
    "tsp": ("tsps", "teaspoon", "teaspoons"),
    "cup": ("cups",),
    "bowl": ("bowls",),
    "floz": ("floz", "fluid ounce", "fluid ounces"),
}
PACKAGES = "盒|袋|罐|包|瓶|听|箱|桶|can|cans|tin|tins|box|boxes|bag|bags|pack|packs|packet|package|bottle|bottles|jar|jars"
_FRACTIONS = {c: unicodedata.normalize("NFKC", c).replace("⁄", "/") for c in "½⅓⅔¼¾⅕⅖⅗⅘⅙⅚⅐⅛⅜⅝⅞⅑⅒"}
_DIGITS = {c: i for i, c in enumerate("零一二三四五六七八九")} | {"两": 2, "〇": 0, "俩": 2}
_POWERS = {"十": 10, "百": 100, "千": 1000, "万": 10000}

_ARABIC = r"(?:\d+\s+\d+/\d+|\d+/\d+|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+)"
_CHINESE = r"(?:[零〇一二两三四五六七八九十百千万]+?|半)"
_NUMBER = rf"(?:{_ARABIC}|{_CHINESE})"
_RANGE = r"(?:-|~|–|—|‒|―|−|〜|～|到|至|\bto\b)"


def plain(text: str) -> str:
    """Lower case, ordinary characters, single spaces; fractions written out and set apart from a whole number."""
    for c, f in _FRACTIONS.items():
        if c in text:
            text = re.sub(rf"(?<=\d)\s*{c}", f" {f}", text).replace(c, f)
    text = unicodedata.normalize("NFKC", text).replace("⁄", "/").translate(_SPELT).lower()
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    return re.sub(r"\s+", " ", text).strip()


def number(text: str) -> Fraction | None:
    """The value of an Arabic or Chinese numeral."""
    text = text.strip()
    if text == "半":
        return Fraction(1, 2)
    if text[:1].isdigit() or text[:1] == ".":
        try:
            whole, _, part = text.rpartition(" ")
            return (Fraction(whole) if whole else 0) + Fraction(part.replace(",", ""))
        except (ValueError, ZeroDivisionError):
            return None
    total = section = digit = 0
    for c in text:
        if c in _DIGITS:
            digit = _DIGITS[c] if section or not digit else digit * 10 + _DIGITS[c]
        elif c == "万":
            total, section, digit = (total + section + digit) * 10000, 0, 0
        elif c in _POWERS:
            section, digit = section + (digit or 1) * _POWERS[c], 0
        else:
            return None
    return Fraction(total + section + digit)


class Grammar:
    """Reads amounts by a table of measures: rows (unit_code, base_unit, factor_milli, labels)."""

    def __init__(self, measures: list[tuple[str, str, int, list[str]]]):
        self.units: dict[str, tuple[str, int]] = {}
        self.codes: dict[str, str] = {}
        for code, base, factor, labels in measures:
            for label in {*(plain(x) for x in labels if x and x.strip()), *SPELLINGS.get(code, ()), plain(code)}:
                self.units[label] = (base, factor)
                self.codes[label] = code
        names = sorted(self.units, key=len, reverse=True)
        # letters must not run on; dots and spaces within abbreviations are free ("fl. oz.")
        one = [re.escape(n).replace(r"\ ", r"\.?\s*") + (r"(?![a-z])\.?" if n[-1].isascii() else "") for n in names]
        unit = "(?:" + "|".join(one) + ")"
        self.unit = re.compile(unit)
        self.term = re.compile(
            rf"(?P<a>{_NUMBER})\s*(?:(?P<ua>{unit})\s*)?{_RANGE}\s*(?P<b>{_NUMBER})\s*(?P<u>{unit})(?P<rh>半)?"
            rf"|(?P<n>{_NUMBER})\s*(?P<v>{unit})(?P<h>半)?"
        )
        self.package = re.compile(rf"(?:{_NUMBER})?\s*(?:{PACKAGES})\s*\((?P<q>[^()]*)\)?")
        self.bare = re.compile(rf"^(?:约|大约|大概|净重|ca\.?|about)?\s*(?P<a>{_NUMBER})(?:\s*{_RANGE}\s*(?P<b>{_NUMBER}))?\s*(?:左右|上下|approx\.?)?$")
        self.in_name = re.compile(rf"(?:[(\[（【/]|单位\s*:?|,)\s*(?P<u>{unit})\s*[)\]）】]?\s*$")

    def _name(self, label: str) -> str:
        return re.sub(r"\.", "", label).strip() if re.sub(r"\.", "", label).strip() in self.units else re.sub(r"[.\s]+", " ", label).strip()

    def measure(self, label: str) -> tuple[str, int]:
        return self.units[self._name(label)]

    def code(self, label: str) -> str:
        return self.codes[self._name(label)]

    def terms(self, text: str) -> list[tuple[str, Fraction, str]]:
        """(base unit, thousandths, unit code) of each quantity in ``text``."""
        out = []
        for m in self.term.finditer(text):
            if m["n"]:
                base, factor = self.measure(m["v"])
                value = number(m["n"])
                value = None if value is None else (value + (Fraction(1, 2) if m["h"] else 0)) * factor
            else:
                base, factor = self.measure(m["u"])
                a, b = number(m["a"]), number(m["b"])
                first = self.measure(m["ua"])[1] if m["ua"] else factor
                half = Fraction(1, 2) if m["rh"] else 0
                value = None if a is None or b is None else (a * first + (b + half) * factor) / 2
            if value is not None:
                out.append((base, value, self.code(m["v"] or m["u"])))
        return out

    def read(self, amount: str | None) -> tuple[str, int] | None:
        """(base unit, thousandths rounded half up) that ``amount`` states, or None."""
        got = self.read_coded(amount)
        return got and got[:2]

    def read_coded(self, amount: str | None) -> tuple[str, int, str] | None:
        """As :meth:`read`, with the code of the unit that is stated first."""
        text = plain(amount or "")
        packed = self.package.search(text)
        if packed:
            found = self.terms(packed["q"])
        else:
            found = self.terms(re.sub(r"[(\[【][^)\]】]*[)\]】]?", " ", text))
        if not found or len({base for base, _, _ in found}) > 1:
            return None
        return found[0][0], _half_up(sum(v for _, v, _ in found)), found[0][2]

    def bare_number(self, amount: str | None) -> Fraction | None:
        m = self.bare.match(plain(amount)) if amount else None
        if not m:
            return None
        a, b = number(m["a"]), number(m["b"]) if m["b"] else None
        return a if b is None or a is None else (a + b) / 2

    def unit_of_name(self, name: str | None) -> tuple[str, int, str] | None:
        """(base unit, thousandths in one, unit code) of the unit at the end of a name, in brackets or after a stroke."""
        m = self.in_name.search(plain(name)) if name else None
        return (*self.measure(m["u"]), self.code(m["u"])) if m else None


def _half_up(x: Fraction) -> int:
    return int((x * 2 + 1) // 2)


def measures(spark: SparkSession, df: DataFrame) -> list[tuple[str, str, int, list[str]]]:
    """The table of measures as a list; it is a fixed dictionary of at most 1,000 units."""
    rows = df.select("unit_code", "base_unit", "factor_milli", "labels").where("unit_code is not null").limit(1_001).collect()
    if len(rows) > 1_000:
        raise ValueError("a table of measures has at most 1,000 units")
    return [(r[0], r[1], r[2], list(r[3] or [])) for r in rows]


def read_quantities(df: DataFrame, amount: str, table: list, name: str | None = None, coded: bool = False) -> DataFrame:
    """``df`` with base_unit, quantity_milli, bare: what ``amount`` states in grams or millilitres.

    With ``coded``, also unit_code: the unit that is stated first.

    Null, blank and vague amounts, counts of pieces and quantities of both mass and volume give nulls. With ``name``, a
    bare number takes the unit that stands with the name; without such a unit it is given in ``bare`` only. Every
    batch reads each different amount once. Columns of ``df`` with the names of the results are replaced.
    """
    results = ["base_unit", "quantity_milli", "bare"] + (["unit_code"] if coded else [])
    df = df.drop(*results)
    out = "base_unit string, quantity_milli long, bare double" + (", unit_code string" if coded else "")

    @F.pandas_udf(out)
    def read(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        grammar, stated, known = Grammar(table), {}, {}

        def by_name(a: str | None, n: str | None) -> tuple:
            value = grammar.bare_number(a)
            if value is None:
                return None, None, None, None
            unit = grammar.unit_of_name(n)
            return (unit[0], _half_up(value * unit[1]), float(value), unit[2]) if unit else (None, None, float(value), None)

        for amounts, names in it:
            rows = []
            for a, n in zip(amounts, names):
                # an amount that states a quantity by itself needs no name
                if a not in stated:
                    if len(stated) > 200_000:
                        stated.clear()
                    stated[a] = grammar.read_coded(a) if a else None
                key = (a, n)
                if stated[a] is None and key not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[key] = by_name(a, n)
                got = stated[a]
                rows.append((got[0], got[1], None, got[2]) if got else known[key])
            yield pd.DataFrame(rows, columns=["base_unit", "quantity_milli", "bare", "unit_code"])[results].astype({"quantity_milli": "Int64"})

    label = F.col(name) if name else F.lit(None).cast("string")
    return df.withColumn("__q", read(F.col(amount), label)).select(*df.columns, *(f"__q.{c}" for c in results))
