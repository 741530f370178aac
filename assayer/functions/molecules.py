"""Expressions over structure strings and molecular formulas.

Validity here is lexical: token grammar, at least one atom, equal counts of
opening and closing parentheses, ring digits in pairs.  Valence is not checked.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The token grammar of a structure string.
TOKEN = r"\[[^\[\]]+\]|Br|Cl|[BCNOPSFI]|[bcnops]|\*|[-=#$:/\\~.]|\(|\)|%[0-9]{2}|[0-9]"
# The characters a request may contain.
REQUEST_CHARS = r"^[A-Za-z0-9()\[\]{}=\-#@+.:]+$"

# Standard atomic weights, elements 1 to 118 in order of number.
ATOMIC_MASS = {
    "H": 1.008, "He": 4.0026, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011,
    "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180, "Na": 22.990, "Mg": 24.305,
    "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Ar": 39.95,
    "K": 39.098, "Ca": 40.078, "Sc": 44.956, "Ti": 47.867, "V": 50.942, "Cr": 51.996,
    "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38,
    "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Kr": 83.798,
    "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224, "Nb": 92.906, "Mo": 95.95,
    "Tc": 97.0, "Ru": 101.07, "Rh": 102.91, "Pd": 106.42, "Ag": 107.87, "Cd": 112.41,
    "In": 114.82, "Sn": 118.71, "Sb": 121.76, "Te": 127.60, "I": 126.90, "Xe": 131.29,
    "Cs": 132.91, "Ba": 137.33, "La": 138.91, "Ce": 140.12, "Pr": 140.91, "Nd": 144.24,
    "Pm": 145.0, "Sm": 150.36, "Eu": 151.96, "Gd": 157.25, "Tb": 158.93, "Dy": 162.50,
    "Ho": 164.93, "Er": 167.26, "Tm": 168.93, "Yb": 173.05, "Lu": 174.97, "Hf": 178.49,
    "Ta": 180.95, "W": 183.84, "Re": 186.21, "Os": 190.23, "Ir": 192.22, "Pt": 195.08,
    "Au": 196.97, "Hg": 200.59, "Tl": 204.38, "Pb": 207.2, "Bi": 208.98, "Po": 209.0,
    "At": 210.0, "Rn": 222.0, "Fr": 223.0, "Ra": 226.0, "Ac": 227.0, "Th": 232.04,
    "Pa": 231.04, "U": 238.03, "Np": 237.0, "Pu": 244.0, "Am": 243.0, "Cm": 247.0,
    "Bk": 247.0, "Cf": 251.0, "Es": 252.0, "Fm": 257.0, "Md": 258.0, "No": 259.0,
    "Lr": 262.0, "Rf": 267.0, "Db": 270.0, "Sg": 269.0, "Bh": 270.0, "Hs": 270.0,
    "Mt": 278.0, "Ds": 281.0, "Rg": 281.0, "Cn": 285.0, "Nh": 286.0, "Fl": 289.0,
    "Mc": 289.0, "Lv": 293.0, "Ts": 293.0, "Og": 294.0,
}

_ELEMENT = r"([A-Z][a-z]?)([0-9]*)"


def _occurrences(text: Column, token: str) -> Column:
    """How often a one-character token occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))


def reject_reason(structure: Column) -> Column:
    """Why a structure string is not valid, or null when it is.

    Tests run cheapest first and stop at the first that fails, so prose is
    refused by one character scan.  Tokens are removed rather than matched as
    one repeated group: a repeated group would recurse on long strings.
    """
    text = F.trim(structure)
    # Ring digits outside brackets, sorted; taking pairs away leaves the odd ones.
    digits = F.array_sort(F.split(F.regexp_replace(text, r"\[[^\[\]]+\]|[^0-9]", ""), ""))
    odd_rings = F.regexp_replace(F.array_join(digits, ""), r"([0-9])\1", "")
    return (
        F.when(structure.isNull() | (text == ""), "empty")
        .when(text.rlike(r"\s"), "token")
        .when(F.regexp_replace(text, TOKEN, "") != "", "token")
        .when(~text.rlike(r"[A-Za-z*]"), "no_atom")
        .when(_occurrences(text, "(") != _occurrences(text, ")"), "parentheses")
        .when(~F.contains(text, F.lit("%")) & (odd_rings != ""), "ring")
    )


def allowed_characters(structure: Column) -> Column:
    """The weaker request rule: not blank and only characters from the list."""
    return F.coalesce((F.trim(structure) != "") & structure.rlike(REQUEST_CHARS), F.lit(False))


def main_fragment(structure: Column) -> Column:
    """Longest dot-separated part; the first one among equals."""
    parts = F.split(structure, r"\.")
    ranked = F.transform(
        parts, lambda part, at: F.struct(F.length(part).alias("size"), (-at).alias("at"), part.alias("part"))
    )
    return F.array_max(ranked)["part"]


def _formula_terms(formula: Column, group: int) -> Column:
    bare = F.regexp_replace(formula, r"[+-][0-9]*$", "")
    return F.regexp_extract_all(bare, F.lit(_ELEMENT), F.lit(group))


def _formula_total(formula: Column, weight) -> Column:
    """Sum of ``weight(symbol)`` over all atoms; null if any part is unknown.

    Stays inside the row: no explode, join or shuffle.
    """
    bare = F.regexp_replace(formula, r"[+-][0-9]*$", "")
    readable = (bare != "") & (F.regexp_replace(bare, _ELEMENT, "") == "")
    amount = lambda n: F.when(n == "", 1.0).otherwise(n.try_cast("double"))
    total = F.aggregate(
        F.zip_with(_formula_terms(formula, 1), _formula_terms(formula, 2), lambda s, n: weight(s) * amount(n)),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.when(readable, total)


def formula_mass(formula: Column) -> Column:
    """Molecular weight of a formula such as ``C9H8O4``."""
    masses = F.create_map(*[F.lit(x) for item in ATOMIC_MASS.items() for x in item])
    return _formula_total(formula, lambda symbol: F.try_element_at(masses, symbol))


def formula_heavy_atoms(formula: Column) -> Column:
    """Number of atoms other than hydrogen."""
    known = F.array(*[F.lit(s) for s in ATOMIC_MASS])
    weight = lambda s: F.when(s == "H", 0.0).when(F.array_contains(known, s), 1.0)
    return _formula_total(formula, weight).cast("int")


def symbol_count(structure: Column, symbol: str) -> Column:
    """Plain count of a character in the structure string."""
    return _occurrences(structure, symbol)


def counted_weight(structure: Column) -> Column:
    """20 + 20 per ``O`` + 12 per ``N``: the token-weighted sum."""
    return F.lit(20) + 20 * symbol_count(structure, "O") + 12 * symbol_count(structure, "N")
