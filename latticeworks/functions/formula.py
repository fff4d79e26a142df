"""Chemical formulas: parsing, composition classes, three ways to make a formula anonymous."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that count as anions, and the class that each gives a formula in which it is the only one.
ANION_CLASSES = {"O": "oxide", "S": "sulfide", "Se": "selenide", "Te": "telluride", "F": "fluoride", "Cl": "chloride", "Br": "bromide", "I": "iodide", "N": "nitride"}
#: Upper bounds of the anion to cation ratio and their marks.
RATIO_BUCKETS = ((0.6, "lo"), (1.1, "11"), (1.7, "15"), (2.3, "20"), (3.5, "30"))
#: Elements looked at for the dominant anion of a community.
ANION_PRIORITY = ["O", "F", "Cl", "Br", "I", "S", "Se", "Te", "N", "P", "As", "H", "C"]
_STRICT = r"^([A-Z][a-z]?([0-9]*[.]?[0-9]+)?)+$"
_PART = r"([A-Z][a-z]?)([0-9]*[.]?[0-9]+)?"
_LAX = r"([A-Z][a-z]?)([0-9]*[.]?[0-9]*)"


#: Electronegativities on Pauling's scale.
ELECTRONEGATIVITY = {
    "H": 2.2, "Li": 0.98, "Be": 1.57, "B": 2.04, "C": 2.55, "N": 3.04, "O": 3.44, "F": 3.98, "Na": 0.93, "Mg": 1.31, "Al": 1.61, "Si": 1.9, "P": 2.19, "S": 2.58, "Cl": 3.16,
    "K": 0.82, "Ca": 1.0, "Sc": 1.36, "Ti": 1.54, "V": 1.63, "Cr": 1.66, "Mn": 1.55, "Fe": 1.83, "Co": 1.88, "Ni": 1.91, "Cu": 1.9, "Zn": 1.65, "Ga": 1.81, "Ge": 2.01, "As": 2.18, "Se": 2.55, "Br": 2.96, "Kr": 3.0,
    "Rb": 0.82, "Sr": 0.95, "Y": 1.22, "Zr": 1.33, "Nb": 1.6, "Mo": 2.16, "Tc": 1.9, "Ru": 2.2, "Rh": 2.28, "Pd": 2.2, "Ag": 1.93, "Cd": 1.69, "In": 1.78, "Sn": 1.96, "Sb": 2.05, "Te": 2.1, "I": 2.66, "Xe": 2.6,
    "Cs": 0.79, "Ba": 0.89, "La": 1.1, "Ce": 1.12, "Pr": 1.13, "Nd": 1.14, "Pm": 1.13, "Sm": 1.17, "Eu": 1.2, "Gd": 1.2, "Tb": 1.1, "Dy": 1.22, "Ho": 1.23, "Er": 1.24, "Tm": 1.25, "Yb": 1.1, "Lu": 1.27,
    "Hf": 1.3, "Ta": 1.5, "W": 2.36, "Re": 1.9, "Os": 2.2, "Ir": 2.2, "Pt": 2.28, "Au": 2.54, "Hg": 2.0, "Tl": 1.62, "Pb": 2.33, "Bi": 2.02, "Po": 2.0, "At": 2.2, "Rn": 2.2,
    "Fr": 0.7, "Ra": 0.9, "Ac": 1.1, "Th": 1.3, "Pa": 1.5, "U": 1.38, "Np": 1.36, "Pu": 1.28, "Am": 1.3, "Cm": 1.3, "Bk": 1.3, "Cf": 1.3, "Es": 1.3, "Fm": 1.3, "Md": 1.3, "No": 1.3,
}


def _parts(formula: Column, pattern: str) -> Column:
    names, amounts = F.regexp_extract_all(formula, F.lit(pattern), F.lit(1)), F.regexp_extract_all(formula, F.lit(pattern), F.lit(2))
    amount = lambda a: F.when(a == "", F.lit(1.0)).otherwise(F.coalesce(a.try_cast("double"), F.lit(1.0)))
    return F.zip_with(names, amounts, lambda e, a: F.struct(e.alias("e"), amount(a).alias("n")))


def parse_strict(formula: Column) -> Column:
    """Elements in order of first occurrence with their summed amounts, ARRAY<STRUCT<e, n>>; null unless the whole text is a
    flat formula (brackets, leading digits and blanks are refused)."""
    parts = _parts(formula, _PART)
    names = F.array_distinct(F.transform(parts, lambda p: p["e"]))
    summed = F.transform(names, lambda e: F.struct(e.alias("e"), F.aggregate(F.filter(parts, lambda p: p["e"] == e), F.lit(0.0), lambda s, p: s + p["n"]).alias("n")))
    return F.when(formula.rlike(_STRICT), summed)


def parse_lax(formula: Column) -> Column:
    """Every element with its amount, repeats kept, anything else skipped."""
    return _parts(formula, _LAX)


def elements(formula: Column) -> Column:
    """Distinct elements, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)"), F.lit(1))))


def has_elements(elems: Column, required: list[str], any_of: list[str] = (), most: int | None = None) -> Column:
    """All of ``required``, one of ``any_of`` unless empty, no more than ``most`` elements."""
    ok = F.size(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), elems)) == 0
    if any_of:
        ok = ok & F.arrays_overlap(elems, F.array(*map(F.lit, any_of)))
    return ok & (F.size(elems) <= most) if most is not None else ok


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda s, p: s + p["n"])


def composition_class(formula: Column) -> Column:
    """Anion class, number of elements and anion to cation ratio, as ``oxide|n3|r15``. Null for what is no strict formula."""
    parts = parse_strict(formula)
    anion = lambda p: p["e"].isin(*ANION_CLASSES)
    anions, cations = F.filter(parts, anion), F.filter(parts, lambda p: ~anion(p))
    kind = F.when(F.size(anions) == 0, "intermetallic").when(F.size(anions) > 1, "mixed-anion")
    for e, name in ANION_CLASSES.items():
        kind = kind.when(anions[0]["e"] == e, name)
    ratio = _sum(anions) / F.nullif(_sum(cations), F.lit(0.0))
    bucket = F.when(F.size(anions) == 0, "no-anion").when(ratio.isNull(), "all-anion")
    for bound, name in RATIO_BUCKETS:
        bucket = bucket.when(ratio < bound, name)
    count = F.when(F.size(parts) <= 4, F.size(parts).cast("string")).otherwise("5+")
    return F.when(parts.isNotNull(), F.concat(kind, F.lit("|n"), count, F.lit("|r"), bucket.otherwise("hi")))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm in a fold of fixed length: 46 steps reduce any pair of 32-bit numbers."""
    start = F.struct(a.cast("bigint").alias("x"), b.cast("bigint").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(46)), start, step)["x"]


def anonymous_reduced(formula: Column) -> Column:
    """Amounts in hundredths, divided by their greatest divisor, largest first: MgAl2O4 gives ``A4B2C1``."""
    amounts = F.transform(parse_strict(formula), lambda p: F.bround(p["n"] * 100, 0).cast("bigint"))
    amounts = F.reverse(F.array_sort(amounts))
    divisor = F.aggregate(amounts, F.lit(0).cast("bigint"), lambda g, n: _gcd(g, n))
    named = F.transform(amounts, lambda n, i: F.concat(F.char(F.lit(65) + i), F.floor(n / F.nullif(divisor, F.lit(0).cast("bigint"))).cast("bigint").cast("string")))
    return F.when(divisor > 0, F.array_join(named, ""))


def _plain(n: Column) -> Column:
    return F.when(n == F.floor(n), n.cast("bigint").cast("string")).otherwise(n.cast("string"))


def anonymous_ascending(formula: Column) -> Column:
    """Amounts as they stand, smallest first, ties by element: MgAl2O4 gives ``A1B2C4``. Anything but elements is skipped."""
    order = F.array_sort(F.transform(parse_lax(formula), lambda p: F.struct(p["n"].alias("n"), p["e"].alias("e"))))
    return F.array_join(F.transform(F.slice(order, 1, 26), lambda p, i: F.concat(F.char(F.lit(65) + i), _plain(p["n"]))), "")


def formula_canonical(formula: Column) -> Column:
    """Elements in alphabetical order, amounts divided by their greatest divisor in hundredths, one left out."""
    return _divided(F.array_sort(parse_strict(formula)))


def formula_reduced(formula: Column) -> Column:
    """The same with the elements from the least to the most electronegative, equals by symbol: the usual way to write it."""
    rank = F.create_map(*[F.lit(x) for pair in ELECTRONEGATIVITY.items() for x in pair])
    # elements without a value stand last
    keyed = F.transform(parse_strict(formula), lambda p: F.struct(F.coalesce(rank[p["e"]], F.lit(9.0)).alias("x"), p["e"].alias("e"), p["n"].alias("n")))
    return _divided(F.transform(F.array_sort(keyed), lambda p: F.struct(p["e"].alias("e"), p["n"].alias("n"))))


def _divided(parts: Column) -> Column:
    cents = F.transform(parts, lambda p: F.bround(p["n"] * 100, 0).cast("bigint"))
    divisor = F.aggregate(cents, F.lit(0).cast("bigint"), lambda g, n: _gcd(g, n))
    named = F.zip_with(parts, cents, lambda p, n: F.concat(p["e"], F.when(n == divisor, "").otherwise(F.floor(n / F.nullif(divisor, F.lit(0).cast("bigint"))).cast("bigint").cast("string"))))
    return F.when(divisor > 0, F.array_join(named, ""))


def class_key(formula: Column) -> Column:
    """The ascending anonymous form with the number of elements, as ``A1B2C4|3``."""
    return F.when(formula.rlike(_STRICT), F.concat(anonymous_ascending(formula), F.lit("|"), F.size(elements(formula)).cast("string")))


def dominant_anion(formula: Column) -> Column:
    """The element of largest amount among the possible anions, the first of equals; null if there is none."""
    held = F.filter(parse_lax(formula), lambda p: p["e"].isin(*ANION_PRIORITY))
    top = F.array_max(F.transform(held, lambda p: p["n"]))
    return F.when(F.size(held) > 0, F.filter(held, lambda p: p["n"] == top)[0]["e"])
