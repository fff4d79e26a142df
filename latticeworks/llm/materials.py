"""Reading what the sources say about a material: formula notations, cells, space groups and site lists."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

_SUBSCRIPTS = str.maketrans("₀₁₂₃₄₅₆₇₈₉", "0123456789")
_FORMULA = re.compile(r"(?:[A-Z][a-z]?|\d*\.?\d+|[()\[\]])+")
_PART = re.compile(r"([A-Z][a-z]?)|(\d*\.?\d+)|([(\[])|([)\]])")
#: A denominator of fractional amounts is looked for up to here; and how far an amount may lie from a whole number, in parts of it.
_MOST_UNITS, _SLACK = 24, 0.02

#: Number and short symbol of frequent space groups, by number; settings besides the standard one follow.
_GROUPS = """
1 P1 2 P-1 3 P2 4 P21 5 C2 6 Pm 7 Pc 8 Cm 9 Cc 10 P2/m 11 P21/m 12 C2/m 13 P2/c 14 P21/c 15 C2/c 16 P222 18 P21212 19 P212121
20 C2221 25 Pmm2 26 Pmc21 29 Pca21 31 Pmn21 33 Pna21 36 Cmc21 38 Amm2 40 Ama2 41 Aea2 42 Fmm2 43 Fdd2 44 Imm2 46 Ima2 47 Pmmm
51 Pmma 52 Pnna 53 Pmna 54 Pcca 55 Pbam 56 Pccn 57 Pbcm 58 Pnnm 59 Pmmn 60 Pbcn 61 Pbca 62 Pnma 63 Cmcm 64 Cmce 65 Cmmm 66 Cccm
67 Cmme 69 Fmmm 70 Fddd 71 Immm 72 Ibam 74 Imma 82 I-4 85 P4/n 86 P42/n 87 I4/m 88 I41/a 92 P41212 96 P43212 99 P4mm 107 I4mm
109 I41md 113 P-421m 115 P-4m2 119 I-4m2 121 I-42m 122 I-42d 123 P4/mmm 125 P4/nbm 127 P4/mbm 128 P4/mnc 129 P4/nmm 130 P4/ncc
131 P42/mmc 136 P42/mnm 137 P42/nmc 138 P42/ncm 139 I4/mmm 140 I4/mcm 141 I41/amd 142 I41/acd 146 R3 147 P-3 148 R-3 150 P321
152 P3121 155 R32 156 P3m1 160 R3m 161 R3c 162 P-31m 163 P-31c 164 P-3m1 165 P-3c1 166 R-3m 167 R-3c 173 P63 174 P-6 176 P63/m
180 P6222 182 P6322 186 P63mc 187 P-6m2 189 P-62m 190 P-62c 191 P6/mmm 193 P63/mcm 194 P63/mmc 198 P213 199 I213 205 Pa-3 206 Ia-3
215 P-43m 216 F-43m 217 I-43m 218 P-43n 220 I-43d 221 Pm-3m 223 Pm-3n 224 Pn-3m 225 Fm-3m 226 Fm-3c 227 Fd-3m 229 Im-3m 230 Ia-3d
14 P21/n 14 P21/a 14 P21/b 15 I2/a 15 A2/a 15 I2/c 12 I2/m 12 A2/m 5 I2 5 A2 9 Ia 9 In 62 Pbnm 62 Pmcn 62 Pnam 62 Pmnb 62 Pcmn
64 Cmca 64 Bmab 63 Amam 63 Bbmm 63 Ccmm 36 Bm21b 36 Ccm21 33 Pn21a 33 P21nb 33 Pbn21 57 Pmab 57 Pbma 60 Pcan 60 Pnab 61 Pcab 41 Aba2
67 Cmma 205 Pa3 225 Fm3m 227 Fd3m 221 Pm3m 229 Im3m
"""
_NUMBERS = {s.lower(): int(n) for n, s in zip(_GROUPS.split()[::2], _GROUPS.split()[1::2], strict=True)}


def parse_formula(text: str | None) -> dict[str, float] | None:
    """Amounts by element of a formula in any notation: subscripts, markup, blanks, fractions, brackets, any order. None if it
    is not a formula."""
    if not text:
        return None
    text = re.sub(r"\s+", "", re.sub(r"</?sub>", "", text).translate(_SUBSCRIPTS))
    if not _FORMULA.fullmatch(text):
        return None
    levels: list[Counter] = [Counter()]
    last: Counter = Counter()  # what a number multiplies
    for element, number, opening, _closing in _PART.findall(text):
        if opening:
            levels.append(Counter())
            continue
        if number:
            if not last:
                return None
            for e, n in last.items():
                levels[-1][e] += n * (float(number) - 1)
            last = Counter()
            continue
        if element:
            last = Counter({element: 1.0})
        else:
            if len(levels) < 2:
                return None
            last = levels.pop()
        levels[-1].update(last)
    amounts = {e: n for e, n in levels[0].items() if n > 0}
    return amounts if len(levels) == 1 and amounts else None


def reduce_amounts(amounts: dict[str, float] | None) -> dict[str, int] | None:
    """The smallest whole numbers in the proportions of ``amounts``.

    Whole amounts are divided by their greatest divisor. Others are taken as measured whole numbers if all lie near one, else
    as fractions, and scaled by the smallest factor that brings all near whole numbers. None if there is none.
    """
    if not amounts:
        return None
    if all(n == int(n) for n in amounts.values()):
        whole = {e: int(n) for e, n in amounts.items()}
    else:
        whole = None
        least = min(amounts.values())
        for unit in [1.0, *(k / max(amounts.values()) for k in range(1, _MOST_UNITS + 1))]:
            near = {e: round(n * unit) for e, n in amounts.items()}
            slack = _SLACK if unit == 1.0 else 0.0015 * unit / least * least + 0.002
            if min(near.values()) > 0 and all(abs(n * unit - near[e]) <= (slack * near[e] if unit == 1.0 else slack) for e, n in amounts.items()):
                whole = near
                break
        if whole is None:
            return None
    divisor = math.gcd(*whole.values())
    return {e: n // divisor for e, n in whole.items()}


def composition_key(whole: dict[str, int]) -> str:
    return "".join(f"{e}{whole[e]}" for e in sorted(whole))


def space_group(text) -> int | None:
    """The number of a space group given as number, symbol in any setting and letter case, or both."""
    if text is None:
        return None
    text = str(text).strip()
    number = re.search(r"\((\d{1,3})\)", text) or re.fullmatch(r"(?:no\.?|sg|#)?\s*(\d{1,3})(?:\.0)?", text, re.I)
    if number:
        return int(number[1]) if 1 <= int(number[1]) <= 230 else None
    symbol = re.sub(r"[\s_]|:.*$", "", text).lower()
    full = re.fullmatch(r"([pcaibf])1(.+)1", symbol)  # the full symbol of a monoclinic group
    return _NUMBERS.get(symbol) or (_NUMBERS.get(full[1] + full[2]) if full else None)


def cell_volume(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> float | None:
    x, y, z = (math.cos(math.radians(v)) for v in (alpha, beta, gamma))
    square = 1 - x * x - y * y - z * z + 2 * x * y * z
    return a * b * c * math.sqrt(square) if square > 0 and a * b * c > 0 else None


def determinant(m) -> float | None:
    (a, b, c), (d, e, f), (g, h, i) = m
    v = abs(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g))
    return v if v > 0 and math.isfinite(v) else None


def read_structure(text: str | None) -> tuple[dict[str, int] | None, float | None]:
    """Atoms by element and volume of a cell in one of the three JSON layouts; (None, None) if it cannot be read."""
    try:
        j = json.loads(text)
        atoms: Counter = Counter()
        if "elements" in j:
            atoms.update(j["elements"])
            volume = determinant(j["lattice_mat"])
        elif "species" in j:
            for e, n in j["species"]:
                atoms[e] += int(n)
            cell = j["lattice"]
            volume = cell_volume(*(float(cell[k]) for k in ("a", "b", "c", "alpha", "beta", "gamma"))) or float(cell["volume"])
        else:
            for site in j["sites"]:
                atoms[site["species"]] += int(site["count"])
            volume = determinant(j["lattice"]["matrix"])
        atoms = {e: n for e, n in atoms.items() if isinstance(e, str) and n > 0}
        return (dict(atoms) or None), volume
    except (TypeError, ValueError, KeyError, AttributeError):
        return None, None


_NUM = r"(\d+(?:\.\d+)?)"
_LENGTHS = [
    re.compile(rf"\(a, b, c\) = \({_NUM}, {_NUM}, {_NUM}\)"),
    re.compile(rf"cell {_NUM} x {_NUM} x {_NUM}"),
    re.compile(rf"in pm: {_NUM}, {_NUM}, {_NUM}"),
    re.compile(rf"a\s*=\s*{_NUM}\D+b\s*=\s*{_NUM}\D+c\s*=\s*{_NUM}"),
]
_ANGLES = [
    re.compile(rf"alpha {_NUM} beta {_NUM} gamma {_NUM}"),
    re.compile(rf"\({_NUM}, {_NUM}, {_NUM}\), SG"),
    re.compile(rf"angles {_NUM}[ /]{_NUM}[ /]{_NUM}"),
]
_ATOMS = [re.compile(r"N\s*=\s*(\d+)"), re.compile(r"(\d+) (?:atoms|sites)")]
_GROUP = [re.compile(r"(?:no\.|SG|#)\s*(\d+)"), re.compile(r"space group ([^;,]+)"), re.compile(r"^\s*([A-Za-z][^,;]*?)\s*,\s*N\s*=")]


def read_report(text: str | None) -> tuple[int | None, float | None, int | None]:
    """Space group, volume in cubic angstrom and number of atoms of the cell that a free-text conclusion gives."""
    if not text:
        return None, None, None
    lengths = next((m for r in _LENGTHS if (m := r.search(text))), None)
    angles = next((m for r in _ANGLES if (m := r.search(text))), None)
    atoms = next((int(m[1]) for r in _ATOMS if (m := r.search(text))), None)
    group = next((g for r in _GROUP if (m := r.search(text)) and (g := space_group(m[1]))), None)
    volume = None
    if lengths:
        scale = 0.01 if " pm" in text else 1.0
        volume = cell_volume(*(float(x) * scale for x in lengths.groups()), *(map(float, angles.groups()) if angles else (90.0, 90.0, 90.0)))
    return group, volume, atoms


def readings(formula: str | None, atoms: dict[str, int] | None, volume: float | None, n_atoms: int | None = None) -> list[tuple[str, float, float]]:
    """(composition, volume per atom, trust) of each way to read a record; [] if none.

    Formula and site list agreeing is certain. Where they differ, the formula's units in the cell tell which is wrong: a site
    list from which atoms are missing is no multiple of them, a list of another whole number of units is complete and the
    formula wrong. In a cell of one unit both stand. Without a site list, the number of atoms must hold whole units, else one
    amount of the formula is off.
    """
    if not volume:
        return []
    whole = reduce_amounts(parse_formula(formula))
    if atoms is None:
        if not whole or not n_atoms:
            return []
        if n_atoms % sum(whole.values()) == 0:
            return [(composition_key(whole), volume / n_atoms, 1.0)]
        out = [(composition_key(whole), volume / n_atoms, 0.5)]
        for e in whole:
            for step in (-1, 1):
                other = {**whole, e: whole[e] + step}
                if other[e] and math.gcd(*other.values()) == 1 and n_atoms % sum(other.values()) == 0:
                    out.append((composition_key(other), volume / n_atoms, 0.65))
        return out
    held = sum(atoms.values())
    listed = reduce_amounts({e: float(n) for e, n in atoms.items()})
    if whole == listed:
        return [(composition_key(listed), volume / held, 1.0)]
    if whole is None:
        out = [(composition_key(listed), volume / held, 0.9)]
        for e in atoms:
            rest = [n for k, n in atoms.items() if k != e]
            unit = math.gcd(*rest) if rest else 0
            if unit > 1 and atoms[e] % unit:  # atoms of one element may be missing
                full = {**atoms, e: -(-atoms[e] // unit) * unit}
                out.append((composition_key(reduce_amounts(full)), volume / sum(full.values()), 0.65))
        return out
    if not set(atoms) <= set(whole):
        return [(composition_key(listed), volume / held, 0.9)]
    units = Counter(n // whole[e] for e, n in atoms.items() if n % whole[e] == 0)
    if not units:
        return [(composition_key(listed), volume / held, 0.6), (composition_key(whole), volume / held, 0.6)]
    z = max(units, key=lambda k: (units[k], k))
    missing = all(n <= z * whole[e] for e, n in atoms.items())
    by_formula = (composition_key(whole), volume / (z * sum(whole.values())))
    by_sites = (composition_key(listed), volume / held)
    if set(atoms) == set(whole) and all(n % z == 0 for n in atoms.values()):
        if z > 1 or not missing:
            return [(*by_sites, 0.95), (*by_formula, 0.5)]
        return [(*by_sites, 0.75), (*by_formula, 0.75)]
    return [(*by_formula, 0.95), (*by_sites, 0.4)] if missing else [(*by_sites, 0.8)]
