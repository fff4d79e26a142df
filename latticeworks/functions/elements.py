"""Properties of the elements: numbers, places in the periodic table by rule, and fixed values."""

from __future__ import annotations

#: Symbols in the order of their numbers.
SYMBOLS = """H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba
La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr""".split()
#: Standard atomic weights in the same order.
WEIGHTS = [
    1.008, 4.0026, 6.94, 9.0122, 10.81, 12.011, 14.007, 15.999, 18.998, 20.18, 22.99, 24.305, 26.982, 28.085, 30.974, 32.06, 35.45, 39.948, 39.098, 40.078, 44.956, 47.867, 50.942, 51.996, 54.938, 55.845, 58.933, 58.693, 63.546, 65.38,
    69.723, 72.63, 74.922, 78.971, 79.904, 83.798, 85.468, 87.62, 88.906, 91.224, 92.906, 95.95, 98.0, 101.07, 102.91, 106.42, 107.87, 112.41, 114.82, 118.71, 121.76, 127.6, 126.9, 131.29, 132.91, 137.33, 138.91, 140.12, 140.91, 144.24,
    145.0, 150.36, 151.96, 157.25, 158.93, 162.5, 164.93, 167.26, 168.93, 173.05, 174.97, 178.49, 180.95, 183.84, 186.21, 190.23, 192.22, 195.08, 196.97, 200.59, 204.38, 207.2, 208.98, 209.0, 210.0, 222.0, 223.0, 226.0, 227.0, 232.04,
    231.04, 238.03, 237.0, 244.0, 243.0, 247.0, 247.0, 251.0, 252.0, 257.0, 258.0, 259.0, 266.0,
]
#: Empirical atomic radii in picometres, None where there is none.
RADII = [
    25, None, 145, 105, 85, 70, 65, 60, 50, None, 180, 150, 125, 110, 100, 100, 100, 71, 220, 180, 160, 140, 135, 140, 140, 140, 135, 135, 135, 135, 130, 125, 115, 115, 115, None, 235, 200, 180, 155, 145, 145, 135, 130, 135, 140, 160, 155,
    155, 145, 145, 140, 140, None, 260, 215, 195, 185, 185, 185, 185, 185, 185, 180, 175, 175, 175, 175, 175, 175, 175, 155, 145, 135, 135, 130, 135, 135, 135, 150, 190, 180, 160, 190, None, None, None, 215, 195, 180, 180, 175, 175, 175, 175,
]
NUMBER = {s: z for z, s in enumerate(SYMBOLS, 1)}
_NOBLE = [2, 10, 18, 36, 54, 86, 118]


def place(z: int) -> tuple[int, int, int]:
    """Row, group and block (0 s, 1 p, 2 d, 3 f) of the element with number z; lanthanides and actinides count to group 3."""
    row = next(k for k, n in enumerate(_NOBLE, 1) if z <= n)
    first, last = ([0, *_NOBLE][row - 1]) + 1, _NOBLE[row - 1]
    at, length = z - first, last - first + 1
    if z == 2:
        return 1, 18, 0
    if at < 2:
        return row, at + 1, 0
    if last - z < 6:
        return row, 18 - (last - z), 1
    if length == 32 and at < 16:
        return row, 3, 3
    return row, (at - 13 if length == 32 else at + 1), 2


def vector(species: dict[str, float], ionic_radii: dict[str, float] | None = None) -> list[float]:
    """Number, row, group, atomic radius, ionic radius, electronegativity and block, averaged over the species of a site by their
    occupancy. Unknown species do not count; a value that is not known is 0. Ionic radii are a parameter."""
    from .formula import ELECTRONEGATIVITY

    total, out = 0.0, [0.0] * 7
    for symbol, share in species.items():
        z = NUMBER.get(symbol)
        if not z:
            continue
        row, group, block = place(z)
        radius = RADII[z - 1] if z <= len(RADII) else None
        values = (z, row, group, (radius or 0) / 100, (ionic_radii or {}).get(symbol, 0.0), ELECTRONEGATIVITY.get(symbol, 0.0), block)
        out = [a + share * b for a, b in zip(out, values, strict=True)]
        total += share
    return [a / total for a in out] if total > 0 else out
