"""Crystal structures from text: three JSON layouts and CIF. Python, for use inside Arrow maps."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

import numpy as np


@dataclass
class Structure:
    lattice: np.ndarray  #: 3 x 3, one vector a row, in angstrom
    species: list[dict[str, float]]  #: of each site, by occupancy
    places: np.ndarray | None  #: fractional coordinates; None if the text has none

    @property
    def volume(self) -> float:
        return float(abs(np.linalg.det(self.lattice)))

    @property
    def cell(self) -> tuple[float, ...]:
        """Lengths and angles."""
        a, b, c = self.lattice
        n = [float(np.linalg.norm(v)) for v in (a, b, c)]
        angle = lambda x, y: math.degrees(math.acos(max(-1.0, min(1.0, float(x @ y) / float(np.linalg.norm(x) * np.linalg.norm(y))))))
        return (*n, angle(b, c), angle(a, c), angle(a, b))


def from_cell(a: float, b: float, c: float, alpha: float, beta: float, gamma: float) -> np.ndarray:
    """The lattice of lengths and angles, a along x, b in the plane of x and y."""
    ca, cb, cg = (math.cos(math.radians(t)) for t in (alpha, beta, gamma))
    sg = math.sin(math.radians(gamma))
    y = (ca - cb * cg) / sg
    z = 1 - cb * cb - y * y
    if z <= 0 or min(a, b, c) <= 0:
        raise ValueError("no cell has these lengths and angles")
    return np.array([[a, 0, 0], [b * cg, b * sg, 0], [c * cb, c * y, c * math.sqrt(z)]])


def _site(species) -> dict[str, float]:
    if isinstance(species, str):
        return {species: 1.0}
    return {re.sub(r"[^A-Za-z].*$", "", s["element"]): float(s.get("occu", 1.0)) for s in species}


def from_json(text: str) -> Structure:
    j = json.loads(text)
    if "elements" in j:
        lattice = np.array(j["lattice_mat"], float)
        places = np.array(j["coords"], float) if j.get("coords") else None
        if places is not None and j.get("cartesian"):
            places = places @ np.linalg.inv(lattice)
        return Structure(lattice, [{e: 1.0} for e in j["elements"]], places)
    cell = j["lattice"]
    lattice = np.array(cell["matrix"], float) if "matrix" in cell else from_cell(*(float(cell[k]) for k in ("a", "b", "c", "alpha", "beta", "gamma")))
    if "species" in j:
        return Structure(lattice, [{e: 1.0} for e, n in j["species"] for _ in range(int(n))], None)
    sites = [s for s in j["sites"] for _ in range(int(s.get("count", 1)))]
    held = all("abc" in s for s in sites)
    return Structure(lattice, [_site(s["species"]) for s in sites], np.array([s["abc"] for s in sites], float) if held and sites else None)


_NUMBER = re.compile(r"-?\d+\.?\d*(?:[eE][-+]?\d+)?|-?\.\d+")


def _number(word: str) -> float:
    found = _NUMBER.match(word)
    if not found:
        raise ValueError(f"no number: {word}")
    return float(found[0])


def _operation(text: str):
    """A symmetry operation such as ``-x+1/2, y, -z`` as matrix and shift."""
    m, t = np.zeros((3, 3)), np.zeros(3)
    for i, part in enumerate(text.lower().replace(" ", "").split(",")):
        for sign, number, over, axis in re.findall(r"([+-]?)(?:(\d+\.?\d*)(?:/(\d+))?)?\*?([xyz]?)", part):
            if not number and not axis:
                continue
            value = (float(number) / float(over or 1) if number else 1.0) * (-1 if sign == "-" else 1)
            if axis:
                m[i, "xyz".index(axis)] += value
            else:
                t[i] += value
    return m, t


def from_cif(text: str, near: float = 1e-3) -> Structure:
    """The first block of a CIF: cell, sites, and the sites that its symmetry operations make of them."""
    words, values, loops = re.findall(r"'[^']*'(?=\s|$)|\"[^\"]*\"(?=\s|$)|[^\s]+", re.sub(r"(?m)(^|\s)#.*$", "", text)), {}, []
    i = 0
    strip = lambda w: w[1:-1] if len(w) > 1 and w[0] == w[-1] and w[0] in "'\"" else w
    while i < len(words):
        w = words[i].lower()
        if w == "loop_":
            i, names, rows = i + 1, [], []
            while i < len(words) and words[i].startswith("_"):
                names.append(words[i].lower())
                i += 1
            while i < len(words) and not words[i].startswith(("_", "data_")) and words[i].lower() != "loop_":
                rows.append(strip(words[i]))
                i += 1
            loops.append((names, [rows[k : k + len(names)] for k in range(0, len(rows) - len(names) + 1, max(len(names), 1))]))
        elif w.startswith("_") and i + 1 < len(words):
            values.setdefault(w, strip(words[i + 1]))
            i += 2
        elif w.startswith("data_") and values:
            break
        else:
            i += 1
    lattice = from_cell(*(_number(values[f"_cell_{k}"]) for k in ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")))
    column = lambda names, *wanted: next((names.index(n) for n in wanted if n in names), None)
    operations, sites = [], []
    for names, rows in loops:
        at = column(names, "_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz")
        if at is not None:
            operations = [_operation(r[at]) for r in rows]
        xyz = [column(names, f"_atom_site_fract_{k}") for k in "xyz"]
        kind = column(names, "_atom_site_type_symbol", "_atom_site_label")
        if None not in xyz and kind is not None:
            share = column(names, "_atom_site_occupancy")
            sites = [(re.match(r"[A-Za-z]{1,2}", r[kind])[0], np.array([_number(r[k]) for k in xyz]), _number(r[share]) if share is not None and r[share] not in ("?", ".") else 1.0) for r in rows]
    if not sites:
        raise ValueError("no sites")
    species, places = [], []
    for symbol, x, share in sites:
        symbol = symbol if symbol.capitalize() == symbol else symbol[0]
        for m, t in operations or [(np.eye(3), np.zeros(3))]:
            y = (m @ x + t) % 1.0
            same = next((k for k, p in enumerate(places) if np.abs((p - y + 0.5) % 1.0 - 0.5).max() < near), None)
            if same is None:
                places.append(y)
                species.append({symbol: share})
            else:
                species[same].setdefault(symbol, share)  # two species may share a place
    return Structure(lattice, species, np.array(places))


def parse(text: str | None) -> Structure:
    """A structure from JSON or CIF text; ``ValueError`` says what is wrong."""
    if not text or not text.strip():
        raise ValueError("no text")
    try:
        s = from_json(text) if text.lstrip().startswith("{") else from_cif(text)
    except (KeyError, TypeError, IndexError, np.linalg.LinAlgError) as e:
        raise ValueError(f"cannot be read: {e!r}"[:200]) from e
    if s.lattice.shape != (3, 3) or not np.isfinite(s.lattice).all() or s.volume <= 0:
        raise ValueError("no cell")
    return s


def neighbours(s: Structure, reach: float = 1.25):
    """(site, neighbour, weight, distance) of each site: all images within ``reach`` times its nearest distance, weighted by the
    inverse square of their distance as parts of the nearest."""
    n = len(s.species)
    steps = np.array([[i, j, k] for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)], float)
    images = (s.places[:, None, :] + steps[None]) @ s.lattice
    own = s.places @ s.lattice
    d = np.sqrt(((own[:, None, None, :] - images[None]) ** 2).sum(-1)).reshape(n, -1)
    d[d < 1e-6] = np.inf
    nearest = d.min(1)
    a, b = np.nonzero(d <= nearest[:, None] * reach)
    far = d[a, b]
    return a, b // len(steps), (nearest[a] / far) ** 2, far
