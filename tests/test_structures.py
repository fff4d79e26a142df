import json

import numpy as np
import pytest

from latticeworks.functions import elements, structures
from latticeworks.operators import embedding

SALT = """data_x
_cell_length_a 5.64(1)
_cell_length_b 5.64
_cell_length_c 5.64
_cell_angle_alpha 90
_cell_angle_beta 90
_cell_angle_gamma 90
loop_
_symmetry_equiv_pos_as_xyz
'x,y,z'
'x+1/2,y+1/2,z'
'x+1/2, y, z+1/2'
'x,y+1/2,z+1/2'
loop_
_atom_site_label
_atom_site_fract_x
_atom_site_fract_y
_atom_site_fract_z
Na1 0 0 0
Cl1 0.5 0.5 0.5
"""


@pytest.mark.parametrize(("symbol", "want"), [("H", (1, 1, 0)), ("He", (1, 18, 0)), ("Al", (3, 13, 1)), ("Fe", (4, 8, 2)), ("Zn", (4, 12, 2)), ("Gd", (6, 3, 3)), ("Hf", (6, 4, 2)), ("Pb", (6, 14, 1)), ("U", (7, 3, 3))])
def test_places_in_the_periodic_table(symbol, want):
    assert elements.place(elements.NUMBER[symbol]) == want


def test_cif_with_symmetry():
    s = structures.parse(SALT)
    assert sorted(next(iter(x)) for x in s.species) == ["Cl"] * 4 + ["Na"] * 4
    assert s.volume == pytest.approx(5.64**3)
    x, (a, _, w), extra = embedding.describe(s)
    assert np.bincount(a).tolist() == [6] * 8
    assert w == pytest.approx(np.ones(48))
    assert x[0, :7] == pytest.approx([11, 3, 1, 1.8, 0, 0.93, 0])
    assert x[0, 7:15] == pytest.approx([6, 2.82, 0, 6, 1, 2.82, 2.82, 1])
    assert extra[7] == pytest.approx(2.16, abs=0.01)  # the density of salt


def test_json_layouts():
    a = structures.parse(json.dumps({"lattice_mat": [[2, 0, 0], [0, 3, 0], [0, 0, 4]], "elements": ["Na", "Cl"], "coords": [[0, 0, 0], [1, 1.5, 2]], "cartesian": True}))
    assert a.places.tolist() == [[0, 0, 0], [0.5, 0.5, 0.5]]
    b = structures.parse(json.dumps({"lattice": {"matrix": [[2, 0, 0], [0, 3, 0], [0, 0, 4]]}, "sites": [{"species": [{"element": "Fe3+", "occu": 0.5}], "abc": [0, 0, 0]}]}))
    assert b.species == [{"Fe": 0.5}]
    c = structures.parse(json.dumps({"lattice": {"a": 2, "b": 3, "c": 4, "alpha": 90, "beta": 90, "gamma": 120}, "species": [["Na", 2]]}))
    assert (len(c.species), c.places) == (2, None)
    assert c.cell == pytest.approx((2, 3, 4, 90, 90, 120))


def test_features_and_failures(spark):
    rows = [("a", SALT), ("b", None), ("c", ""), ("d", "{}"), ("e", "data_y\n"), ("f", json.dumps({"lattice_mat": [[2, 0, 0], [0, 3, 0], [0, 0, 4]], "elements": ["Na"]})), ("g", SALT), ("h", json.dumps({"lattice_mat": [[1, 0, 0]] * 3, "elements": ["Na"]}))]
    df = spark.createDataFrame([(k, t, "v") for k, t in rows], "k string, t string, v string")
    got = {r["k"]: r for r in embedding.featurize(df, "k", "t").collect()}
    assert {k for k, r in got.items() if r["ok"]} == {"a", "g"}
    assert len(got["a"]["v"]) == 66
    assert got["a"]["v"] == got["g"]["v"]
    assert all(got[k]["error"] for k in "bcdefh")
    assert [r["ok"] for r in embedding.featurize(df.where("k = 'f'"), "k", "t", "chem_only").collect()] == [True]
    assert embedding.featurize(df.where("false"), "k", "t").count() == 0
    with pytest.raises(ValueError, match="mode"):
        embedding.featurize(df, "k", "t", "other")
