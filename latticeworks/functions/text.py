"""Labels, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words by which a name is tagged with a structural family.
FAMILIES = {
    "perovskite": ["perovskite", "elpasolite", "brownmillerite"],
    "spinel": ["spinel"],
    "garnet": ["garnet", "yag"],
    "mof": ["mof", "metal-organic", "metal organic"],
    "zeolite": ["zeolite", "chabazite", "faujasite", "natrolite", "clinoptilolite", "mordenite", "analcime", "sodalite", "heulandite", "stilbite"],
    "pyroxene": ["pyroxene", "diopside", "enstatite", "jadeite", "augite", "hedenbergite", "aegirine"],
    "amphibole": ["amphibole", "richterite", "hornblende", "tremolite", "actinolite", "glaucophane", "arfvedsonite", "riebeckite"],
    "heusler": ["heusler"],
}
#: Texts that stand for no label, and tags in the order in which they are believed.
NO_LABEL = ["none", "null", "unknown", "n/a", "na", "?"]
TAG_ORDER = ["mineral", "strukturbericht", "aflow"]


def family_tags(name: Column) -> Column:
    """The families one of whose words stands in a name, in fixed order."""
    low = F.lower(name)
    tags = [F.when(low.rlike("|".join(rf"\b{w}\b" for w in words)), F.lit(family)) for family, words in FAMILIES.items()]
    return F.filter(F.array(*tags), lambda t: t.isNotNull())


def clean_label(label: Column) -> Column:
    """Null for blanks, for words that mean nothing, and for marks alone."""
    text = F.trim(label)
    return F.when((text == "") | F.lower(text).isin(*NO_LABEL) | text.rlike(r"^[\s;:.,_\-+/\\]+$"), None).otherwise(text)


def preferred_tag(tags: Column) -> Column:
    """The first usable tag of a MAP<STRING, STRING>, those of ``TAG_ORDER`` before any other in key order."""
    others = F.transform(F.array_sort(F.map_keys(F.map_filter(tags, lambda k, v: ~k.isin(*TAG_ORDER) & clean_label(v).isNotNull()))), lambda k: clean_label(F.element_at(tags, k)))
    return F.coalesce(*[clean_label(F.element_at(tags, F.lit(k))) for k in TAG_ORDER], F.when(F.size(others) > 0, others[0]))


def path_family(path: Column) -> Column:
    """The second part of a path, null if there is none before the file's name."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 2, parts[1])


def path_stem(path: Column) -> Column:
    """The file's name without its suffix, other characters than letters, digits, _ and - made _."""
    return F.regexp_replace(F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", ""), r"[^A-Za-z0-9_\-]+", "_")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def padded_key(number: Column, prefix: str = "icsd_", width: int = 6) -> Column:
    return F.concat(F.lit(prefix), F.when(F.length(number.cast("string")) < width, F.lpad(number.cast("string"), width, "0")).otherwise(number.cast("string")))


def shorten(text: Column, n: int) -> Column:
    """At most n characters, the last of a longer text an ellipsis."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def fold_text(pre: Column, post: Column) -> Column:
    """How often ``post`` holds ``pre``: ``n/a`` of nothing and nothing, ``inf`` of something after nothing, else ``2.5x``."""
    return F.when((pre == 0) & (post == 0), "n/a").when(pre == 0, "inf").otherwise(F.format_string("%.1fx", post / F.nullif(pre.cast("double"), F.lit(0.0))))
