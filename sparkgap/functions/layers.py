"""Roles and sides of board layers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, and words within names, that tell an outer from an inner layer.
OUTER_NAMES = (
    "top", "bottom", "bot", "front", "back", "f.cu", "b.cu", "f_cu", "b_cu", "toplayer", "bottomlayer", "top_layer", "bottom_layer",
    "topcopper", "bottomcopper", "component", "componentlayer", "solder", "solderlayer", "front.cu", "top.cu", "back.cu", "bottom.cu",
)
OUTER_WORDS = ("top", "bottom", "bot", "front", "back", "outer", "external")
INNER_WORDS = ("inner", "internal", "inlayer", "mid", "plane", "prep")
INTERNAL_ROLES = ("int", "inner", "internal", "inside")


def layer_role(name: Column, index: Column, total: Column) -> Column:
    """external or internal, from a layer's name, else from its place (from 0) among `total` layers."""
    lower = F.lower(F.trim(name))
    compact = F.regexp_replace(lower, "[^a-z0-9]+", "")
    outermost = (index == 0) | (index == F.greatest(total - 1, F.lit(0)))
    by_word = lambda words: compact.rlike("|".join(words))
    return (
        F.when(lower.isin(*OUTER_NAMES) | compact.isin(*OUTER_NAMES), "external")
        .when(lower.rlike(r"^(inner|internal|in)[_\-\s.]?\d+$") | compact.startswith("inner") | lower.startswith("internal"), "internal")
        .when(by_word(OUTER_WORDS), "external")
        .when(by_word(INNER_WORDS) & (~outermost | compact.startswith("in")), "internal")
        .when(compact.rlike(r"^(signal|sig|layer|l)\d+$") & (total > 1), F.when(outermost, "external").otherwise("internal"))
        .when(total <= 2, "external")
        .otherwise(F.when(outermost, "external").otherwise("internal"))
    )


def stack_place(name: Column) -> Column:
    """Orders layers by name where no stack-up is known: front, then inner ones by number, then back."""
    lower = F.lower(F.trim(name))
    side = F.when(lower.rlike(r"^(f[._]cu$|top|front|component)"), 0).when(lower.rlike(r"^(b[._]cu$|bot|back|solder)"), 2).otherwise(1)
    number = F.regexp_extract(lower, r"\d+", 0).try_cast("int")
    return F.struct(side.alias("side"), number.alias("number"), lower.alias("name"))


def normal_role(role: Column) -> Column:
    """internal, or external for everything else, null included."""
    return F.when(F.lower(F.trim(role)).isin(*INTERNAL_ROLES), "internal").otherwise("external")


def layer_key(layer: Column) -> Column:
    """The spelling under which layers are compared: trimmed, upper case."""
    return F.upper(F.trim(layer))
