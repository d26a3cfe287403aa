"""Column expressions shared by the operators. Everything here stays inside codegen."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from molq.functions.tokens import CONTROL_PREFIXES, UNASSIGNED, tokens


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_unassigned(c, preset="core") -> Column:
    """True when the id is NULL or one of the preset's tokens."""
    text = col(c).cast("string")
    return text.isNull() | text.isin(*tokens(preset))


def normalize_unassigned(c, preset="core", extra: Sequence[str] = ()) -> Column:
    text = col(c).cast("string")
    known = tuple(tokens(preset)) + tuple(extra)
    return F.when(text.isNull() | text.isin(*known), F.lit(UNASSIGNED)).otherwise(text)


def finite(c) -> Column:
    """Undefined numbers (NaN, +-inf) become NULL."""
    value = col(c).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def safe_div(num, den) -> Column:
    """num / den, NULL when the denominator is NULL or zero."""
    d = col(den).cast("double")
    return F.when(d != 0, col(num).cast("double") / d)


def truthy(c) -> Column:
    """bool / 1 / 1.0 / 'True' all mean true; anything else, including NULL, means false."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(text.isin("true") | (text.try_cast("double") == 1.0), F.lit(False))


def is_control(c, prefixes: Sequence[str] = CONTROL_PREFIXES) -> Column:
    pattern = "^(" + "|".join(prefixes) + ")"
    return F.lower(col(c).cast("string")).rlike(pattern)


def within(c, low, high, bounds: str = "closed") -> Column:
    """Size band test: ``closed`` keeps the end points, ``open`` drops them."""
    c = col(c)
    if bounds == "closed":
        return (c >= low) & (c <= high)
    if bounds == "open":
        return (c > low) & (c < high)
    raise ValueError(f"bounds must be 'closed' or 'open', got {bounds!r}")


def box_closed(x, y, x_min=None, x_max=None, y_min=None, y_max=None) -> Column:
    x, y = col(x), col(y)
    terms = [t for t in (
        None if x_min is None else x >= float(x_min),
        None if x_max is None else x <= float(x_max),
        None if y_min is None else y >= float(y_min),
        None if y_max is None else y <= float(y_max)) if t is not None]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


# --- labels ---------------------------------------------------------------

# Ordered keyword rules from fine labels to coarse ones.
COARSE_RULES = (
    ("Mast", ("mast",)),
    ("Myeloid", ("dendritic", "monocyte", "macrophage", "granulocyte", "neutrophil",
                 "myeloid", "kupffer")),
    ("Plasma", ("plasma cell", "plasmablast")),
    ("B", ("b cell", "b-cell")),
    ("T", ("t cell", "t-cell", "t-regulatory", "cd4", "cd8", "cytotoxic",
           "natural killer", "nk cell", "lymphocyte")),
    ("Ciliated", ("ciliated",)),
    ("Endothelial", ("endotheli",)),
    ("Fibroblasts", ("fibroblast", "smooth muscle", "pericyte", "stromal", "myofibro",
                     "mesenchym")),
    ("Cancer", ("epitheli", "malignant", "cancer", "tumor", "tumour", "alveolar",
                "club", "secretory", "basal")),
)


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(k) for k in keywords], F.lit(False))


def map_label(label, vocabulary: Sequence[str],
              rules: Sequence[tuple[str, Sequence[str]]] = COARSE_RULES) -> Column:
    """A label already in the vocabulary stays; else the first keyword rule that hits, else NA."""
    raw = col(label).cast("string")
    low = F.lower(raw)
    out = F.when(raw.isin(*vocabulary), raw)
    for coarse, keywords in rules:
        if coarse in vocabulary:
            out = out.when(contains_any(low, keywords), F.lit(coarse))
    return out.otherwise(F.lit("NA"))


def first_match(label, rules: Sequence[tuple[str, Sequence[str]]], default: str | None) -> Column:
    """First category one of whose keywords occurs in the label, ignoring case."""
    low = F.lower(col(label).cast("string"))
    out = None
    for name, keywords in rules:
        hit = contains_any(low, [k.lower() for k in keywords])
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    if out is None:
        return F.lit(default)
    return out.otherwise(F.lit(default))


# The name patterns and units below, and the thresholds and labels of the p-value and
# abundance functions, are part of the result tables.
def metric_unit(name) -> Column:
    n = col(name)
    return (F.when(n.endswith("_s") | n.endswith("seconds"), "seconds")
            .when(n.endswith("_gb"), "GiB")
            .when(n.startswith("n_"), "count")
            .when(n.endswith("percent"), "percent")
            .when(n.contains("frac"), "fraction")
            .otherwise("unitless"))


def p_stars(p) -> Column:
    p = finite(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns"))


def p_label(p) -> Column:
    p = finite(p)
    return (F.when(p.isNull(), "n/a").when(p < 0.001, "p<0.001")
            .otherwise(F.format_string("p=%.3f", F.bround(p, 3))))


def abundance_class(n, rare_below: int = 20, common_from: int = 50) -> Column:
    n = col(n)
    return (F.when(n.isNull() | (n <= 0), "missing").when(n < rare_below, "rare")
            .when(n < common_from, "low_abundance").otherwise("common"))


# --- numbers --------------------------------------------------------------

def sum_if(cond: Column, value) -> Column:
    return F.sum(F.when(cond, col(value)).otherwise(F.lit(0)))


def normal_upper_tail(z) -> Column:
    """P(Z > z). Spark SQL has no erf, so this evaluates erfc by a rational
    Chebyshev fit whose relative error stays below 1.2e-7 over the whole line."""
    z = col(z).cast("double")
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    # Published coefficients of the fit, constant term first.
    coefficients = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
                    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = reduce(lambda acc, c: F.lit(c) + t * acc, reversed(coefficients[:-1]),
                  F.lit(coefficients[-1]))
    upper = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def hashed_uniform(seed: int, *cols) -> Column:
    """A reproducible number in [0, 1) from the row's own key, the same after any retry."""
    h = F.xxhash64(F.lit(seed), *[col(c) for c in cols])
    return F.pmod(h, F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def category_lookup(mapping: Mapping[str, Sequence[str]]) -> list[tuple[str, Sequence[str]]]:
    return [(k, tuple(v)) for k, v in mapping.items()]
