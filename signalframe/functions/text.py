"""Scoring of replies and small scalar functions, as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content.
STOP = [
    "the", "a", "an", "and", "or", "but", "if", "then", "of", "to", "in", "is", "are", "was",
    "it", "this", "that", "you", "your", "for", "on", "as", "with", "be", "can", "not", "at",
    "by", "from", "so", "we", "they", "have", "has", "will", "would", "when", "what", "which",
]
URGENCIES = ("low", "medium", "high")


def terms(text: Column) -> Column:
    """Distinct lower-case terms of four characters or more, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOP]))


def grounding(reply: Column, source: Column) -> Column:
    """The share of a reply's terms that its source holds; 0 where it has none."""
    mine = terms(reply)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(mine, terms(source))), F.size(mine)), F.lit(0.0))


def words(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def has_markdown(text: Column) -> Column:
    return text.contains("**") | text.contains("__") | text.contains("`")


def valid_strategy(json: Column, actions: list[str]) -> Column:
    """True for JSON with a known action_type and an urgency of low, medium or high; else false."""
    v = F.try_parse_json(json)
    action, urgency = F.try_variant_get(v, "$.action_type", "string"), F.try_variant_get(v, "$.urgency", "string")
    return F.coalesce(action.isin(actions) & urgency.isin(*URGENCIES), F.lit(False))


def field_or(json: Column, name: str, default: str = "invalid") -> Column:
    return F.coalesce(F.try_variant_get(F.try_parse_json(json), f"$.{name}", "string"), F.lit(default))


def fenced(text: Column, name: str) -> Column:
    """The body of a fenced block of the given name, over several lines."""
    return F.regexp_extract(text, rf"(?s)```{name}\s*\n(.*?)```", 1)


def softmax(logits: Column) -> Column:
    """Shifted by the largest, so that nothing overflows."""
    e = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def two_stage(p_first: Column, p_second: Column) -> Column:
    """Probabilities of (0, classes of the second stage) from P(not 0) and the second stage's shares; an unknown second
    stage splits evenly; renormalised."""
    n = F.size(p_second)
    total = F.aggregate(p_second, F.lit(0.0), lambda a, x: a + x)
    share = F.when(total > 0, F.transform(p_second, lambda x: x / total)).otherwise(F.transform(p_second, lambda x: 1.0 / n))
    return F.concat(F.array(1 - p_first), F.transform(share, lambda x: x * p_first))


def corn_rank(logits: Column) -> Column:
    """The number of leading thresholds whose product of sigmoids stays above one half."""
    zero = F.struct(F.lit(1.0).alias("p"), F.lit(0).alias("n"))

    def step(a, x):
        p = a["p"] / (1 + F.exp(-x))
        return F.struct(p.alias("p"), (a["n"] + F.when(p > 0.5, 1).otherwise(0)).alias("n"))

    return F.aggregate(logits, zero, step)["n"]


def magnitude(d: Column) -> Column:
    a = F.abs(d)
    return F.when(a < 0.2, "negligible").when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def half_width(n: Column) -> Column:
    """The worst case of a proportion's 95 % half-width; infinite without cases."""
    return F.when(n > 0, 1.96 * F.sqrt(0.25 / n)).otherwise(F.lit(float("inf")))


def any_prefix(text: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(p) for p in prefixes])
