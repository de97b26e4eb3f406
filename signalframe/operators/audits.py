"""Audits that fail loudly: completeness, alignment, disjointness, leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def required(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """The rows as they are; the job fails at a row for which the condition is false or null.

    The check is a filter, which stays whatever columns are asked for later, and where rows are only counted.
    """
    said = message if isinstance(message, Column) else F.lit(message)
    return df.filter(F.when(condition, F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def _said(text: str, key: str) -> Column:
    return F.concat(F.lit(text), F.coalesce(F.col(key).cast("string"), F.lit("null")))


def aligned(left: DataFrame, right: DataFrame, key: str, *, same: list[str] = ()) -> DataFrame:
    """One-to-one: every key on both sides once, and the columns ``same`` equal; else the job fails and says where."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in left.columns if c != key])
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("_m"), *[F.first(c).alias(f"r_{c}") for c in right.columns if c != key])
    j = a.join(b, key, "full")
    ok: Column = (F.coalesce("_n", F.lit(0)) == 1) & (F.coalesce("_m", F.lit(0)) == 1)
    for c in same:
        ok = ok & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    return required(j, ok, _said(f"{key} isn't aligned: ", key)).drop("_n", "_m")


def complete(left: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """A left join in which every key must be found; else the job fails with the first key that isn't."""
    found = lookup.withColumn("_found", F.lit(True))
    return required(left.join(found, key, "left"), F.col("_found"), _said(f"no match for {key} ", key)).drop("_found")


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """Refuses a table without rows: looks for one row at once, which runs a small job."""
    if not df.take(1):
        raise ValueError(f"{what} has no rows")
    return df


def disjoint(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, parts) of the keys that stand in more than one part: no rows if they are disjoint."""
    every = None
    for name, df in parts.items():
        own = df.select(key).distinct().withColumn("part", F.lit(name))
        every = own if every is None else every.unionByName(own)
    return every.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("part")), ",").alias("parts"), F.countDistinct("part").alias("n")).filter("n > 1").drop("n")


def without_identifiers(df: DataFrame, forbidden: list[str]) -> DataFrame:
    """Refuses column names and values that hold a forbidden name."""
    for c in df.columns:
        if any(f.lower() in c.lower() for f in forbidden):
            raise ValueError(f"column {c} names an identifier")
    hit = df.filter(" or ".join(["false"] + [f"lower(to_json(struct(*))) like '%{f.lower()}%'" for f in forbidden]))
    if hit.take(1):
        raise ValueError("a value names an identifier")
    return df


def quality(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(grp, n, labels, degenerate): groups with fewer than two labels are degenerate."""
    g = rows.groupBy(F.col(group).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("labels"))
    return g.withColumn("degenerate", F.col("labels") < 2)


def verdict(minority: Column) -> Column:
    """Whether a class is large enough to train on: bands by the count of the rarer class."""
    return F.when(minority < 10, "unusable").when(minority < 50, "very weak").when(minority < 200, "weak").otherwise("usable")


def of_schema(windows: DataFrame, features: str, width: int, version: str | None = None, expected: object = None) -> DataFrame:
    """The windows as they are; the job fails at one whose rows of features aren't ``width`` wide, or of another schema version."""
    same = F.col(features).isNotNull() & F.forall(features, lambda r: F.coalesce(F.size(r), F.lit(-1)) == width)
    out = required(windows, same, F.concat(F.lit(f"features of another width than {width}: "), F.coalesce(F.size(F.get(features, F.lit(0))), F.lit(-1))))
    return out if version is None else required(out, F.col(version).eqNullSafe(F.lit(expected)), F.concat(F.lit(f"{version} isn't {expected}: "), F.coalesce(F.col(version).cast("string"), F.lit("null"))))


def codebook_checks(book: DataFrame, used: DataFrame, title: str = "title", marker: str = "marker") -> DataFrame:
    """(problem, name, n) of a codebook against the titles in use, which must be told apart.

    duplicate_title and duplicate_marker stand more than once in the book, with how often; missing titles are used and not
    in the book, with their uses; orphans are in the book and not used.
    """
    own, uses = book.groupBy(F.col(title).alias("name")).agg(F.count(F.lit(1)).alias("n")), used.groupBy(F.col(title).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    marks = book.filter(F.col(marker).isNotNull()).groupBy(F.col(marker).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    found = [("duplicate_title", own.filter("n > 1")), ("duplicate_marker", marks.filter("n > 1")), ("missing", uses.join(own.select("name"), "name", "left_anti")), ("orphan", own.join(uses.select("name"), "name", "left_anti"))]
    out = None
    for problem, rows in found:
        one = rows.select(F.lit(problem).alias("problem"), F.col("name").cast("string").alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
