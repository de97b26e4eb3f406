"""Bounded samples of labelled documents to learn from, and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bernoulli_key


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows that no model learns from: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: dict[int, int], most_chars: int) -> dict[int, list[str]]:
    """Texts to learn from, by label: of each class at most ``per_class`` rows, in a seeded order, to the driver.

    Only labelled rows that aren't held out count, and of these the ones with text of 1 to ``most_chars`` characters; so
    the sample has at most sum(per_class) * most_chars characters, however many documents there are. A doc_id with
    several labels that disagree is left out.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("top")).filter("y = top")
    sized = docs.select("doc_id", F.length("text").alias("n")).filter(F.col("n").between(1, most_chars)).groupBy("doc_id").agg(F.max("n").alias("n"))
    known = sized.join(marks, "doc_id").withColumn("key", bernoulli_key(f"sample-{label}", F.col("doc_id").cast("string")))
    chosen = None
    for y, n in per_class.items():
        own = known.filter(F.col("y") == y).orderBy("key", "doc_id").limit(n).select("doc_id", "y", "key")
        chosen = own if chosen is None else chosen.unionByName(own)
    ids = [tuple(r) for r in chosen.collect()]  # bounded by per_class
    if not ids:
        return {y: [] for y in per_class}
    few = docs.sparkSession.createDataFrame(ids, "doc_id long, y int, key string")
    rows = docs.select("doc_id", "text").filter(F.length("text").between(1, most_chars)).join(F.broadcast(few), "doc_id").collect()
    rows = sorted({(r.key, r.doc_id, r.y, r.text) for r in rows})
    return {y: [r[3] for r in rows if r[2] == y] for y in per_class}
