"""Classification metrics over prediction records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .audits import required
from .ordering import running


def predicted(rows: DataFrame, p: str = "y_prob") -> DataFrame:
    """y_pred: the first class with the largest probability."""
    return rows.withColumn("y_pred", (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def collapsed(rows: DataFrame, members: list[list[int]]) -> DataFrame:
    """Classes brought together: probabilities are summed, then the first largest is taken anew.

    A row whose class stands in no group fails the job.
    """
    flat = [c for m in members for c in m]
    if len(set(flat)) != len(flat):
        raise ValueError("a class stands in two groups")
    total = F.array(*[sum((F.col("y_prob")[c] for c in m[1:]), F.col("y_prob")[m[0]]) for m in members])
    of = F.coalesce(*[F.when(F.col("y_true").isin(m), k) for k, m in enumerate(members)])
    out = required(rows, of.isNotNull() | F.col("y_true").isNull(), F.concat(F.lit("no group holds class "), F.col("y_true")))
    out = out.withColumn("y_prob", total).withColumn("y_true", of)
    return predicted(out)


def confusion(rows: DataFrame, classes: int) -> DataFrame:
    """(y_true, y_pred, n, row_share, column_share) for every pair of classes, also those that don't occur."""
    spark = rows.sparkSession
    grid = spark.range(classes).select(F.col("id").cast("int").alias("y_true"), F.explode(F.sequence(F.lit(0), F.lit(classes - 1))).alias("y_pred"))
    n = rows.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    out = grid.join(n, ["y_true", "y_pred"], "left").na.fill(0, ["n"])
    share = lambda c: F.coalesce(F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy(c))), F.lit(0.0))
    return out.withColumn("row_share", share("y_true")).withColumn("column_share", share("y_pred"))


def by_class(matrix: DataFrame) -> DataFrame:
    """(class, support, precision, recall, f1) from a confusion matrix; 0 where a denominator is 0."""
    t = matrix.groupBy(F.col("y_true").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)).alias("tp"))
    p = matrix.groupBy(F.col("y_pred").alias("class")).agg(F.sum("n").alias("predicted"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = t.join(p, "class").withColumn("precision", div(F.col("tp"), F.col("predicted"))).withColumn("recall", div(F.col("tp"), F.col("support")))
    return out.withColumn("f1", div(2 * F.col("tp"), F.col("support") + F.col("predicted")))


def summary(classes: DataFrame) -> DataFrame:
    """accuracy, macro F1 (over labels that occur on either side), weighted F1, balanced accuracy, Cohen's kappa."""
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    n = F.sum("support")
    agree, chance = F.sum("tp") / n, F.sum(F.col("support") * F.col("predicted")) / (n * n)
    return classes.agg(
        n.alias("n"), agree.alias("accuracy"), F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.try_divide(agree - chance, 1 - chance).alias("kappa"),
    )


def auc(rows: DataFrame, keys: list[str], y: str = "y", p: str = "p", weight: Column | None = None) -> DataFrame:
    """(keys, auc) by the rank formula with ties shared; null where one class is absent.

    Rows of equal score are summed before any order is made, so only distinct scores are sorted; without keys by ranges.
    """
    w = weight if weight is not None else F.lit(1.0)
    by = rows.groupBy(*keys, F.col(p).alias("score")).agg(F.sum(F.when(F.col(y) == 1, w).otherwise(0.0)).alias("pos"), F.sum(F.when(F.col(y) == 1, 0.0).otherwise(w)).alias("neg"))
    if keys:
        order = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
        by = by.withColumn("below", F.coalesce(F.sum("neg").over(order), F.lit(0.0)))
    else:
        by = running(by, ["score"], {"below": F.col("neg")})
    g = by.groupBy(*keys) if keys else by.groupBy()
    return g.agg(F.try_divide(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def average_precision(rows: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """(keys, ap, base_rate, lift): precision summed over the steps of recall, by falling distinct score."""
    by = rows.groupBy(*keys, F.col(p).alias("score")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("tp", F.sum("pos").over(order)).withColumn("seen", F.sum("n").over(order))
    out = by.groupBy(*keys).agg(F.try_divide(F.sum(F.col("pos") * F.col("tp") / F.col("seen")), F.sum("pos")).alias("ap"), (F.sum("pos") / F.sum("n")).alias("base_rate"))
    return out.withColumn("lift", F.try_divide(F.col("ap"), F.col("base_rate")))


def reliability(rows: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """(bin, n, mean_p, mean_y, gap) over equal bins; a score on an edge belongs to the bin above, 1 to the last."""
    edges = [k * (1.0 / bins) for k in range(1, bins)]
    at = sum((F.when(F.col(p) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    out = rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))
    return out.withColumn("gap", F.abs(F.col("mean_p") - F.col("mean_y")))


def auc_without_group(rows: DataFrame, group: str, y: str = "y", p: str = "p") -> DataFrame:
    """(held, auc) over the rows of all other groups, for every group; null where one class is absent there.

    Pairs of the others are all pairs less those with a positive of the group, less those with a negative of it, plus
    those within it, which the first two have both. So each row is counted once, and not once for each group.
    """
    own = rows.groupBy(F.col(group).alias("held"), F.col(p).alias("score")).agg(F.sum((F.col(y) == 1).cast("double")).alias("pos"), F.sum((F.col(y) != 1).cast("double")).alias("neg"))
    each = own.groupBy("score").agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    up = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)  # distinct scores
    each = each.withColumn("neg_below", F.coalesce(F.sum("all_neg").over(up), F.lit(0.0))).withColumn("pos_below", F.coalesce(F.sum("all_pos").over(up), F.lit(0.0)))
    total = each.agg(F.sum("all_pos").alias("n_pos"), F.sum("all_neg").alias("n_neg"), F.sum(F.col("all_pos") * (F.col("neg_below") + F.col("all_neg") / 2)).alias("pairs"))
    inside = Window.partitionBy("held").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("own_below", F.coalesce(F.sum("neg").over(inside), F.lit(0.0))).join(each, "score").crossJoin(F.broadcast(total))
    above = F.col("n_pos") - F.col("pos_below") - F.col("all_pos")
    out = own.groupBy("held", "n_pos", "n_neg", "pairs").agg(
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("all_neg") / 2)).alias("by_pos"), F.sum(F.col("neg") * (above + F.col("all_pos") / 2)).alias("by_neg"),
        F.sum(F.col("pos") * (F.col("own_below") + F.col("neg") / 2)).alias("within"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
    )
    rest = (F.col("n_pos") - F.col("pos")) * (F.col("n_neg") - F.col("neg"))
    return out.select("held", F.try_divide(F.col("pairs") - F.col("by_pos") - F.col("by_neg") + F.col("within"), rest).alias("auc"))


def record_metrics(rows: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """One row for a binary prediction record: n, positives, accuracy, the larger class's share, precision, recall, kappa."""
    yes, true = F.col(p) >= threshold, F.col(y) == 1
    n = F.count(F.lit(1))
    tp, fp, fn = F.count_if(yes & true), F.count_if(yes & ~true), F.count_if(~yes & true)
    agree = F.avg((yes == true).cast("double"))
    chance = ((tp + fp) * (tp + fn) + (n - tp - fp) * (n - tp - fn)) / (n * n)
    return rows.agg(
        n.alias("n"), F.count_if(true).alias("positives"), agree.alias("accuracy"), (F.greatest(F.count_if(true), F.count_if(~true)) / n).alias("baseline"),
        F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(agree - chance, 1 - chance).alias("kappa"),
    )


def benjamini_hochberg(tests: DataFrame, p: str = "p", key: str = "name", family: str | None = None) -> DataFrame:
    """q-values: the running minimum, from the largest p down, of p times the number of tests over its rank; in each family."""
    own = Window.partitionBy(*([family] if family else []))
    up = own.orderBy(F.col(p), F.col(key))
    down = own.orderBy(F.desc(p), F.desc(key)).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(F.lit(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = tests.withColumn("rank", F.row_number().over(up)).withColumn("raw", F.col(p) * n / F.col("rank"))
    return out.withColumn("q", F.least(F.lit(1.0), F.min("raw").over(down))).drop("raw")


def two_families(tests: DataFrame, construct: str, alpha: float = 0.05, p: str = "p", key: str = "name", low: str = "low", chance: float = 0.5) -> DataFrame:
    """(family, the columns of ``tests``, rank, q, survives, survives_both): all tests, and the best of each construct.

    ``low`` is the lower end of a test's interval: the criterion is that q is below ``alpha`` and the interval above chance.
    """
    best = Window.partitionBy(construct).orderBy(p, key)
    narrow = tests.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")
    both = tests.withColumn("family", F.lit("all")).unionByName(narrow.withColumn("family", F.lit("constructs")))
    out = benjamini_hochberg(both, p, key, "family").withColumn("survives", F.col("q") < alpha)
    return out.withColumn("survives_both", F.col("survives") & (F.col(low) > chance))


def record_block(rows: DataFrame, reps: int, permutations: int, seed: str, y: str = "y", p: str = "p", group: str = "grp", split: bool = False) -> DataFrame:
    """One row for a binary prediction record: the counts, rates and kappa of ``record_metrics``, and groups, AUC with its interval
    over drawn groups, p of labels permuted within groups, average precision and its lift, and the scores' spread.

    ``rows`` has id, y, p and the group; rows without a score are left out. With ``split``, permutations are drawn by shares of
    blocks, for thousands of them; else by md5, as SQL repeats them, which makes a row for each row and permutation.
    """
    from . import resampling, split_draws

    rows = rows.filter(F.col(p).isNotNull()).select("id", F.col(group).alias("grp"), F.col(y).cast("int").alias("y"), F.col(p).alias("p"))
    drawn = resampling.interval(resampling.bootstrap_auc(rows, reps, f"{seed}-boot", ["p"]), "auc_p").withColumn("excludes_chance", F.col("low") > 0.5)
    permuted = (split_draws if split else resampling).permutation_p(rows, permutations, f"{seed}-perm").select("p_value")
    scores = rows.agg(F.countDistinct("grp").alias("groups"), F.min("p").alias("score_min"), F.max("p").alias("score_max"), F.avg("p").alias("score_mean"), (F.max("p") - F.min("p")).alias("score_spread"))
    out = record_metrics(rows)
    for part in (auc(rows, []), drawn, permuted, average_precision(rows, []), scores):  # one row each
        out = out.crossJoin(F.broadcast(part))
    return out.withColumn("beats_baseline", F.col("accuracy") > F.col("baseline"))


def by_fold(rows: DataFrame, classes: int, positive: int, fold: str = "fold", y: str = "y_true", pred: str = "y_pred", p: str = "p") -> DataFrame:
    """(fold, n, accuracy, macro_f1, weighted_f1, kappa, recalls, missing, auc, f1) of every fold.

    ``recalls`` holds each class's recall, 0 where the fold has none of it; ``missing`` the classes that it lacks. ``auc``
    and ``f1`` are those of class ``positive`` against the others, by the score p and the threshold 0.5; null where the
    fold has one side alone. All folds are one aggregation.
    """
    spark = rows.sparkSession
    cells = rows.groupBy(fold, F.col(y).alias("t"), F.col(pred).alias("q")).agg(F.count(F.lit(1)).alias("c"))
    grid = rows.select(fold).distinct().crossJoin(F.broadcast(spark.range(classes).select(F.col("id").cast("int").alias("class"))))  # folds times classes
    own = lambda k, name: cells.groupBy(fold, F.col(k).alias("class")).agg(F.sum("c").alias(name), F.sum(F.when(F.col("t") == F.col("q"), F.col("c")).otherwise(0)).alias(f"{name}_hit"))
    each = grid.join(own("t", "support"), [fold, "class"], "left").join(own("q", "predicted").drop("predicted_hit"), [fold, "class"], "left").na.fill(0)
    each = each.withColumnRenamed("support_hit", "tp").withColumn("recall", F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0)))
    n = F.sum("support")
    seen, agree, chance = (F.col("support") > 0) | (F.col("predicted") > 0), F.sum("tp") / n, F.sum(F.col("support") * F.col("predicted")) / (n * n)
    recalls = F.transform(F.array_sort(F.collect_list(F.struct("class", "recall"))), lambda x: x["recall"])
    out = each.groupBy(fold).agg(
        n.alias("n"), agree.alias("accuracy"), F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"), F.try_divide(agree - chance, 1 - chance).alias("kappa"),
        recalls.alias("recalls"), F.array_sort(F.collect_list(F.when(F.col("support") == 0, F.col("class")))).alias("missing"),
    )
    two = rows.select(fold, (F.col(y) == positive).cast("int").alias("y"), F.col(p).alias("p"))
    yes, true = F.col("p") >= 0.5, F.col("y") == 1
    f1 = two.groupBy(fold).agg(F.when((F.max("y") == 1) & (F.min("y") == 0), F.coalesce(F.try_divide(2 * F.count_if(yes & true), F.count_if(yes) + F.count_if(true)), F.lit(0.0))).alias("f1"))
    return out.join(auc(two, [fold]), fold).join(f1, fold)


def matrix_report(matrix: DataFrame, classes: int) -> DataFrame:
    """One row for a confusion matrix: errors, those between neighbouring classes, the worst pair, classes lost, the ceiling.

    ``worst_true`` and ``worst_pred`` are the commonest error, the first of equals; ``zero_recall`` the classes that occur
    and are never found, ``absent`` those that don't occur; the macro F1 over all classes can't exceed ``ceiling``.
    """
    wrong = F.col("y_true") != F.col("y_pred")
    worst = F.max_by(F.struct("y_true", "y_pred", "n"), F.when(wrong & (F.col("n") > 0), F.struct("n", -F.col("y_true"), -F.col("y_pred"))))
    errors = matrix.agg(F.sum(F.when(wrong, F.col("n")).otherwise(0)).alias("errors"), F.sum(F.when(F.abs(F.col("y_true") - F.col("y_pred")) == 1, F.col("n")).otherwise(0)).alias("adjacent"), worst.alias("w"))
    of = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("class"))))
    lost = by_class(matrix).agg(of((F.col("support") > 0) & (F.col("tp") == 0)).alias("zero_recall"), of(F.col("support") == 0).alias("absent"))
    out = errors.crossJoin(F.broadcast(lost))  # one row each
    return out.select("errors", "adjacent", F.col("w.y_true").alias("worst_true"), F.col("w.y_pred").alias("worst_pred"), F.col("w.n").alias("worst_n"), "zero_recall", "absent", ((F.lit(classes) - F.size("absent")) / F.lit(float(classes))).alias("ceiling"))


def without_groups(rows: DataFrame, group: str, y: str = "y", p: str = "p") -> DataFrame:
    """(low, high, largest, auc_without_largest): the range of AUC with each group left out, and without the largest group."""
    left = auc_without_group(rows, group, y, p)
    sizes = rows.groupBy(F.col(group).alias("held")).agg(F.count(F.lit(1)).alias("n"))
    both = left.join(sizes, "held")
    return both.agg(F.min("auc").alias("low"), F.max("auc").alias("high"), F.min_by("held", F.struct(-F.col("n"), "held")).alias("largest"), F.min_by("auc", F.struct(-F.col("n"), "held")).alias("auc_without_largest"))
