"""How good are predicted ratings: error, classification and ranking measures.

Each measure takes all score columns at once and makes one pass over the predictions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mirepoix.functions import steady
from mirepoix.sources import stage


def _to_rows(wide: DataFrame, scores: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per score from the one-row table whose columns are ``<measure>__<i>``."""
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("score"), *[F.col(f"{m}__{i}").alias(m) for m in measures])
            for i, s in enumerate(scores)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def _fold(df: DataFrame, scores: Sequence[str], *families: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per score with the aggregates of all families, from a single pass over ``df``."""
    folds = {name: fold for family in families for name, fold in family.items()}
    each = [fold(F.col(s)).alias(f"{name}__{i}") for i, s in enumerate(scores) for name, fold in folds.items()]
    return _to_rows(df.agg(*each), scores, list(folds))


def _errors(label: str) -> dict[str, Callable[[Column], Column]]:
    def gap(score: Column) -> Column:
        return F.col(label).cast("double") - score.cast("double")

    return {
        "mse": lambda s: F.avg(gap(s) * gap(s)),
        "mae": lambda s: F.avg(F.abs(gap(s))),
        "rmse": lambda s: F.sqrt(F.avg(gap(s) * gap(s))),
    }


def regression_metrics(df: DataFrame, label: str, scores: Sequence[str]) -> DataFrame:
    """MSE, MAE and RMSE per score, over rows where both values are known."""
    return _fold(df, scores, _errors(label))


def _confusion(label: str, label_cut: float, score_cut: float) -> dict[str, Callable[[Column], Column]]:
    relevant = F.coalesce(F.col(label) >= label_cut, F.lit(False))
    irrelevant = F.coalesce(F.col(label) < label_cut, F.lit(False))

    def positive(score: Column) -> Column:
        return F.coalesce(score >= score_cut, F.lit(False))

    return {
        "tp": lambda s: F.count_if(positive(s) & relevant),
        "tn": lambda s: F.count_if(~positive(s) & irrelevant),
        "fp": lambda s: F.count_if(positive(s) & ~relevant),
        "fn": lambda s: F.count_if(~positive(s) & ~irrelevant),
    }


def _rates() -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    tpr, fpr = _share(tp, tp + fn), _share(fp, fp + tn)
    return {
        "accuracy": _share(tp + tn, tp + tn + fp + fn),
        "ppv": _share(tp, tp + fp),
        "npv": _share(tn, tn + fn),
        "tpr": tpr,
        "tnr": _share(tn, tn + fp),
        "fpr": fpr,
        "fnr": _share(fn, fn + tp),
        "likelihood_ratio": F.try_divide(tpr, fpr),
    }


def confusion_metrics(
    df: DataFrame, label: str, scores: Sequence[str], label_cut: float, score_cut: float
) -> DataFrame:
    """Confusion counts and the rates made of them, per score.

    A null score counts as negative. A null label is a false positive or false negative: it never
    agrees. Rates with denominator 0 are null; so is ``likelihood_ratio`` (TPR / FPR) when FPR is 0.
    """
    return _fold(df, scores, _confusion(label, label_cut, score_cut)).withColumns(_rates())


def _cuts(label: str, label_cut: float, score_cut: float) -> dict[str, Callable[[Column], Column]]:
    """Counts over the rows in which both values are known."""
    known, relevant = F.col(label).isNotNull(), F.col(label) >= label_cut
    return {
        "known_tp": lambda s: F.count_if(s.isNotNull() & known & (s >= score_cut) & relevant),
        "known_fp": lambda s: F.count_if(s.isNotNull() & known & (s >= score_cut) & ~relevant),
        "known_fn": lambda s: F.count_if(s.isNotNull() & known & ~(s >= score_cut) & relevant),
        "known_tn": lambda s: F.count_if(s.isNotNull() & known & ~(s >= score_cut) & ~relevant),
    }


def _areas() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(f"known_{c}").cast("double") for c in ("tp", "fp", "fn", "tn"))
    relevant, irrelevant, positive, negative = tp + fn, fp + tn, tp + fp, fn + tn
    zero, one = F.lit(0.0), F.lit(1.0)

    base = _share(relevant, relevant + irrelevant)
    precision = F.coalesce(_share(tp, positive), zero)
    recall = F.coalesce(_share(tp, relevant), zero)
    fall_out = F.coalesce(_share(fp, irrelevant), zero)
    f_measure = F.coalesce(_share(2 * precision * recall, precision + recall), zero)

    pr_area = (
        F.when(relevant == 0, zero)
        .when(positive == 0, base)
        .otherwise(recall * precision + (one - recall) * (precision + base) / 2)
    )
    roc_area = (
        F.when(relevant == 0, zero).when(irrelevant == 0, one).otherwise((recall - fall_out + one) / 2)
    )
    at_one, at_zero = positive > 0, negative > 0
    return {
        "area_pr": pr_area,
        "area_roc": roc_area,
        "precision_1": F.when(at_one, precision),
        "recall_1": F.when(at_one, recall),
        "f1_1": F.when(at_one, f_measure),
        "precision_0": F.when(at_zero, base),
        "recall_0": F.when(at_zero, F.when(relevant == 0, zero).otherwise(one)),
        "f1_0": F.when(at_zero, F.coalesce(_share(2 * base, base + 1), zero)),
    }


def _is_known() -> Column:
    return F.col("known_tp") + F.col("known_fp") + F.col("known_fn") + F.col("known_tn") > 0


def binary_metrics(
    df: DataFrame, label: str, scores: Sequence[str], score_cut: float, label_cut: float
) -> DataFrame:
    """Areas under the PR and ROC curves, and precision, recall and F1 at both cut scores.

    Scores and labels are cut to 0 or 1, so a curve has at most two points and its area a closed form.
    ``*_1`` are the measures at threshold 1 (predicted positive), ``*_0`` at threshold 0 (everything);
    they are null when no score falls on that side. Rows with a null are left out.
    """
    counts = _fold(df, scores, _cuts(label, label_cut, score_cut)).filter(_is_known())
    return counts.select("score", *[c.alias(name) for name, c in _areas().items()])


def unpivot_scores(df: DataFrame, keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """(keys, score, value): one row per score column."""
    return df.unpivot(list(keys), [F.col(s).cast("double").alias(s) for s in scores], "score", "value")


#: Spark limits a window per map task up to this rank (``spark.sql.optimizer.windowGroupLimitThreshold``).
LIMITED_RANK = 1000
#: Parts a group is ranked in beyond that rank.
RANK_SHARDS = 256


def top_k(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    item: str | Sequence[str],
    k: int,
    descending: bool = True,
    name: str = "rank",
    shards: int = RANK_SHARDS,
) -> DataFrame:
    """The first ``k`` rows of each group with their rank in ``name``, ties in ``value`` by ``item``.

    Null values come last in a descending ranking and first in an ascending one. Up to ``LIMITED_RANK`` each map task
    keeps its own first ``k`` rows of a group. Beyond it Spark would sort a whole group in one task, so the
    rows of a group are dealt to ``shards`` parts first, which are ranked apart; a second ranking merges at most
    ``shards * k`` rows. The first ``k`` rows are among them however rows are dealt, so a retried task changes nothing.
    """
    items = [item] if isinstance(item, str) else list(item)
    by = F.desc_nulls_last(value) if descending else F.asc_nulls_first(value)
    number = lambda keys: F.row_number().over(W.partitionBy(*keys).orderBy(by, *items))
    if k > LIMITED_RANK:
        dealt = df.withColumn("__shard", F.pmod(F.xxhash64(*items), F.lit(shards)))
        df = dealt.withColumn(name, number([*groups, "__shard"])).filter(F.col(name) <= k).drop("__shard", name)
    return df.withColumn(name, number(groups)).filter(F.col(name) <= k)


def precision_at_k(
    df: DataFrame,
    user: str,
    item: str,
    label: str,
    scores: Sequence[str],
    ks: Sequence[int],
    label_cut: float,
    ascending: bool = False,
) -> DataFrame:
    """Mean over users of the share of relevant items among the K best-scored ones, per score.

    The share is of K, also for users with fewer items. One ranking serves all K. ``ascending`` ranks
    the worst scores first.
    """
    long = unpivot_scores(df.select(user, item, label, *scores), [user, item, label], scores)
    best = top_k(long, ["score", user], "value", item, max(ks), not ascending, "__rn")
    relevant = F.coalesce(F.col(label) >= label_cut, F.lit(False))
    per_user = best.groupBy("score", user).agg(
        *[(F.count_if((F.col("__rn") <= k) & relevant) / k).alias(f"p_at_{k}") for k in ks]
    )
    return per_user.groupBy("score").agg(*[steady(F.avg(f"p_at_{k}")).alias(f"p_at_{k}") for k in ks])


def prefix_agreement(
    df: DataFrame, user: str, item: str, label: str, score: str, ks: Sequence[int]
) -> DataFrame:
    """Per user: length of the common prefix of the two rankings, at most K, over K."""
    k = max(ks)
    by_label = top_k(df.select(user, item, label), [user], label, item, k, name="position")
    by_score = top_k(df.select(user, item, score), [user], score, item, k, name="position")
    met = by_label.select(user, "position", F.col(item).alias("__a")).join(
        by_score.select(user, "position", F.col(item).alias("__b")), [user, "position"]
    )
    broken = F.min(F.when(F.col("__a") != F.col("__b"), F.col("position")))
    common = met.groupBy(user).agg(F.coalesce(broken - 1, F.max("position")).alias("__n"))
    return common.select(
        user, *[(F.least(F.col("__n"), F.lit(x)) / x).alias(f"agreement_at_{x}") for x in ks]
    )


def topk_overlap(
    df: DataFrame, user: str, item: str, label: str, score: str, ks: Sequence[int]
) -> DataFrame:
    """Mean over users of the number of items among the K best by both rankings, over K."""
    k = max(ks)
    by_label = top_k(df.select(user, item, label), [user], label, item, k, name="__r1")
    by_score = top_k(df.select(user, item, score), [user], score, item, k, name="__r2")
    both = by_label.select(user, item, "__r1").join(by_score.select(user, item, "__r2"), [user, item], "left")
    per_user = both.groupBy(user).agg(
        *[
            (F.count_if((F.col("__r1") <= x) & (F.col("__r2") <= x)) / x).alias(f"overlap_at_{x}")
            for x in ks
        ]
    )
    return per_user.agg(*[steady(F.avg(f"overlap_at_{x}")).alias(f"overlap_at_{x}") for x in ks])


def evaluation_report(
    df: DataFrame,
    user: str,
    item: str,
    label: str,
    scores: Sequence[str],
    cut: float = 3,
    ks: Sequence[int] = (5, 10, 30),
) -> DataFrame:
    """All measures of rounded ratings side by side, one row per score that is known with its label somewhere.

    Two passes over ``df``: one for all counts and errors, one for the ranking.
    """
    return _measures(df, user, item, label, scores, cut, ks).filter("__known").drop("__known")


def _measures(
    df: DataFrame, user: str, item: str, label: str, scores: Sequence[str], cut: float, ks: Sequence[int]
) -> DataFrame:
    families = _errors(label), _cuts(label, cut, cut), _confusion(label, cut, cut)
    areas = [c.alias(name) for name, c in _areas().items()]
    rates = [c.alias(name) for name, c in _rates().items()]
    wide = _fold(df, scores, *families).select(
        "score", *_errors(label), *areas, "tp", "tn", "fp", "fn", *rates, _is_known().alias("__known")
    )
    return wide.join(precision_at_k(df, user, item, label, scores, ks, cut), "score")


def report_families(
    df: DataFrame,
    user: str,
    item: str,
    label: str,
    scores: Sequence[str],
    cut: float = 3,
    ks: Sequence[int] = (5, 10, 30),
) -> dict[str, DataFrame]:
    """The report of ``evaluation_report`` cut into its families: errors, curves, ranking, confusion.

    All are columns of one staged table with one row per score, so ``df`` is read twice for all of them.
    """
    whole = stage(_measures(df, user, item, label, scores, cut, ks).coalesce(1), "report")
    return {
        "regression": whole.select("score", *_errors(label)),
        "binary": whole.filter("__known").select("score", *_areas()),
        "ranking": whole.select("score", *[f"p_at_{k}" for k in ks]),
        "confusion": whole.select("score", "tp", "tn", "fp", "fn", *_rates()),
    }


def show_likelihood_ratio(df: DataFrame, digits: int = 3) -> DataFrame:
    """For printing: the ratio as text, MAX where the false positive rate is 0."""
    number = F.col("likelihood_ratio")
    ratio = F.when(number.isNotNull(), F.format_string(f"%.{digits}f", number))
    return df.withColumn("likelihood_ratio", F.when(F.col("fpr") == 0, "MAX").otherwise(ratio))
