"""Evaluation: masked accuracy, reductions over ranks and runs, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptloom.functions.masks import IGNORE, supervised, token_counts
from promptloom.operators.order import rank_within

DIGITS = 6


def _share(part: Column, whole: Column) -> Column:
    """A ratio, null when there is nothing to divide by."""
    return F.round(part / F.when(whole != 0, whole), DIGITS)


def _masked_sums(predicted: Column, label: Column, ignore: int, loss: str | None) -> list[Column]:
    valid = label != ignore
    sums = [
        F.sum(F.when(valid & (predicted == label), 1).otherwise(0)).alias("correct"),
        F.sum(F.when(valid, 1).otherwise(0)).alias("valid"),
    ]
    if loss is None:
        return sums
    # every row with a loss is a step
    return [*sums, F.coalesce(F.sum(loss), F.lit(0.0)).alias("loss_sum"), F.count(loss).alias("steps")]


def _scores(sums: DataFrame, loss: str | None) -> list[Column]:
    scores = [F.col("correct"), F.col("valid"), _share(F.col("correct"), F.col("valid")).alias("accuracy")]
    if loss is None:
        return scores
    mean = _share(F.col("loss_sum"), F.col("steps")).alias("mean_loss")
    return [*scores, F.round("loss_sum", DIGITS).alias("loss_sum"), F.col("steps"), mean]


def masked_accuracy(
    df: DataFrame, predicted: str, label: str, by: list[str], ignore: int = IGNORE,
    loss: str | None = None,
) -> DataFrame:
    """Correct and valid labels, one label per row, and their ratio; with ``loss`` also its sum, the
    steps that have one, and its mean."""
    sums = df.groupBy(*by).agg(*_masked_sums(F.col(predicted), F.col(label), ignore, loss))
    return sums.select(*by, *_scores(sums, loss))


def masked_accuracy_arrays(
    df: DataFrame, predicted: str, labels: str, by: list[str], shift: int = 0
) -> DataFrame:
    """The same for rows that hold whole label arrays."""
    counted = df.withColumn("_c", token_counts(predicted, labels, shift))
    sums = counted.groupBy(*by).agg(
        F.sum("_c.correct").alias("correct"), F.sum("_c.valid").alias("valid")
    )
    return sums.withColumn("accuracy", _share(F.col("correct"), F.col("valid")))


def eval_summary(
    df: DataFrame, predicted: str, label: str, by: str, total: str = "total", ignore: int = IGNORE,
    loss: str | None = None,
) -> DataFrame:
    """Masked accuracy, and the loss if there is one, per value of ``by`` and over all rows."""
    sums = df.rollup(by).agg(
        *_masked_sums(F.col(predicted), F.col(label), ignore, loss), F.grouping(by).alias("_all")
    )
    named = F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(by))
    return sums.select(named.alias(by), *_scores(sums, loss))


def reduce_ranks(
    df: DataFrame, step: str, loss: str, correct: str, valid: str
) -> DataFrame:
    """Per-rank statistics to global ones: mean loss over ranks' steps, pooled accuracy."""
    sums = df.groupBy(step).agg(
        F.count(F.lit(1)).alias("n"), F.sum(loss).alias("_loss"),
        F.sum(correct).alias("correct"), F.sum(valid).alias("valid"),
    )
    return sums.select(
        step, "n",
        F.round(F.col("_loss") / F.col("n"), DIGITS).alias("loss"),
        "correct", "valid",
        _share(F.col("correct"), F.col("valid")).alias("accuracy"),
    )


def tokens_per_second(
    df: DataFrame, by: list[str], valid: Column, elapsed: Column
) -> DataFrame:
    """Supervised tokens over elapsed time."""
    sums = df.groupBy(*by).agg(valid.alias("valid"), elapsed.alias("elapsed"))
    return sums.withColumn("tokens_per_second", _share(F.col("valid"), F.col("elapsed")))


def leaderboard(log: DataFrame, run: str, method: str, step: str, loss: str) -> DataFrame:
    """First and last loss of each run, and its rank by the drop inside its method."""
    ends = log.groupBy(run, method).agg(
        F.min_by(loss, step).alias("first_loss"), F.max_by(loss, step).alias("last_loss")
    )
    dropped = ends.withColumn(
        "loss_drop", F.round(F.col("first_loss") - F.col("last_loss"), DIGITS)
    )
    return rank_within(dropped, method, -F.col("loss_drop"), run, "place")


def result_ranks(results: DataFrame, method: str, loss_before: str, loss_after: str) -> DataFrame:
    """Published result rows, a fixed handful, ranked by loss drop inside their method."""
    drop = F.round(F.col(loss_before) - F.col(loss_after), DIGITS)
    place = F.rank().over(Window.partitionBy(method).orderBy(F.desc("loss_drop")))
    return results.withColumn("loss_drop", drop).withColumn("place", place)


def compare_runs(a: DataFrame, b: DataFrame, model: str, value: str) -> DataFrame:
    """Mean value per model under two methods, their difference and ratio; models of one side only
    are included.

    The same rows as a full outer join of two aggregates, in one shuffle.
    """
    both = a.select(model, F.col(value).alias("_a"), F.lit(None).cast("double").alias("_b"))
    both = both.unionByName(
        b.select(model, F.lit(None).cast("double").alias("_a"), F.col(value).alias("_b"))
    )
    means = both.groupBy(model).agg(F.avg("_a").alias("_a"), F.avg("_b").alias("_b"))
    return means.select(
        model,
        F.round("_a", DIGITS).alias("mean_a"), F.round("_b", DIGITS).alias("mean_b"),
        F.round(F.col("_b") - F.col("_a"), DIGITS).alias("delta"),
        _share(F.col("_b"), F.col("_a")).alias("ratio"),
    )


def truncation_report(df: DataFrame, length: str, limits: list[int]) -> DataFrame:
    """Rows cut and tokens lost for each length limit, in one pass over the lengths."""
    n = F.col(length)
    sums = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(F.when(n > x, 1).otherwise(0)).alias(f"cut_{x}") for x in limits],
        *[F.sum(F.greatest(n - x, F.lit(0))).alias(f"lost_{x}") for x in limits],
    )
    lines = [
        F.struct(
            F.lit(x).cast("bigint").alias("max_length"), F.col("n_rows"),
            F.col(f"cut_{x}").alias("rows_cut"),
            _share(F.col(f"cut_{x}"), F.col("n_rows")).alias("share_cut"),
            F.col(f"lost_{x}").cast("bigint").alias("tokens_lost"),
        )
        for x in limits
    ]
    return sums.select(F.inline(F.array(*lines)))


def split_report(df: DataFrame, text: str) -> DataFrame:
    """Rows of each split, of the whole, and of no split; distinct texts, and those on both sides.

    The whole is counted by itself, so a row that reached neither split shows.
    """
    hashed = df.select("split", F.md5(text).alias("_md5"))
    sides = hashed.groupBy("_md5").agg(
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("_train"),
        F.sum(F.when(F.col("split") == "test", 1).otherwise(0)).alias("_test"),
        F.count(F.lit(1)).alias("_rows"),
    )
    shared = F.when((F.col("_train") > 0) & (F.col("_test") > 0), 1).otherwise(0)
    zero = F.lit(0).cast("bigint")
    counts = {
        "train": F.sum("_train"), "test": F.sum("_test"), "total": F.sum("_rows"),
        "unassigned": F.sum(F.col("_rows") - F.col("_train") - F.col("_test")),
        "distinct_texts": F.count("_md5"), "shared_texts": F.sum(shared),
    }
    sums = sides.agg(*[F.coalesce(n, zero).alias(part) for part, n in counts.items()])
    lines = [F.struct(F.lit(part).alias("part"), F.col(part).alias("n")) for part in counts]
    return sums.select(F.inline(F.array(*lines)))


def compare_generated(df: DataFrame, generated: str, true: str, by: list[str]) -> DataFrame:
    """Exact matches, mean line overlap (Jaccard) and mean length ratio per group.

    A generation that failed and is null counts as an empty text.
    """
    df = df.withColumns({c: F.coalesce(c, F.lit("")) for c in (generated, true)})
    lines_a, lines_b = F.split(generated, "\n"), F.split(true, "\n")
    overlap = F.size(F.array_intersect(lines_a, lines_b)) / F.size(F.array_union(lines_a, lines_b))
    ratio = F.length(generated) / F.greatest(F.length(true), F.lit(1))
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col(generated) == F.col(true), 1).otherwise(0)).alias("exact"),
        F.round(F.avg(overlap), DIGITS).alias("line_overlap"),
        F.round(F.avg(ratio), DIGITS).alias("length_ratio"),
    )


def supervision_report(df: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """For each way of masking: rows without any supervision, supervised tokens and their share."""
    counted = F.array(
        *[
            F.struct(
                F.lit(mode).alias("mode"), F.size(column).alias("n"),
                supervised(column).alias("s"),
            )
            for mode, column in labels.items()
        ]
    )
    return _supervision(df.select(F.inline(counted)))


def supervision_totals(df: DataFrame, tokens: str, counts: list[str]) -> DataFrame:
    """The same from rows that hold the number of tokens and the supervised ones of each way."""
    lines = [
        F.struct(F.lit(mode).alias("mode"), F.col(tokens).alias("n"), F.col(mode).alias("s"))
        for mode in counts
    ]
    return _supervision(df.select(F.inline(F.array(*lines))))


def _supervision(rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.when(F.col("s") == 0, 1).otherwise(0)).alias("unsupervised_rows"),
        F.sum("s").alias("supervised_tokens"), F.sum("n").alias("_n"),
    )
    return sums.withColumn(
        "supervised_share", _share(F.col("supervised_tokens"), F.col("_n"))
    ).drop("_n")
