from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from promptloom.operators import metrics, scoring

# method, model, loss before, accuracy, loss after, runtime
RESULTS = [
    ("x", "m1", 2.4526, 0.9872, 0.0438, 7474.6963), ("x", "m2", 2.3461, 0.9868, 0.0434, 6753.9399),
    ("x", "m3", 2.2221, 0.9856, 0.0649, 6896.2251), ("x", "m4", 2.1476, 0.9898, 0.0428, 9443.4287),
    ("y", "m1", 1.0263, 0.9526, 0.2624, 2311.8159), ("y", "m2", 1.661, 0.9448, 0.2496, 2751.4148),
    ("y", "m3", 1.4116, 0.9587, 0.226, 2068.3584), ("y", "m5", 1.3811, 0.9475, 0.2523, 2410.313),
]


def results(spark):
    return spark.createDataFrame(
        RESULTS, "method string, model string, pre double, acc double, post double, runtime double"
    )


def test_result_ranks(spark):
    ranked = metrics.result_ranks(results(spark), "method", "pre", "post").collect()
    places = {(r.method, r.model): r.place for r in ranked}
    assert [places["x", m] for m in ("m1", "m2", "m3", "m4")] == [1, 2, 3, 4]
    assert [places["y", m] for m in ("m2", "m3", "m5", "m1")] == [1, 2, 3, 4]


def test_leaderboard_ranks_the_result_rows_alike(spark):
    steps = F.array(
        F.struct(F.lit(0).alias("step"), F.col("pre").alias("loss")),
        F.struct(F.lit(1).alias("step"), F.col("post").alias("loss")),
    )
    log = results(spark).select("method", "model", F.inline(steps))
    board = metrics.leaderboard(log, "model", "method", "step", "loss").collect()
    ranked = metrics.result_ranks(results(spark), "method", "pre", "post").collect()
    assert {(r.method, r.model): (r.loss_drop, r.place) for r in board} == {
        (r.method, r.model): (r.loss_drop, r.place) for r in ranked
    }


def test_compare_runs_keeps_one_sided_models(spark):
    rows = results(spark)
    a, b = rows.filter("method = 'x'"), rows.filter("method = 'y'")
    got = {r.model: (r.mean_a, r.mean_b, r.delta) for r in
           metrics.compare_runs(a, b, "model", "runtime").collect()}
    assert set(got) == {"m1", "m2", "m3", "m4", "m5"}
    assert got["m4"] == (9443.4287, None, None) and got["m5"] == (None, 2410.313, None)
    ratios = [round(got[m][0] / got[m][1], 2) for m in ("m1", "m2", "m3")]
    assert ratios == [3.23, 2.45, 3.33]


def test_masked_accuracy_arrays(spark):
    rows = [("r", [5, 8, 7], [5, 6, -100]), ("none", [1], [-100])]
    df = spark.createDataFrame(rows, "run string, pred array<int>, labels array<int>")
    got = {r.run: (r.correct, r.valid, r.accuracy) for r in
           metrics.masked_accuracy_arrays(df, "pred", "labels", ["run"]).collect()}
    assert got == {"r": (1, 2, 0.5), "none": (0, 0, None)}


def test_reduce_ranks(spark):
    rows = [(0, 0, 2.0, 1, 2), (0, 1, 4.0, 3, 4), (1, 0, 1.0, 0, 0)]
    df = spark.createDataFrame(rows, "step int, rank int, loss double, correct int, valid int")
    got = {r.step: (r.loss, r.correct, r.valid, r.accuracy) for r in
           metrics.reduce_ranks(df, "step", "loss", "correct", "valid").collect()}
    assert got == {0: (3.0, 4, 6, 0.666667), 1: (1.0, 0, 0, None)}


def test_eval_summary_keeps_a_null_group_apart(spark):
    rows = [("a", 1, 1), (None, 0, 1), ("a", 1, -100)]
    df = spark.createDataFrame(rows, "run string, pred int, label int")
    got = {(r.run, r.correct, r.valid) for r in
           metrics.eval_summary(df, "pred", "label", "run").collect()}
    assert got == {("a", 1, 1), (None, 0, 1), ("total", 1, 2)}


def test_compare_generated(spark):
    rows = [("f", "a\nb", "a\nb"), ("f", "a", "b"), ("g", "xx", "")]
    df = spark.createDataFrame(rows, "file string, gen string, true string")
    got = {r.file: tuple(r)[1:] for r in
           metrics.compare_generated(df, "gen", "true", ["file"]).collect()}
    assert got == {"f": (2, 1, 0.5, 1.0), "g": (1, 0, 0.0, 2.0)}


def test_supervision_report(spark):
    df = spark.createDataFrame([([1, 2],), ([3],)], "ids array<int>")
    labels = {"all": F.col("ids"), "none": F.transform("ids", lambda x: F.lit(-100))}
    got = {r.mode: tuple(r)[1:] for r in metrics.supervision_report(df, labels).collect()}
    assert got == {"all": (2, 0, 3, 1.0), "none": (2, 2, 0, 0.0)}


def test_score_sets_up_once_per_partition(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("p")).repartition(2)

    def make():
        import uuid

        mark = uuid.uuid4().hex
        return lambda prompts: prompts + " " + mark

    rows = scoring.score(df, make, "p", "g").collect()
    assert len(rows) == 100 and all(r.g.split(" ")[0] == r.p for r in rows)
    assert len({r.g.split(" ")[1] for r in rows}) == 2


def test_failed_generations_lower_the_means(spark):
    df = spark.createDataFrame([("f", "a", "a"), ("f", None, "b")], "file string, gen string, true string")
    assert tuple(metrics.compare_generated(df, "gen", "true", ["file"]).first()) == ("f", 2, 1, 0.5, 0.5)


def test_rows_of_no_split_show(spark):
    df = spark.createDataFrame([("train", "a"), ("test", "a"), (None, "b")], "split string, text string")
    got = {r.part: r.n for r in metrics.split_report(df, "text").collect()}
    assert got == {"train": 1, "test": 1, "total": 3, "unassigned": 1, "distinct_texts": 2, "shared_texts": 1}


def test_loss_is_summed_over_steps(spark):
    rows = [("a", 1, 1, 2.0), ("a", 0, 1, 1.0), ("b", 1, -100, None)]
    df = spark.createDataFrame(rows, "run string, pred int, label int, loss double")
    got = {r.run: (r.loss_sum, r.steps, r.mean_loss) for r in metrics.eval_summary(df, "pred", "label", "run", loss="loss").collect()}
    assert got == {"a": (3.0, 2, 1.5), "b": (0.0, 0, None), "total": (3.0, 2, 1.5)}


def test_a_broken_run_goes_on(spark, tmp_path):
    """A task fails in the middle; the next run generates only what the log lacks, each distinct prompt once."""
    calls, trap = tmp_path / "calls", tmp_path / "trap"
    rows = [(k, f"prompt {k % 40}" if k % 7 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, p string").repartition(4)

    def make():
        def run(prompts):
            if trap.exists() and prompts.str.endswith("17").any():
                raise ValueError("the model is gone")
            with open(calls, "a") as f:
                f.writelines(f"{p}\n" for p in prompts)
            return prompts.str.upper()

        return run

    log = f"file://{tmp_path}/log"
    again = lambda data: scoring.score_resumable(data, make, "p", "g", log, "id", per_slice=4)
    trap.touch()
    with pytest.raises(Exception, match="the model is gone"):
        again(df)
    kept = {r.digest for r in scoring.read_log(spark, log).collect()}
    trap.unlink()
    before = calls.read_text().count("\n")
    got = {r.id: r.g for r in again(df).collect()}
    assert got == {k: (p or "").upper() for k, p in rows}
    prompts = {p or "" for _, p in rows}
    assert 0 < len(kept) < len(prompts)
    assert calls.read_text().count("\n") - before == len(prompts) - len(kept)
    # all is there: no further call, new prompts only
    seen = calls.read_text().count("\n")
    more = df.unionByName(spark.createDataFrame([(1000, "new one"), (1001, "prompt 3")], df.schema))
    assert {r.id: r.g for r in again(more).collect()} == got | {1000: "NEW ONE", 1001: "PROMPT 3"}
    assert calls.read_text().count("\n") == seen + 1
    assert again(df.limit(0)).collect() == []
