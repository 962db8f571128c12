"""Run metrics, artifacts, reports and budgets: goldens and small hand-made logs."""

import pytest
from pyspark.sql import functions as F

from blockloom.functions.columns import fixed, format_elapsed, last_path_part, round_up
from blockloom.operators import artifacts as A
from blockloom.operators import budget as G
from blockloom.operators import metrics as M
from blockloom.operators import reports as R


def test_round_up(spark):
    pairs = [(0, 8, 0), (1, 8, 8), (8, 8, 8), (9, 8, 16), (31, 8, 32), (7, 1, 7)]
    df = spark.createDataFrame(pairs, "n long, k long, want long")
    for r in df.select("want", round_up(F.col("n"), F.col("k")).alias("got")).collect():
        assert r["got"] == r["want"]
    assert df.select(round_up(F.col("n"), 8)).first()[0] == 0
    with pytest.raises(ValueError):
        round_up(F.col("n"), 0)
    with pytest.raises(Exception, match="positive multiple"):
        spark.range(1).select(round_up(F.col("id"), F.col("id"))).collect()


ELAPSED = {
    0.0005: "0ms",
    0.001: "0.00s",
    5.0: "5.00s",
    59.999: "60.00s",
    60.0: "1:00m",
    3599.0: "59:59m",
    3600.0: "1:00:00h",
    86399.0: "23:59:59h",
    86400.0: "1:00:00:00d",
    90061.0: "1:01:01:01d",
}


def test_format_elapsed(spark):
    df = spark.createDataFrame([(s,) for s in ELAPSED], "s double")
    assert {r["s"]: r["t"] for r in df.select("s", format_elapsed(F.col("s")).alias("t")).collect()} == ELAPSED


def test_fixed_rounds_like_float_formatting(spark):
    values = [0.125, 0.375, 1.005, 2.675, 1234567.0, 0.0, 9.995, -1.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["v"]: r["t"] for r in df.select("v", fixed(F.col("v"), 2).alias("t")).collect()}
    assert got == {v: f"{v:.2f}" for v in values}


def test_metric_line(spark):
    rows = [
        (1, 0, "train/loss", 2.5, True),
        (1, 1, "progress/samples", 128.0, False),
        (1, 2, "perf/step_time", 61.0, True),
    ]
    df = spark.createDataFrame(rows, "step int, ord int, name string, value double, is_float boolean")
    line = R.metric_line(df, by=("step",)).first()["line"]
    assert line == "loss: 2.500, samples: 128, step_time: 1:01m"
    assert R.metric_line(df, by=("step",), prefix="val").first()["line"].startswith("val loss: ")
    assert spark.range(1).select(last_path_part(F.lit("a/b/c"))).first()[0] == "c"


STEPS = (
    "run_id long, session long, rank long, batch_idx long, step long, phase string, batch_size long, width long, "
    "devices long, loss double, start_us long, end_us long, peak_bytes long"
)


def step(batch, phase="train", rank=0, session=0, size=2, width=8, loss=1.0, run=1, start=0, end=0, peak=0):
    return (run, session, rank, batch, batch // 2, phase, size, width, 4, loss, start, end, peak)


def log(spark, rows):
    return spark.createDataFrame(rows, STEPS).repartition(3)


def test_progress_restarts_with_the_session(spark):
    rows = [step(0), step(1, rank=1), step(2, size=1, width=16), step(3, "val"), step(4, session=1)]
    got = {r["batch_idx"]: (r["samples"], r["tokens"]) for r in M.progress(log(spark, rows)).collect()}
    assert got == {0: (8, 64), 2: (12, 128), 4: (8, 64)}
    at_val = M.progress_at_val(log(spark, rows)).collect()
    assert [(r["batch_idx"], r["samples"], r["tokens"]) for r in at_val] == [(3, 12, 128)]


def test_progress_across_ranges_of_steps(spark, monkeypatch):
    rows = [step(i) for i in range(40)]
    whole = sorted(map(str, M.progress(log(spark, rows)).collect()))
    monkeypatch.setattr(M, "STEP_RANGE", 7)
    assert sorted(map(str, M.progress(log(spark, rows)).collect())) == whole


def test_losses(spark):
    rows = [
        step(0, "val", 0, size=3, loss=1.0),
        step(1, "val", 0, size=1, loss=5.0),
        step(0, "val", 1, size=2, loss=4.0),
        step(2, loss=9.0),
        step(2, rank=1, loss=8.0),
    ]
    losses = M.val_loss(log(spark, rows)).collect()
    assert [(r["step"], r["val_loss"], r["ranks"]) for r in losses] == [(0, 3.0, 2)]
    assert [r["loss"] for r in M.train_loss(log(spark, rows)).collect()] == [9.0]


def test_system_metrics_skip_the_first_interval(spark, monkeypatch):
    mib = 2**20
    spans = [
        (1, 0, 0, 0, 0, 10_000_000, 5 * mib),
        (1, 0, 1, 0, 0, 12_000_000, 7 * mib),
        (1, 0, 0, 9, 30_000_000, 31_000_000, 3 * mib),
        (1, 0, 1, 9, 30_000_000, 33_000_000, 4 * mib),
        # After a restart the pause is no interval.
        (1, 1, 0, 12, 900_000_000, 901_000_000, 9 * mib),
    ]
    df = spark.createDataFrame(
        spans, "run_id long, session long, rank long, step long, start_us long, end_us long, peak_bytes long"
    )
    for size in (65_536, 4):
        monkeypatch.setattr(M, "STEP_RANGE", size)
        rows = M.system_metrics(df).collect()
        assert [(r["step"], r["max_peak_mib"], r["avg_seconds"]) for r in rows] == [(9, 4.0, 19.0)]


def test_best_checkpoint_uses_the_loss_known_at_the_save(spark):
    losses = spark.createDataFrame([(1, 2, 5.0), (1, 6, 3.0), (1, 9, 1.0)], "run_id long, step long, val_loss double")
    saves = spark.createDataFrame([(1, 1), (1, 2), (1, 8)], "run_id long, step long")
    known = M.loss_at_saves(saves, losses)
    assert {r["step"]: r["loss"] for r in known.collect()} == {1: None, 2: 5.0, 8: 3.0}
    best = M.best_checkpoint(known).collect()
    assert [(r["step"], r["loss"]) for r in best] == [(8, 3.0)]


def test_every_eleventh_event_acts(spark):
    session = F.when(F.col("id") < 40, 0).otherwise(1).alias("session")
    events = spark.range(60).select(F.lit(1).alias("run_id"), session, (F.col("id") * 3).alias("step"))
    acted = M.every_nth(events).collect()
    # The count starts again with the second session.
    assert sorted(r["event_no"] for r in acted) == [11, 11, 22, 33]
    assert sorted(r["step"] for r in acted) == [30, 63, 96, 150]


def test_checkpoint_name(spark):
    cols = [F.lit(100), F.lit(12800), F.lit(6553600), F.lit(2.345678)]
    name = spark.range(1).select(A.checkpoint_name(*cols)).first()[0]
    assert name == "snap-100-samples-12800.0-6553600.0-loss-2.35"


def test_diverged_numbers(spark):
    inf, nan = float("inf"), float("nan")
    named = spark.createDataFrame([(inf,), (-inf,), (nan,)], "v double")
    shown = [r[0] for r in named.select(A.checkpoint_name(F.lit(1), F.lit(2), F.lit(3), F.col("v"))).collect()]
    assert [s.rsplit("-loss-", 1)[1] for s in shown] == ["inf", "-inf", "nan"]
    times = named.select(format_elapsed(F.col("v"))).collect()
    assert [r[0] for r in times] == [None, None, None]


ARTIFACTS = [
    # run, artifact, iteration, created, bytes, cache, aliases
    (1, 10, 0, 100, 5, 0, ["keep"]),
    (1, 11, 1, 200, 5, 0, []),
    (1, 12, 2, 200, 5, 0, ["best", "latest"]),
    (2, 20, 0, 300, 7, 0, ["latest"]),
]


@pytest.fixture(scope="module")
def stock(spark):
    schema = (
        "run_id long, artifact_id long, iter long, created_us long, size_bytes long, cache_id long, "
        "aliases array<string>"
    )
    return spark.createDataFrame(ARTIFACTS, schema)


def test_pruning_and_retention(stock, monkeypatch):
    for size in (65_536, 1):
        monkeypatch.setattr(A, "ITER_RANGE", size)
        marked = {r["artifact_id"]: r["delete"] for r in A.latest_only(stock).collect()}
        assert marked == {10: True, 11: True, 12: False, 20: False}
        final = {r["artifact_id"]: r["aliases"] for r in A.final_aliases(stock).collect()}
        assert final[12] == ["best", "latest", "train_end"]
        assert final[11] == [] and final[10] == ["keep"]
    assert {r["artifact_id"] for r in A.retention(stock).collect()} == {11, 20}


def test_cache_keeps_the_newest_within_the_limit(stock):
    rows = {r["artifact_id"]: (r["kept_bytes"], r["keep"]) for r in A.cache_trim(stock, 12).collect()}
    assert rows == {20: (7, True), 12: (12, True), 11: (17, False), 10: (22, False)}


def test_references(spark, stock):
    refs = spark.createDataFrame(
        [("wandb:1",), ("wandb:1",), ("wandb:1:best",), ("wandb:2:keep",), ("out/wandb:x",), ("wandb:9",)], "ref string"
    )
    rows = {r["ref"]: (r["resolved"], r["artifact_id"]) for r in A.resolve_refs(refs, stock).collect()}
    assert rows == {
        "wandb:1": ("model-1:latest", 12),
        "wandb:1:best": ("model-1:best", 12),
        "wandb:2:keep": ("model-2:keep", None),
        "out/wandb:x": ("out/wandb:x", None),
        "wandb:9": ("model-9:latest", None),
    }


RUNS = (
    "name string, base_unit string, training_goal long, eval_interval double, save_interval double, "
    "warmup_period double, lr_decay_period double, block_size long, batch_size long, num_devices long, "
    "micro_batch_size long, gradient_accumulation_steps long"
)


def run(name, **options):
    o = {**G.DEFAULTS, **options}
    return (
        name,
        o["base_unit"],
        o["training_goal"],
        float(o["eval_interval"]),
        float(o["save_interval"]),
        float(o["warmup_period"]),
        float(o["lr_decay_period"]),
        o["block_size"],
        o["batch_size"],
        o["num_devices"],
        o["micro_batch_size"],
        o["gradient_accumulation_steps"],
    )


TOKENS = dict(base_unit="tokens", eval_interval=0.05, save_interval=0.25)
GOLDEN = [
    (run("defaults"), (1, 100000, 10000, 10000, 500, True)),
    (run("small", training_goal=10**9, batch_size=512, **TOKENS), (262144, 3814, 190, 953, 19, True)),
    (run("large", training_goal=2 * 10**12, block_size=2048, **TOKENS), (262144, 7629394, 381469, 1907348, 38146, True)),
    (run("samples", base_unit="samples"), (128, 781, 78, 78, 3, True)),
    (run("iters", base_unit="iters", micro_batch_size=16), (8, 12500, 1250, 1250, 62, True)),
]
INVALID = [
    run("devices do not divide", num_devices=3),
    run("no devices", num_devices=0),
    run("micro batch does not divide", micro_batch_size=48),
    run("accumulation does not fit", micro_batch_size=16, gradient_accumulation_steps=2),
    run("micro batch beyond batch", micro_batch_size=256),
    run("goal below one step", base_unit="samples", training_goal=100),
    run("interval below one step", base_unit="samples", training_goal=1000),
    run("unknown unit", base_unit="epochs"),
]


def test_run_plan_goldens(spark):
    df = spark.createDataFrame([r for r, _ in GOLDEN], RUNS)
    got = {r["name"]: r for r in G.run_plan(df).collect()}
    for row, want in GOLDEN:
        r = got[row[0]]
        steps = (r["units_per_step"], r["goal_steps"], r["eval_steps"], r["save_steps"], r["warmup_steps"], r["valid"])
        assert steps == want, row[0]


def test_run_plan_marks_contradictions(spark):
    for r in G.run_plan(spark.createDataFrame(INVALID, RUNS)).collect():
        assert r["valid"] is False, r["name"]


def test_run_coverage(spark):
    plan = G.run_plan(spark.createDataFrame([run("defaults"), run("other", block_size=999)], RUNS))
    stats = spark.createDataFrame(
        [("train", 512, 1000), ("val", 512, 10)], "split string, block_size long, blocks long"
    )
    rows = {r["name"]: r for r in G.run_coverage(plan, stats).collect()}
    assert rows["defaults"]["steps_per_epoch"] == 8
    assert rows["defaults"]["epochs"] == 12500.0
    assert rows["defaults"]["tokens_seen"] == 100000 * 128 * 512
    assert rows["other"]["epochs"] is None


def test_last_layer_wins(spark):
    rows = [(1, "lr", 0, 0, "a"), (1, "lr", 2, 0, "c"), (1, "lr", 1, 9, "b"), (1, "wd", 99, 0, "z"), (1, "wd", 99, 1, "y")]
    df = spark.createDataFrame(rows, "run_id long, key string, layer long, seq long, value string")
    assert {r["key"]: r["value"] for r in G.layered_overrides(df).collect()} == {"lr": "c", "wd": "y"}
