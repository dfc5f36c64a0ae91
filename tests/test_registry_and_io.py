import json

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes
from tallyforge.operators import registry
from tallyforge.operators.codec import join_class_dim
from tallyforge.sources import files, sinks
from tallyforge.streaming import incoming


def test_best_epoch_needs_a_strict_gain_and_prefers_raw(spark):
    rows = [("r", 1, 0.5, None), ("r", 2, 0.7, 0.7), ("r", 3, 0.7, 0.7), ("s", 1, 0.2, 0.4)]
    log = spark.createDataFrame(rows, "exp_id string, epoch int, val_bal_acc double, ema_val_bal_acc double")
    got = {r.exp_id: (r.epoch, r.which) for r in registry.best_epoch(log).collect()}
    assert got == {"r": (2, "raw"), "s": (1, "ema")}


def record(exp, bal):
    taus = {"0.0": {"top1": 0.9, "balanced_acc": 0.5}, "0.5": {"top1": 0.8, "balanced_acc": 0.6}, "0.25": {"top1": 0.8, "balanced_acc": 0.6}}
    return {"exp_id": exp, "cfg": {"model": "m", "split_kind": "strat", "seed": 1, "extra_train_index": "x.csv", "extra_mode": "fill"}, "top1": 0.9,
            "balanced_acc": bal, "tau_sweep": taus, "confusion": [[1, 0], [0, 1]], "params_total": 11_234_567}


def test_runs_are_collected_and_bad_files_left_out(spark, tmp_path):
    for i, text in enumerate([json.dumps(record("a", 0.4), indent=2), json.dumps(record("b", 0.8), indent=2), "{not json", "{}"]):
        d = tmp_path / f"run{i}"
        d.mkdir()
        (d / "metrics.json").write_text(text)
    got = files.collect_runs(spark, str(tmp_path)).collect()
    assert [r.exp_id for r in got] == ["b", "a"]
    assert (got[0].tau_best, got[0].tau_best_bal, got[0].extra, got[0].params_M) == (0.25, 0.6, "fill", 11.23)
    assert registry.tau_grid(files.read_runs(spark, str(tmp_path))).count() == 6
    assert sorted(r.text for r in files.rejected_runs(spark, str(tmp_path)).collect()) == ["{not json", "{}"]
    # records one to a line, and a tau without a value
    odd = record("c", 0.9)
    odd["tau_sweep"]["1.0"] = {"top1": 0.1}
    (tmp_path / "lines.json").write_text(json.dumps(odd) + "\n" + json.dumps(record("d", 0.1)) + "\nbroken\n")
    got = {r.exp_id: r for r in files.collect_runs(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a", "b", "c", "d"] and (got["c"].tau_best, got["c"].tau_best_bal) == (0.25, 0.6)
    assert files.rejected_runs(spark, str(tmp_path)).count() == 3


def test_epoch_logs_coerce_and_allow_missing_columns(spark, tmp_path):
    d = tmp_path / "run_x"
    d.mkdir()
    (d / "log.csv").write_text("epoch,lr,val_bal_acc\n1,oops,0.5\n2,0.01,0.6\n")
    got = files.epoch_logs(spark, str(tmp_path)).orderBy("epoch").collect()
    assert [(r.exp_id, r.epoch, r.lr, r.val_bal_acc, r.ema_val_bal_acc) for r in got] == [("run_x", 1, None, 0.5, None), ("run_x", 2, 0.01, 0.6, None)]


def test_files_with_other_headers_are_read_by_name(spark, tmp_path):
    for name, text in (("r1", "epoch,val_bal_acc,val_top1\n1,0.5,0.7\n"), ("r2", "val_top1,lr,epoch,ema_val_bal_acc,val_bal_acc\n0.8,0.1,1,0.9,0.6\n0.81,0.1,2,,0.61\n"), ("r3", "")):
        (tmp_path / "logs" / name).mkdir(parents=True)
        (tmp_path / "logs" / name / "log.csv").write_text(text)
    got = {(r.exp_id, r.epoch): (r.val_top1, r.val_bal_acc, r.ema_val_bal_acc) for r in files.epoch_logs(spark, str(tmp_path / "logs")).collect()}
    assert got == {("r1", 1): (0.7, 0.5, None), ("r2", 1): (0.8, 0.6, 0.9), ("r2", 2): (0.81, 0.61, None)}
    (tmp_path / "exp").mkdir()
    (tmp_path / "exp" / "a.csv").write_text("exp_id,model,top1\na,m,0.9\n")
    (tmp_path / "exp" / "b.csv").write_text('exp_id,top1,model\n"b,1",0.7,n\n')
    got = {r.exp_id: (r.model, r.top1) for r in files.load_experiments(spark, str(tmp_path / "exp")).collect()}
    assert got == {"a": ("m", 0.9), "b,1": ("n", 0.7)}


def test_experiments_get_defaults_and_split_kinds(spark, tmp_path):
    (tmp_path / "e.csv").write_text("exp_id,top1,split_kind\na_doc,0.9,\nb_T4,bad,doc\nc,0.5,doc\n")
    got = {r.exp_id: r for r in files.load_experiments(spark, str(tmp_path)).collect()}
    assert {k: r.split_kind for k, r in got.items()} == {"a_doc": "doc", "b_T4": "strat", "c": "doc"}
    assert got["b_T4"].top1 is None and got["c"].img_size == 64.0 and got["c"].aug == "none" and len(got["c"]) == 28


def test_registry_queries(spark):
    rows = [("x_T4", "m", "strat", 0.90, 0.80), ("x_doc", "m", "doc", 0.85, 0.70), ("y_T4", "n", "strat", 0.95, 0.85)]
    e = spark.createDataFrame(rows, "exp_id string, model string, split_kind string, top1 double, balanced_acc double")
    assert [r.exp_id for r in registry.leaderboard(e, split_kind="strat").orderBy("rank").collect()] == ["y_T4", "x_T4"]
    gap = registry.pair_split_gap(e).collect()
    assert len(gap) == 1 and gap[0].base == "x" and gap[0].top1_gap == pytest.approx(-5.0)
    delta = {r.exp_id: r.delta_balanced_acc for r in registry.delta_vs_baseline(e, "x_T4").collect()}
    assert delta["y_T4"] == pytest.approx(5.0)
    dims = spark.createDataFrame([("m",), ("n",), ("o",)], "model string")
    grid = {r.model: (r["strat"], r["doc"]) for r in registry.grid_runs(e, dims, "model", "split_kind", ["strat", "doc"], F.lit(0), "top1").collect()}
    assert grid == {"m": (0.9, 0.85), "n": (0.95, None), "o": (None, None)}
    left = registry.remaining_runs(spark.createDataFrame([("x_T4",), ("z_T4",)], "exp_id string"), e)
    assert [r.exp_id for r in left.collect()] == ["z_T4"]


def test_file_scan(spark, tmp_path):
    for folder, name in (("a", "1.txt"), ("a", "2.TXT"), ("a", "x.bin"), ("zz", "1.txt"), ("a", ".hidden.txt")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(folder + name)
    kept, skipped = files.scan_files(spark, str(tmp_path), ".txt", Classes.of(spark, ["a", "b"]))
    assert sorted(r.name for r in kept.collect()) == ["1.txt", "2.TXT"]
    assert sorted((r.name, r.reason) for r in skipped.collect()) == [("1.txt", "class"), ("x.bin", "extension")]
    hashed, _ = files.scan_files(spark, str(tmp_path), ".txt", Classes.of(spark, ["a", "b"]), with_hash=True)
    assert hashed.where("length(md5) = 32").count() == 2


def test_splits_with_a_leak_are_not_written(spark, tmp_path):
    d = spark.createDataFrame([(1, 42, "train", "val"), (1, 42, "val", "val")], "key int, seed int, split string, doc_split string")
    with pytest.raises(ValueError, match="both sides"):
        sinks.write_splits(d, str(tmp_path / "s"), "key")
    ok = sinks.write_splits(d.where("split = 'train'"), str(tmp_path / "t"), "key")
    assert ok.count() == 1


def test_reports(spark, tmp_path):
    d = spark.createDataFrame([("b", 2), ("a", 1)], "k string, n int")
    sinks.write_report(d, str(tmp_path / "c"), "csv", ["k"])
    assert [r.k for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["a", "b"]
    sinks.write_report(d, str(tmp_path / "j"), "json", ["k"])
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    sinks.write_report(d, str(tmp_path / "m"), "markdown", ["k"])
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["| k | n |", "|---|---|", "| a | 1 |", "| b | 2 |"]
    with pytest.raises(ValueError):
        sinks.write_report(d, str(tmp_path / "x"), "xls", ["k"])
    many = spark.range(30_000).selectExpr("30000 - id as k", "id as n")
    sinks.write_report(many, str(tmp_path / "y"), "csv", ["k"])
    assert [int(r.k) for r in spark.read.option("header", True).csv(str(tmp_path / "y")).orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()] == list(range(1, 30_001))


def test_stream_of_items(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "q")], "id int, c string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, c string").parquet(str(tmp_path / "in"))
    named = join_class_dim(stream, "c", Classes.of(spark, ["a", "b"]), "left")
    out = str(tmp_path / "out")
    q = incoming.triage_batches(named, lambda b: b.groupBy("label").count(), out, str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.label, r["count"]) for r in spark.read.parquet(out).collect()} == {(0, 1), (None, 1)}
