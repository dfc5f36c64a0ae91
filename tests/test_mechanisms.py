"""Medians by ranges, the subset lattice, hash sketches, the rank index, staged writes, keyed stores, readers, streams."""

import hashlib
import itertools
import statistics

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import ranking
from tallyforge.functions.bounds import Classes, settle, settled_tables
from tallyforge.functions.quantiles import exact_medians
from tallyforge.operators import clean, ensemble, overlay, profile, sample, split
from tallyforge.sources import files, sinks
from tallyforge.streaming import incoming


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- exact medians -------------------------------------------------------------------------------------
def test_medians_of_as_many_values_as_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 3}" if i % 7 else None, float(x), int(y)) for i, (x, y) in enumerate(zip(rng.normal(0, 1e6, 3000), rng.integers(0, 4, 3000), strict=True))]
    rows += [("one", 5.0, 1), ("none", None, None), ("pair", 1.0, 1), ("pair", 2.0, None), ("ties", -1.0, 2), ("ties", -1.0, 2), ("ties", 7.5, 2)]
    got = exact_medians(spark.createDataFrame(rows, "g string, x double, y int").repartition(7), ["g"], {"x": F.col("x"), "y": F.col("y")})
    have = {r.g: (r.med_x, r.med_y) for r in got.collect()}
    for g in {r[0] for r in rows} - {"none"}:
        want = tuple(statistics.median(v) if v else None for v in ([r[k] for r in rows if r[0] == g and r[k] is not None] for k in (1, 2)))
        assert have[g] == want, g
    assert "none" not in have
    (row,) = exact_medians(spark.createDataFrame(rows, "g string, x double, y int"), [], {"x": F.col("x")}).collect()
    assert row.med_x == statistics.median(r[1] for r in rows if r[1] is not None)
    assert exact_medians(spark.createDataFrame([], "g string, x double"), ["g"], {"x": F.col("x")}).collect() == []


def test_medians_gather_no_group(spark):
    d = spark.range(1000).select((F.col("id") % 2).alias("g"), F.rand(1).alias("x"))
    got = exact_medians(d, ["g"], {"x": F.col("x")})
    # nothing but counts, sums and windows over one range: no percentile buffers
    assert "percentile" not in plan_of(got).lower() and "collect" not in plan_of(got).lower()


# --- corpus summary ------------------------------------------------------------------------------------
def test_corpus_summary_maps(spark):
    rows = [(1, "a", "p1", 10, 3, True, 0.5, "d1"), (2, "a", "p2", 20, 4, True, 0.25, "d1"), (3, "b", None, 30, 5, False, None, "d2"), (4, "b", "p1", 40, 6, True, 0.75, None), (5, "a", "p1", 50, 9, True, 0.1, "d3")]
    m = spark.createDataFrame(rows, "key int, class string, group string, w int, h int, ok boolean, grey double, doc string")
    got = profile.corpus_summary(m, Classes.of(spark, ["a", "b", "c"]), "w", "h", prefix=F.col("group"), category=F.upper("class"), doc=F.col("doc"), grey=F.col("grey"))
    r = got.first()
    assert (r.n_total, r.n_ok, r.n_groups, r.med_w, r.med_h, r.n_classes, r.imbalance) == (5, 4, 2, 30.0, 5.0, 3, None)
    assert r.per_class == {"a": 3, "b": 2, "c": 0} and r.per_prefix == {"p1": 3, "p2": 1} and r.per_category == {"A": 3, "B": 2}
    assert (r.n_no_prefix, r.n_no_category, r.n_docs, r.mid_grey) == (1, 0, 3, 0.4)
    empty = profile.corpus_summary(m.limit(0), Classes.of(spark, ["a"]), "w", "h", prefix=F.col("group")).first()
    assert (empty.n_total, empty.med_w, empty.per_class, empty.per_prefix, empty.gini) == (0, None, {"a": 0}, {}, 0.0)


def test_corpus_summary_reads_once(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([(1, "a", "g", 1, 2, True)], "key int, class string, group string, w int, h int, ok boolean").write.parquet(path)
    got = profile.corpus_summary(spark.read.parquet(path), Classes.of(spark, ["a"]), "w", "h")
    got.collect()
    # what is left to do reads settled cells, not the table
    assert path not in plan_of(got)


# --- subsets of an ensemble ----------------------------------------------------------------------------
def scores(spark, n_models, n_items=40, width=4, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, width, n_items).tolist()
    rows = [(f"m{k}", i, y[i], rng.normal(0, 2, width).tolist()) for k in range(n_models) for i in range(n_items)]
    return rows, spark.createDataFrame(rows, "model string, item_id int, y int, scores array<double>")


def test_subset_lattice_equals_each_subset(spark):
    rows, d = scores(spark, 4)
    rows = rows[:-5]  # the last model has not scored five items
    d = spark.createDataFrame(rows, d.schema)
    names = ["m0", "m1", "m2", "m3"]
    by = {(m, i): np.array(v) for m, i, _, v in rows}
    for how in ("soft", "logit"):
        got = {(r.subset, r.item_id): r.scores for r in ensemble.ensemble_subsets(d, names, ["item_id"], how, 4).collect()}
        want = {}
        for size in (2, 3, 4):
            for s in itertools.combinations(names, size):
                for i in range(40):
                    if all((m, i) in by for m in s):
                        v = np.stack([by[m, i] for m in s])
                        p = np.exp(v - v.max(1, keepdims=True))
                        want["+".join(s), i] = np.log((p / p.sum(1, keepdims=True)).mean(0) + 1e-9) if how == "soft" else v.mean(0)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)
    with pytest.raises(ValueError):
        ensemble.ensemble_subsets(d, names, ["item_id"], "vote", 4)


def test_eight_models_shuffle_their_rows_once(spark):
    rows, d = scores(spark, 8, n_items=25)
    names = [f"m{k}" for k in range(8)]
    priors = spark.createDataFrame([(i, -float(i + 1)) for i in range(4)], "label int, log_prior double")
    got = ensemble.subset_sweep(d, names, ["item_id"], priors, (0, 0.5))
    table = got.collect()
    assert len(table) == 25 * 247 * 3
    one = next(r for r in table if r.item_id == 3 and r.subset == "m1+m6" and r.how == "soft" and r.tau == 0.5)
    zero = next(r for r in table if r.item_id == 3 and r.subset == "m1+m6" and r.how == "soft" and r.tau == 0)
    assert np.allclose(one.scores, np.array(zero.scores) + 0.5 * np.arange(1, 5))
    # one exchange of items, its input the score rows as they are: no explode below it
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Aggregate [item_id")
    assert "Generate" in above and "Generate" not in below and "Join" not in below


# --- group draws ---------------------------------------------------------------------------------------
@pytest.mark.parametrize("n_groups", [2, 60])
def test_smallest_hashes_equal_a_sort_of_all_draws(spark, n_groups):
    groups = [(f"g{i}", i + 1) for i in range(n_groups)] + [(None, 7)]
    d = spark.createDataFrame(groups, "grp string, n bigint").repartition(5)
    got = {}
    for r in ranking.smallest_hashes(d, 3, 20, (42, "x")).collect():
        got.setdefault((r.seed, r.draw), set()).add((r.grp, r.n))
    for seed in ("42", "x"):
        for draw in range(20):
            h = lambda g: hashlib.md5(f"{seed}:{draw}{'' if g[0] is None else ':' + g[0]}".encode()).hexdigest()  # noqa: B023, E731
            assert got[seed, draw] == set(sorted(groups, key=h)[:3])


def test_group_draws_do_not_repeat_groups(spark):
    d = spark.createDataFrame([(i, f"g{i % 30}") for i in range(300)], "k int, g string")
    plan = split.group_holdout_draws(d, "g", seeds=(1, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(0, 199" not in plan and plan.count("MapInArrow") == 1
    both = {(r.seed, r.grp) for r in split.group_holdout_draws(d, "g", seeds=(1, 2)).collect()}
    assert both == {(str(s), r.grp) for s in (1, 2) for r in split.group_holdout_groups(d, "g", seed=s).collect()}
    numbers = spark.createDataFrame([(i % 9,) for i in range(90)], "g int")
    assert dict(split.group_holdout_groups(numbers, "g").dtypes)["grp"] == "int"


# --- the rank index ------------------------------------------------------------------------------------
def test_rank_index_finds_every_rank(spark):
    rows = [(i, "a" if i % 3 else "b", f"text {i}") for i in range(500)] + [(900, "c", "only")]
    d = spark.createDataFrame(rows, "key int, cls string, text string")
    order = {}
    for r in sorted(rows, key=lambda r: (hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0])):
        order.setdefault(r[1], []).append(r)
    asked = [(c, n) for c, members in order.items() for n in range(1, len(members) + 1)] * 2 + [("zz", 1)]
    index = ranking.RankIndex(d, "cls", "key")
    got = index.rows_at(spark.createDataFrame(asked, "cls string, rank bigint"), "rank")
    assert sorted((r.cls, r["rank"], r.key, r.text) for r in got.collect()) == sorted((c, n, order[c][n - 1][0], order[c][n - 1][2]) for c, n in asked if c != "zz")
    assert sorted(r.id for r in index.numbers("id").collect()) == list(range(len(rows)))


def test_a_draw_reads_only_its_bucket(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(3000).select(F.col("id").alias("key"), F.lit("a").alias("cls"), F.repeat(F.lit("x"), 100).alias("text")).write.parquet(path)
    d = spark.read.parquet(path)
    got = sample.weighted_resample(d, Classes.of(spark, ["a"]), "cls", "key", 5, 0.5)
    assert len(got.collect()) == 5 and all(len(r.text) == 100 for r in got.collect())
    whole = sample.weighted_resample(d, Classes.of(spark, ["a"]), "cls", "key", None, 0.5)
    assert sorted(r.draw for r in whole.select("draw").collect()) == list(range(3000))
    # the wide rows are filtered by the buckets asked for before they are shuffled to be ranked
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window [row_number()") < plan.index("LeftSemi")


# --- stores and splits ---------------------------------------------------------------------------------
def test_keyed_store_skips_files_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "glyphs")
    d = spark.range(2000).select(F.col("id").alias("key"), (F.col("id") % 3).cast("int").alias("label"), F.array(F.col("id") % 200).alias("pixels"), F.lit(1).alias("w"), F.lit(1).alias("h"))
    sinks.write_glyphs(d, path, ["key", "label"], parts=16)
    assert sinks.glyph_rows(spark, path).count() == 2000 and spark.read.parquet(f"{path}/ranges").count() == 16
    keys = spark.createDataFrame([(5,), (17,), (5,), (None,), (99_999,)], "key bigint")
    got = sinks.read_glyphs(spark, path, keys, "key")
    assert sorted(r.key for r in got.collect()) == [5, 17] and "part" not in got.columns
    plan = plan_of(got)
    parts = {r.part for r in spark.read.parquet(f"{path}/ranges").where("(ends.low <= 5 and ends.high >= 5) or (ends.low <= 17 and ends.high >= 17)").collect()}
    assert len(parts) == 1 and f"PartitionFilters: [isnotnull(part" in plan and "GreaterThanOrEqual(key,5), LessThanOrEqual(key,17)" in plan
    read = sinks.glyph_rows(spark, path).where(F.col("part").isin(list(parts))).count()
    assert read < 2000 / 8
    assert sinks.read_glyphs(spark, path, keys.where("key > 5000"), "key").count() == 0
    sinks.write_glyphs(d.limit(0), str(tmp_path / "none"), ["key"])
    assert spark.read.schema("part int").parquet(f"{tmp_path}/none/ranges").count() == 0


def test_a_failed_split_leaves_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, 42, "train", "val"), (1, 42, "val", "val")], "key int, seed int, split string, doc_split string")
    with pytest.raises(ValueError, match="both sides"):
        sinks.write_splits(d, str(tmp_path / "s"), "key")
    broken = d.withColumn("split", F.raise_error(F.lit("no split")).cast("string"))
    with pytest.raises(Exception, match="no split"):
        sinks.write_splits(broken, str(tmp_path / "s"), "key")
    assert not any(p.name.startswith("s") for p in tmp_path.iterdir())
    sinks.write_splits(d.where("split = 'train'"), str(tmp_path / "s"), "key")
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("s")] == ["s"]
    with pytest.raises(FileExistsError):
        sinks.write_splits(d.where("split = 'train'"), str(tmp_path / "s"), "key")


# --- readers -------------------------------------------------------------------------------------------
def test_csv_files_of_different_headers(spark, tmp_path):
    text = {
        "run one/log.csv": "epoch,val_top1,lr\n1,0.5,n/a\n2,0.75,0.1\n",
        "exp_id=b/log.csv": '﻿"val_top1" , note,epoch\n0.25,"a ""quoted"", text",1\n',
        "c+%20/log.csv": "epoch\n",
        "d/log.csv": "",
        "e/log.csv": "epoch,epoch,val_top1\n7,8,\n\n9\n10,11,0.5,too many\n",
    }
    for name, body in text.items():
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(body, encoding="utf-8")
    got = {(r.exp_id, r.epoch, r.val_top1, r.lr) for r in files.epoch_logs(spark, str(tmp_path)).collect()}
    assert got == {("run one", 1, 0.5, None), ("run one", 2, 0.75, 0.1), ("b", 1, 0.25, None), ("e", 8, None, None), ("e", None, None, None), ("e", 11, 0.5, None)}
    assert "Python" not in plan_of(files.epoch_logs(spark, str(tmp_path))) and "MapInArrow" not in plan_of(files.epoch_logs(spark, str(tmp_path)))


def test_a_csv_file_above_one_split(spark, tmp_path):
    (tmp_path / "big").mkdir()
    (tmp_path / "big" / "log.csv").write_text("lr,epoch\n" + "".join(f"{i / 4},{i}\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = files.epoch_logs(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 8
        assert {(r.exp_id, r.epoch, r.lr) for r in got.collect()} == {("big", i, i / 4) for i in range(20_000)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_pretty_record_with_a_line_in_braces_is_one_record(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "exp_id": "x",\n "cfg":\n {"model": "m", "seed": 1}\n,\n "top1": 0.5}\n')
    (tmp_path / "b.json").write_text('{"exp_id": "y", "cfg": {"model": "m"}}\n{"exp_id": "z", "cfg": {"model": "m"}}\n{"exp_id": broken}\n')
    assert sorted(r.exp_id for r in files.read_runs(spark, str(tmp_path)).collect()) == ["x", "y", "z"]
    assert [r.text for r in files.rejected_runs(spark, str(tmp_path)).collect()] == ['{"exp_id": broken}']


# --- one pass for rows and counts ----------------------------------------------------------------------
def test_kept_and_dropped_from_one_pass(spark):
    idx = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (4, "d")], "k int, v string")
    store = spark.createDataFrame([(2,), (2,), (1,), (None,), (9,)], "id int")
    kept, counts = overlay.semi_cache_counted(idx, store, "k", "id", "t")
    assert sorted((r.k, r.v) for r in kept.collect()) == [("t::1", "a"), ("t::2", "b"), ("t::2", "b")] and counts == {"n_rows": 5, "n_dropped": 2}
    assert sorted(r.k for r in kept.collect()) == sorted(r.k for r in overlay.semi_cache(idx, store, "k", "id", "t").collect())
    present, absent = clean.existence_filter(idx, store, "k", "id")
    assert present.count() == 3 and sorted(r.v for r in absent.collect()) == ["c", "d"] and present.columns == idx.columns
    plan = clean.existence_marks(idx, store, "k", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


# --- streams -------------------------------------------------------------------------------------------
def test_a_restarted_stream_repeats_no_batch(spark, tmp_path):
    landing, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))

    def deliver(rows):
        spark.createDataFrame(rows, "id int, c string").coalesce(1).write.mode("append").parquet(landing)

    def run():
        items = spark.readStream.schema("id int, c string").option("maxFilesPerTrigger", 1).parquet(landing)
        incoming.triage_batches(items, lambda b: b.groupBy("c").count(), out, check).trigger(availableNow=True).start().awaitTermination(120)
        return {(r.batch, r.c): r["count"] for r in spark.read.parquet(out).collect()}

    deliver([(1, "a"), (2, "a")])
    deliver([(3, "b")])
    first = run()
    assert sorted(first.values()) == [1, 2] and len({b for b, _ in first}) == 2
    assert run() == first  # nothing new: no further batch
    deliver([(4, "a")])
    then = run()
    assert {k: v for k, v in then.items() if k in first} == first and len(then) == 3


# --- settled tables ------------------------------------------------------------------------------------
def test_settled_tables_go_with_their_owner(spark):
    d = spark.range(5)
    with settled_tables(spark):
        inner = settle(d, "inner")
        kept = settle(inner.where("id > 2"), "kept", owned=False)
        assert inner.count() == 5
    assert kept.count() == 2
    with pytest.raises(Exception, match="(?i)not.?exist|FILE_NOT_EXIST|not found"):
        spark.read.parquet(inner.inputFiles()[0]).count()
    outside = settle(d, "outside")
    assert outside.count() == 5


# --- the scorer's bounded slices -----------------------------------------------------------------------
def test_scoring_in_slices_is_the_same(spark, monkeypatch):
    from tallyforge.operators import score

    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), int(i % 2), " ".join("ab" * int(x) for x in rng.integers(1, 9, int(rng.integers(0, 60))))) for i in range(120)]
    batch_rows = spark.createDataFrame(rows, "k int, label int, fold int, text string")
    tokens = score.tokens_of(score.words_of(batch_rows, "text", "k", "label", "fold"))
    model = score.nb_fit(tokens, 3, folds=2)
    whole = sorted((tuple(map(str, r)) for r in score.nb_score(tokens, model, ["k"], folds=2).collect()))
    names, lps = model.tables["lengths", 0]
    token = rng.choice(np.append(names, 10**6), 5000)
    row = np.sort(rng.integers(0, 40, 5000))
    want = np.zeros((40, 3))
    for t, r in zip(token, row, strict=True):
        if t in names:
            want[r] += lps[list(names).index(t)]
    for size in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(score, "SLICE", size)
        value, seen = score._sums(token, row, 40, names, lps)
        assert np.array_equal(value, want) and seen.sum() == np.isin(token, names).sum()
        b = score.pa.record_batch([score.pa.array(range(4)), score.pa.array([[1] * n for n in (0, 5, 70, 3)])], names=["x", "t"])
        assert sum(p.num_rows for p in score._slices(b, 1)) == 4
        assert [list(v) for p in score._slices(b.slice(1, 3), 1) for v in p.column(1).to_pylist()] == [[1] * 5, [1] * 70, [1] * 3]
    assert len(whole) == 120 * 3


def test_ten_million_tokens_stay_below_a_gigabyte():
    import tracemalloc

    from tallyforge.operators import score

    rng = np.random.default_rng(1)
    names = np.arange(300)
    lps = rng.integers(-(10**7), 0, (300, 72))
    token, row = rng.integers(0, 300, 10_000_000), np.sort(rng.integers(0, 2000, 10_000_000))
    tracemalloc.start()
    value, _ = score._sums(token, row, 2000, names, lps)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30 and value.shape == (2000, 72)
    tracemalloc.stop()


# --- naming, mistakes and noise of all models ----------------------------------------------------------
def test_second_naming_scheme(spark):
    from tallyforge.operators import codec

    names = ["all/a-161-b-label-x/Set2_F1_P-0001_23.jpg", "all/a-7-b-o/none.PNG", "all/a-x-b-o/P-1.jpg", "all/a-7-b/P-1.jpg", "a-7-b-o/P-1.jpg", "all/a-7-b-o/P-1.txt", None]
    got = codec.parse_external_folders(spark.createDataFrame([(n,) for n in names], "p string"), "p")
    assert [(r.orig_label, r.code, r.writer_id) for r in got.collect()] == [("label", 161, "P-0001"), ("o", 7, "")]


def test_mistakes_per_model(spark):
    from tallyforge.operators import errors

    rows = [(m, i, 0, p, c) for m in ("a", "b") for i, (p, c) in enumerate([(1, 0.9), (1, 0.8), (2, 0.95), (0, 0.6), (0, 0.5)])]
    pred = spark.createDataFrame(rows, "model string, item_id int, y int, pred int, p1 double")
    shown = errors.show_class(pred, 0).collect()
    assert [(r.model, r.pred, r.n_mistaken, r.item_id) for r in shown[:3]] == [("a", 1, 2, 0), ("a", 1, 2, 1), ("a", 2, 1, 2)] and len(shown) == 6
    sure = errors.confident_mistakes(pred, "item_id", 1, ["model"]).collect()
    assert sorted((r.model, r.list, r.item_id) for r in sure) == [("a", "right_unsure", 4), ("a", "wrong_sure", 2), ("b", "right_unsure", 4), ("b", "wrong_sure", 2)]
    assert sorted((r.list, r.item_id, r.model) for r in errors.confident_mistakes(pred.where("model = 'a'"), "item_id", 1).collect()) == [("right_unsure", 4, "a"), ("wrong_sure", 2, "a")]
    cells = spark.createDataFrame([(m, y, p, n) for m in "ab" for y, p, n in [(0, 1, 5), (1, 0, 4), (2, 0, 1), (2, 2, 9), (0, 0, 7)]], "model string, y int, pred int, n int")
    zoom = errors.confusion_zoom(cells, 2, ["model"]).collect()
    assert sorted((r.model, r.y, r.pred) for r in zoom) == [(m, y, p) for m in "ab" for y, p in [(0, 0), (0, 1), (1, 0)]]


def test_scores_of_words_are_those_of_token_arrays(spark, monkeypatch):
    """the scorer without token arrays, whole and in small slices, plain, by folds and under all perturbations."""
    from tallyforge.operators import score, stress

    odd = [None, "", "a", "\U0001d49c\U0001d49c x", "été NAÏVE İstanbul ß", "12 !", "straße " * 50, "ab abc abcd abcdefghij " * 9]
    rows = [(i, i % 3, i % 2, odd[i % len(odd)]) for i in range(48)]
    words = score.words_of(spark.createDataFrame(rows, "k int, label int, fold int, text string"), "text", "k", "label", "fold")
    tokens = score.tokens_of(words)
    said = lambda d: sorted(map(str, d.collect()))
    for folds in (0, 2):
        model = score.nb_fit(tokens, 3, folds)
        own = score.nb_fit(words, 3, folds)
        assert own.tables.keys() == model.tables.keys() and own.prior.keys() == model.prior.keys()
        assert all(np.array_equal(x, y) for k in model.tables for x, y in zip(model.tables[k], own.tables[k], strict=True))
        want = said(score.nb_score(tokens, model, ["k"], folds))
        for size in (1, 40, 1 << 18):
            monkeypatch.setattr(score, "WORDS", size)
            assert said(score.score_words(words, model, ["k"], folds)) == want
    plain = score.nb_fit(words, 3)
    want = score.nb_score(score.tokens_of(stress.perturbed(words)), plain, ["k", "condition", "severity"])
    got = stress.with_cell(score.score_words(words, plain, ["k"], variants=stress.variants()))
    assert said(got.select(want.columns)) == said(want)


def test_arrow_batches_bounds_what_python_gets(spark):
    from tallyforge.functions.bounds import arrow_batches

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    d = spark.range(0, 40, 1, 1).select(F.when(F.col("id") < 20, F.repeat(F.lit("x"), 1 << 18)).otherwise("y").alias("t")).mapInArrow(sizes, "rows long, bytes long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with arrow_batches(spark, rows=10, size=1 << 20):
        got = d.collect()
    assert sum(r.rows for r in got) == 40 and max(r.rows for r in got) <= 10 and max(r.bytes for r in got) < 3 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
