"""Corpus versions: label differences, change lists, fix plans, merged sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes, settle, small
from tallyforge.functions.skew import join_keyed
from tallyforge.operators.clean import existence_marks
from tallyforge.operators.codec import family_of


def diff_labels(a: DataFrame, b: DataFrame, key: str, name: str, cls: str) -> DataFrame:
    """Per base name: same, move, drop or ambiguous, comparing labelling a with labelling b.

    A name that is not unique in a, or found more than once in b, is ambiguous. Both sides are
    unioned and grouped by name, so nothing is matched pairwise.
    """
    none = F.lit(None)
    sides = a.select(name, F.col(key).alias("ka"), F.col(cls).alias("ca"), none.cast("string").alias("cb")).unionByName(
        b.select(name, none.cast(a.schema[key].dataType).alias("ka"), none.cast("string").alias("ca"), F.col(cls).alias("cb"))
    )
    per = sides.groupBy(F.col(name).alias("name")).agg(
        F.count("ca").alias("n_a"),
        F.min("ka").alias("key"),
        F.min("ca").alias("old_class"),
        F.count("cb").alias("n_b"),
        F.min("cb").alias("new_class"),
    ).where("n_a > 0")
    action = (
        F.when(F.col("n_a") > 1, "ambiguous")
        .when(F.col("new_class").isNull(), "drop")
        .when(F.col("n_b") > 1, "ambiguous")
        .when(F.col("new_class") != F.col("old_class"), "move")
        .otherwise("same")
    )
    return per.withColumn("action", action)


def change_list(diff: DataFrame) -> DataFrame:
    """The audit rows of a difference: moves and drops."""
    return diff.where(F.col("action").isin("move", "drop")).select(
        "key", "old_class", F.when(F.col("action") == "move", F.col("new_class")).alias("new_class"), "action"
    )


def overlay_changes(df: DataFrame, changes: DataFrame, key: str, cls: str, classes: Classes) -> DataFrame:
    """Drops removed, moved rows with their new class and label; the input is not touched.

    A key may be listed again with the same change; different changes of one key fail the job, so
    the list can never multiply rows.
    """
    one = F.struct(F.col("new_class").alias("_new"), F.col("action").alias("_action"))
    per = changes.groupBy(F.col("key").alias(key)).agg(F.min(one).alias("_c"), F.max(one).alias("_last"))
    clash = F.raise_error(F.concat(F.lit("several changes of "), F.col(key).cast("string"))).cast("string")
    action = F.when(F.col("_c").eqNullSafe(F.col("_last")), F.col("_c._action")).otherwise(clash)
    side = per.select(key, F.col("_c._new").alias("_new"), action.alias("_action"))
    out = df.join(side, key, "left").where(F.coalesce("_action", F.lit("")) != "drop")
    out = out.withColumn(cls, F.coalesce(F.when(F.col("_action") == "move", F.col("_new")), cls))
    out = out.drop("_new", "_action", "label")
    return out.join(classes.side.withColumnRenamed("class", cls), cls, "left")


def _pair_rows(df: DataFrame, pairs: Sequence[str], action: str, start: int) -> list[tuple]:
    rows = []
    for i, text in enumerate(pairs):
        a, sep, b = text.partition(">")
        if not sep:
            raise ValueError(f"a pair looks like 'a>b', got {text!r}")
        rows.append((a.strip(), b.strip(), action, start + i))
    return rows


def plan_fixes(
    candidates: DataFrame,
    classes: Classes,
    reviewed: DataFrame | None = None,
    relabel: Sequence[str] = (),
    drop: Sequence[str] = (),
    min_conf: float = 0.70,
    listed: DataFrame | None = None,
) -> DataFrame:
    """Actions (key, action, from_class, to_class) on noise candidates, one per key: the first one.

    Order: reviewed rows (key, verdict[, pos: their order]), relabel pairs, drop pairs, each in the
    order given; among candidates of one rank the surest. Of several verdicts without ``pos`` the least
    in the alphabet counts. A reviewed key that is no candidate, or a pair without candidates, fails
    the job. ``listed`` (y_class, pred_class, action, priority from 1) gives the pairs as a table instead.
    """
    spark = candidates.sparkSession
    names = set(classes.require_names())
    rows = _pair_rows(candidates, relabel, "relabel", 1) + _pair_rows(candidates, drop, "drop", 1 + len(relabel))
    for a, b, _, _ in rows:
        if a not in names or b not in names:
            raise ValueError(f"{a}>{b} names a class outside the universe")
    cand = candidates.where(F.col("p_pred") >= min_conf).select("key", "y_class", "pred_class", "p_pred")
    bound: int | None = len(rows)
    if listed is None:
        listed = spark.createDataFrame(rows, "y_class string, pred_class string, action string, priority int")
    else:
        bound = None
    pairs = listed.groupBy("y_class", "pred_class").agg(F.min_by("action", "priority").alias("pair_action"), F.min("priority").alias("rank"))
    picked = cand.join(small(pairs, bound), ["y_class", "pred_class"], "left")
    unmet = listed.join(cand.select("y_class", "pred_class").distinct(), ["y_class", "pred_class"], "left_anti")
    stop = unmet.select(F.concat_ws(">", "y_class", "pred_class").alias("what"))
    if reviewed is not None:
        verdict = F.lower(F.trim("verdict"))
        place = F.struct(F.col("pos") if "pos" in reviewed.columns else F.lit(0), verdict)
        rev = reviewed.where(verdict.isin("relabel", "drop")).groupBy("key").agg(F.min_by(verdict, place).alias("verdict"))
        picked = picked.join(rev, "key", "left")
        stop = stop.unionByName(rev.join(cand, "key", "left_anti").select(F.col("key").cast("string").alias("what")))
    else:
        picked = picked.withColumn("verdict", F.lit(None).cast("string"))
    act = F.struct(F.coalesce("verdict", "pair_action").alias("action"), F.col("y_class").alias("from_class"), F.col("pred_class").alias("to_class"))
    order = F.struct(F.coalesce("rank", F.lit(1 << 30)), -F.col("p_pred"), "pred_class", "y_class")
    actions = picked.where("coalesce(verdict, pair_action) is not null").groupBy("key").agg(F.min_by(act, order).alias("a")).select("key", "a.*")
    failed = stop.select(F.raise_error(F.concat(F.lit("no candidate for "), F.col("what"))).cast("string").alias("action"))
    key_type = candidates.schema["key"].dataType
    failed = failed.select(
        F.lit(None).cast(key_type).alias("key"), "action",
        F.lit(None).cast("string").alias("from_class"), F.lit(None).cast("string").alias("to_class"),
    )
    return actions.unionByName(failed)


def apply_fixes(df: DataFrame, actions: DataFrame, key: str, cls: str, classes: Classes) -> DataFrame:
    """The corpus after a fix plan."""
    changes = actions.select(
        "key",
        F.when(F.col("action") == "relabel", F.col("to_class")).alias("new_class"),
        F.when(F.col("action") == "relabel", "move").otherwise("drop").alias("action"),
    )
    return overlay_changes(df, changes, key, cls, classes)


def attach_source(df: DataFrame, shipped: DataFrame, path: str, source_name: str) -> DataFrame:
    """Source name of each row from the shipped manifest by normalised path; family derived."""
    side = shipped.select(F.regexp_replace(path, r"\\", "/").alias("_p"), F.col(source_name).alias("source_name"))
    side = side.groupBy("_p").agg(F.min("source_name").alias("source_name"))
    out = df.withColumn("_p", F.regexp_replace(path, r"\\", "/")).join(side, "_p", "left").drop("_p")
    out = out.withColumn("source_name", F.coalesce("source_name", F.lit("")))
    return out.withColumn("family", family_of(F.col("source_name")))


def semi_cache(idx: DataFrame, store: DataFrame, key: str, on: str, tag: str) -> DataFrame:
    """Index rows whose payload is stored, under a key that is unique across sources."""
    have = store.select(F.col(on).alias(key))
    return idx.join(have, key, "left_semi").withColumn(key, F.concat(F.lit(f"{tag}::"), F.col(key).cast("string")))


def semi_cache_counted(idx: DataFrame, store: DataFrame, key: str, on: str, tag: str) -> tuple[DataFrame, dict[str, int]]:
    """(rows of ``semi_cache``, settled; {n_rows: all rows of the index, n_dropped: those without a payload}).

    Both come from one pass of one join: the counts are observed while the kept rows are written.
    """
    marked = existence_marks(idx, store, key, on, "_has")
    seen = Observation("semi_cache")
    counted = marked.observe(seen, F.count("*").alias("n_rows"), F.count_if(~F.col("_has")).alias("n_dropped"))
    kept = counted.where("_has").drop("_has").withColumn(key, F.concat(F.lit(f"{tag}::"), F.col(key).cast("string")))
    return settle(kept, "semi-cache"), dict(seen.get)


def merge_sources(frames: Sequence[DataFrame], tags: Sequence[str], key: str) -> DataFrame:
    """Union of indexes with tagged keys; columns missing on one side become NULL."""
    out = None
    for df, tag in zip(frames, tags, strict=True):
        df = df.withColumn(key, F.concat(F.lit(f"{tag}::"), F.col(key).cast("string"))).withColumn("origin", F.lit(tag))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def drop_groups(df: DataFrame, groups: DataFrame, on: str, spread: str) -> DataFrame:
    """Rows whose ``on`` is not one of the groups (one row per key with its size ``n``)."""
    return join_keyed(df, groups.select(on), [on], spread, "left_anti", sizes=groups)
