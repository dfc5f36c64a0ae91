"""Mixing sources to target weights: budgets down a tree, token prefixes of seeded epochs.

The levels (here domain, language, source) make a tree whose leaves hold the rows. A leaf can
supply its tokens ``max_epochs`` times. From the root down, each node deals its budget to its
children by weight; a child that can supply less than its share takes all it has, and the
shortage goes to its siblings by weight, so that only what a whole family cannot supply goes to
the family's siblings (the budget of a node never exceeds what its family can supply). The level
of the water that fills the children is found from sums over buckets of supply / weight and then,
in the one bucket where it lies, exactly; families of any number of children need no common task.

In each leaf epoch e lists the rows in the order of ``md5(seed:e:id)``. Whole epochs are taken
while the budget lasts; of the next one the prefix in which the tokens before a row are below what
is left. The end of the prefix is found by ``hash_cutoffs``, which never sorts a leaf.

Defined results: NULL parts of a path are nodes of their own; a NULL text has no tokens; rows with a
NULL id have the empty id; repeated rows tie and are taken together; a child of weight 0 or below (or NULL)
gets nothing and counts for nothing in what its family can supply, so its share goes to its siblings and, if they
cannot use it, to the family's; a very long text is one row of the prefix, taken whole; added columns replace
carried ones of the same name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import attach_row, settle
from tallyforge.functions.ranking import cutoff_number, hash_cutoffs
from tallyforge.llm.common import word_array

# Buckets of supply / weight per doubling.
PER_DOUBLING = 4


def _join_null_safe(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns in which NULL equals NULL; they come from ``a``."""
    for c in on:
        b = b.withColumnRenamed(c, f"_b_{c}")
    return a.join(b, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in on], how).drop(*[f"_b_{c}" for c in on])


def water_level(children: DataFrame, parent: list[str]) -> DataFrame:
    """(parent, level): the least level at which the children (supply, weight, budget of the parent)
    take min(supply, weight x level) each and all of the budget; NULL if all of them are emptied.
    """
    d = children.where("weight > 0 and supply > 0").withColumn("ratio", F.col("supply") / F.col("weight"))
    d = d.withColumn("bucket", F.floor(PER_DOUBLING * F.log2("ratio")).cast("int"))
    rows = d.groupBy(*parent, "ratio", "bucket").agg(F.sum("supply").alias("s"), F.sum("weight").alias("w"), F.max("budget").alias("budget"))
    sums = rows.groupBy(*parent, "bucket").agg(F.sum("s").alias("s"), F.sum("w").alias("w"), F.max("budget").alias("budget"), F.min("ratio").alias("low"))
    ahead = Window.partitionBy(*parent).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    zero = F.lit(0.0)
    sums = sums.withColumn("s0", F.coalesce(F.sum("s").over(ahead), zero)).withColumn("w0", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(ahead), zero))
    # the last bucket whose lowest child is filled when the water reaches it, or the first one
    reached = F.when(F.col("s0") + F.col("low") * F.col("w0") <= F.col("budget"), F.col("bucket"))
    sums = sums.withColumn("border", F.coalesce(F.max(reached).over(whole), F.min("bucket").over(whole)))
    border = sums.where("bucket = border").select(*parent, "bucket", "s0", "w0")
    inside = _join_null_safe(rows, border, [*parent, "bucket"])
    upto = Window.partitionBy(*parent).orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)
    s_before = F.col("s0") + F.coalesce(F.sum("s").over(upto), zero)
    w_left = F.col("w0") - F.coalesce(F.sum("w").over(upto), zero)
    steps = inside.select(*parent, "ratio", "budget", "s", "w", s_before.alias("sb"), w_left.alias("wl"))
    steps = steps.withColumn("level", (F.col("budget") - F.col("sb")) / F.col("wl"))
    steps = steps.withColumn("open", F.col("ratio") > F.col("level"))
    # after the last child of the border bucket, if all of it is filled
    next_level = F.when(F.col("wl") - F.col("w") > 1e-9, (F.col("budget") - F.col("sb") - F.col("s")) / (F.col("wl") - F.col("w")))
    return steps.groupBy(*parent).agg(F.coalesce(F.expr("min_by(level, ratio) FILTER (WHERE open)"), F.max_by(next_level, "ratio")).alias("level"))


def deal(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (supply, weight, budget of the parent) with their own budget in whole tokens."""
    level = water_level(nodes, parent)
    joined = _join_null_safe(nodes, level, parent, "left") if parent else attach_row(nodes, level)
    share = F.coalesce(F.col("weight") * F.col("level"), F.col("supply").cast("double"))
    own = F.least(F.col("supply"), F.floor(F.round(share, 6)))
    return joined.withColumn("budget", F.when(F.col("weight") > 0, own).otherwise(0).cast("bigint")).drop("level")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, Column], budget: Column, max_epochs: int) -> DataFrame:
    """``leaves`` (levels, tokens) with their budget.

    ``weights[level]`` is the weight of a node among its siblings, as a Column over the level names;
    ``budget`` is a Column over ``total``, the tokens of all leaves.
    """
    # a leaf below a node of weight 0 supplies nothing, so its family is dealt only what it can spend
    open_ = F.lit(True)
    for name in levels:
        open_ = open_ & F.coalesce(weights[name].cast("double") > 0, F.lit(False))
    leaves = settle(leaves.withColumn("supply", F.when(open_, F.col("tokens") * max_epochs).otherwise(0)), "leaves")
    root = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"), F.coalesce(F.sum("supply"), F.lit(0)).alias("supply"))
    above, path = root.select(F.least(budget.cast("bigint"), "supply").alias("budget")), []
    for depth, name in enumerate(levels):
        keys = levels[: depth + 1]
        nodes = leaves.groupBy(*keys).agg(F.sum("supply").alias("supply")).withColumn("weight", weights[name].cast("double"))
        nodes = _join_null_safe(nodes, above.select(*path, "budget"), path) if path else attach_row(nodes, above)
        above, path = settle(deal(nodes, path), "budgets"), keys
    return _join_null_safe(leaves, above.select(*levels, "budget"), levels)


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, Column], budget: Column, max_epochs: int = 2, seed: object = 42, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the levels, tokens and ``epochs``: how often the row is taken (0: not at all).

    The rows get their leaf's cut-off by a join on the leaf: a broadcast if the written table of
    leaves is small, else a join that the adaptive planner splits where a leaf is hot.
    """
    keep = [c for c in (docs.columns if keep is None else keep)]
    names = list(levels)
    path = [levels[n].cast("string").alias(n) for n in names]
    leaf = F.to_json(F.struct(*path), {"ignoreNullFields": "false"}).alias("_leaf")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id")
    tokens = F.size(word_array(F.col(text_col))).cast("bigint").alias("tokens")
    narrow = settle(docs.select(leaf, key, tokens, *path), "mix-rows")
    leaves = narrow.groupBy("_leaf", *names).agg(F.sum("tokens").alias("tokens"))
    dealt = leaf_budgets(leaves, names, weights, budget, max_epochs)
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("int")
    dealt = settle(dealt.select("_leaf", full.alias("full"), (F.col("budget") - full * F.col("tokens")).alias("rest")), "leaf-budgets")
    epoch_seed = F.concat(F.lit(f"{seed}:"), F.col("full").cast("string"))
    seeded = settle(narrow.select("_leaf", "_id", "tokens").join(dealt.select("_leaf", "full"), "_leaf"), "mix-seeded")
    cuts = hash_cutoffs(seeded, "_leaf", "_id", lambda total: [F.coalesce(F.col("rest"), F.lit(0)) + 0 * total], epoch_seed, "tokens", side=dealt)
    plan = settle(dealt.join(cuts, "_leaf", "left"), "leaf-cuts")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), leaf, key, tokens, *path)
    rows = rows.join(plan.select("_leaf", "full"), "_leaf")
    marked = cutoff_number(rows, "_leaf", "_id", plan.select("_leaf", "cuts"), epoch_seed, None, "_past")
    epochs = (F.col("full") + F.coalesce(F.col("_past") == 0, F.lit(False)).cast("int")).cast("bigint")
    own = [c for c in keep if c not in (*names, "tokens", "epochs")]
    return marked.select(*[F.col("_row")[c].alias(c) for c in own], *names, "tokens", epochs.alias("epochs"))


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns only."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *docs.columns)
    mixed = mix(packed, keep=["_doc"], **options)
    taken = mixed.where("epochs > 0").select("_doc", F.explode(F.sequence(F.lit(1), F.col("epochs"))).alias("_epoch"))
    return taken.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
