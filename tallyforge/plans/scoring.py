"""Score tables derived from the documents, and the same tables as CTEs.

The tables are settled once per application and data folder: every evaluation query starts
from stored scores, as a corpus team would keep them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes, arrow_batches, settle, spread
from tallyforge.operators import sample, score, split, stress
from tallyforge.operators.codec import join_class_dim
from tallyforge.plans import corpus as C
from tallyforge.plans.base import table

FOLDS = 5
MINORITY = 110
_stored: dict[tuple, object] = {}


def _once(spark: SparkSession, sf: str, name: str, make):
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        _stored[key] = make()
    return _stored[key]


def dim(spark: SparkSession, sf: str) -> Classes:
    return _once(spark, sf, "dim", lambda: C.langs(spark, sf))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    """documents with split and label; the split's cut-offs are worked out once."""
    d = dim(spark, sf)
    cuts = _once(spark, sf, "split", lambda: settle(split.split_cutoffs(C.documents(spark, sf), "lang", "doc_id", rows=d.rows), "split"))
    docs = split.stratified_split(C.documents(spark, sf), "lang", "doc_id", rows=d.rows, cutoffs=cuts)
    return join_class_dim(docs, "lang", d)


def train_counts(spark: SparkSession, sf: str) -> DataFrame:
    """(class, label, n) of the training rows."""

    def make():
        return settle(sample.class_counts(labelled(spark, sf).where("split = 'train'"), dim(spark, sf), "lang"), "train-counts")

    return _once(spark, sf, "train_counts", make)


def model(spark: SparkSession, sf: str) -> score.NaiveBayes:
    """The fitted scorer."""

    def make():
        train = spread(labelled(spark, sf).where("split = 'train'").select("label", "text"), C.documents(spark, sf))
        return score.nb_fit(score.words_of(train, "text", "label"), dim(spark, sf).rows)

    return _once(spark, sf, "model", make)


def _score_items(spark, sf, words, keys, variants=None):
    return score.score_words(words, model(spark, sf), keys, variants=variants)


def _settle_scored(df: DataFrame, name: str) -> DataFrame:
    with arrow_batches(df.sparkSession):
        return settle(df, name)


ITEM = ["item_id", "y", "source", "n_chars"]


def _items(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(F.col("doc_id").alias("item_id"), F.col("label").alias("y"), "source", "n_chars", "text", *extra)


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Validation scores: model, item_id, y, source, n_chars, scores."""

    def make():
        val = spread(_items(labelled(spark, sf).where("split = 'val'")), C.documents(spark, sf))
        return _settle_scored(_score_items(spark, sf, score.words_of(val, "text", *ITEM), ITEM), "scores")

    return _once(spark, sf, "scores", make)


def pred(spark: SparkSession, sf: str) -> DataFrame:
    return score.predict(scores(spark, sf))


def oof_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every document scored by the model that did not see its fold."""

    def make():
        d = dim(spark, sf)
        cuts = settle(split.fold_cutoffs(C.documents(spark, sf), "lang", "doc_id", FOLDS, rows=d.rows), "folds")
        docs = split.range_folds(C.documents(spark, sf), "lang", "doc_id", FOLDS, rows=d.rows, cutoffs=cuts)
        docs = _items(join_class_dim(docs, "lang", d), "fold")
        words = score.words_of(spread(docs, C.documents(spark, sf)), "text", *ITEM, "fold")
        fitted = score.nb_fit(words.withColumnRenamed("y", "label"), d.rows, FOLDS)
        return _settle_scored(score.score_words(words, fitted, ITEM, folds=FOLDS), "oof")

    return _once(spark, sf, "oof", make)


def oof_pred(spark: SparkSession, sf: str) -> DataFrame:
    return score.predict(oof_scores(spark, sf))


def sweep_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Validation scores under every cell of the perturbation grid."""

    def make():
        val = spread(_items(labelled(spark, sf).where("split = 'val'")), C.documents(spark, sf))
        scored = _score_items(spark, sf, score.words_of(val, "text", *ITEM), ITEM, stress.variants())
        return _settle_scored(stress.with_cell(scored), "sweep")

    return _once(spark, sf, "sweep", make)


def sweep_pred(spark: SparkSession, sf: str) -> DataFrame:
    return score.predict(sweep_scores(spark, sf))


def sweep_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _once(spark, sf, "sweep_metrics", lambda: settle(stress.sweep_table(sweep_pred(spark, sf)), "sweep-metrics"))


def junk_pred(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without a right answer, scored by the same models: kind, item, model, p1."""

    def make():
        b = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").cast("string").alias("item"), "text")
        c = table(spark, sf, "conversations").select(F.lit("conversations").alias("kind"), F.concat_ws("/", "conv_id", "turn").alias("item"), "text")
        words = score.words_of(spread(b.unionByName(c), b.unionByName(c)), "text", "kind", "item")
        return _settle_scored(_score_items(spark, sf, words, ["kind", "item"]), "junk")

    return score.predict(_once(spark, sf, "junk", make))


def views_pred(spark: SparkSession, sf: str) -> DataFrame:
    """Views of an item: as written, and with 1-3 letters cut off each word, as an angle in steps of 15."""
    d = sweep_pred(spark, sf).where(F.col("condition").isin("clean", "strip"))
    return d.withColumn("angle", (F.col("severity") * 15).cast("int"))


# ---------------------------------------------------------------------------
# the same tables for the oracles
# ---------------------------------------------------------------------------
MODELS_SQL = "(VALUES ('lengths'), ('finals'), ('vowels')) mm(model)"
DIM = "dim AS (SELECT lang AS class, row_number() OVER (ORDER BY lang) - 1 AS label FROM (SELECT DISTINCT lang FROM documents))"


def tokens_sql(src: str, keys: str, word: str = "w") -> str:
    return f"""SELECT {keys}, model, token, count(*) AS k FROM (
      SELECT {keys}, 'lengths' AS model, length({word})::VARCHAR AS token FROM {src} WHERE {word} IS NOT NULL
      UNION ALL SELECT {keys}, 'finals', right({word}, 1) FROM {src} WHERE {word} IS NOT NULL
      UNION ALL SELECT {keys}, 'vowels', length(regexp_replace({word}, '[^aeiouyàâäáæèéêëíìîïóòôöœúùûü]', '', 'g'))::VARCHAR FROM {src} WHERE {word} IS NOT NULL)
    GROUP BY ALL"""


FIT = (
    DIM
    + """,
words AS MATERIALIZED (SELECT doc_id, split, lang, unnest(regexp_extract_all(lower(text), '\\pL+')) AS w FROM sp),
tok AS MATERIALIZED ("""
    + tokens_sql("words", "doc_id, split, lang")
    + """),
cnt AS (SELECT model, token, lang AS class, sum(k) AS n FROM tok WHERE split = 'train' GROUP BY ALL),
voc AS (SELECT DISTINCT model, token FROM cnt),
vs AS (SELECT model, count(*) AS v FROM voc GROUP BY 1),
tot AS (SELECT model, class, sum(n) AS t FROM cnt GROUP BY ALL),
nb AS MATERIALIZED (SELECT voc.model, voc.token, dim.label, round(ln((coalesce(cnt.n, 0) + 1)::DOUBLE / (coalesce(t, 0) + v)) * 1000000)::BIGINT AS lp
       FROM voc JOIN vs USING (model) CROSS JOIN dim LEFT JOIN cnt ON cnt.model = voc.model AND cnt.token = voc.token AND cnt.class = dim.class
       LEFT JOIN tot ON tot.model = voc.model AND tot.class = dim.class),
tc AS MATERIALIZED (SELECT class, label, coalesce(n, 0) AS n FROM dim LEFT JOIN (SELECT lang AS class, count(*) AS n FROM sp WHERE split = 'train' GROUP BY 1) USING (class)),
pri AS (SELECT class, label, round(ln(greatest(n, 1)::DOUBLE / (SELECT sum(n) FROM tc)) * 1000000)::BIGINT AS lp FROM tc)
"""
)


def vectors_sql(items: str, toks: str, keys: str, out: str, nb_on: str = "USING (model, token)", pri: str = "pri", pri_on: str = "true", nb: str = "nb") -> str:
    """Long score table: items (with keys) x models x classes, from token counts."""
    on = " AND ".join(f"i.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    qualified = ", ".join(f"t.{k.strip()}" for k in keys.split(","))
    return f"""{out} AS MATERIALIZED (
  SELECT i.*, pri.class, pri.label, (pri.lp::DOUBLE + coalesce(s.s, 0)::DOUBLE) / 1000000::DOUBLE AS score, coalesce(s.n, 0) AS known
  FROM (SELECT * FROM {items} CROSS JOIN {MODELS_SQL}) i JOIN {pri} pri ON {pri_on}
  LEFT JOIN (SELECT {qualified}, model, label, sum(k * lp)::BIGINT AS s, sum(k)::BIGINT AS n FROM {toks} t JOIN {nb} {nb_on} GROUP BY ALL) s
    ON {on} AND i.model = s.model AND pri.label = s.label)"""


def pred_sql(src: str, keys: str, out: str, cols: str = "") -> str:
    """Per item and model: pred, p1, runner-up, p2, p_true, rank_true, from a long score table."""
    extra = f", {cols}" if cols else ""
    truth = (
        ", any_value(y) AS y, any_value(y_class) AS y_class, max(p) FILTER (label = y) AS p_true, max(rk) FILTER (label = y) AS rank_true"
        if out != "jp"
        else ""
    )
    return f"""{out}b AS MATERIALIZED (SELECT *, e / sum(e) OVER (PARTITION BY {keys}, model) AS p FROM (
    SELECT *, exp(score - max(score) OVER (PARTITION BY {keys}, model)) AS e, row_number() OVER (PARTITION BY {keys}, model ORDER BY score DESC, label) AS rk FROM {src})),
{out} AS MATERIALIZED (SELECT {keys}, model{extra}, max(label) FILTER (rk = 1) AS pred, max(class) FILTER (rk = 1) AS pred_class, max(p) FILTER (rk = 1) AS p1,
    max(p) FILTER (rk = 2) AS p2, max(class) FILTER (rk = 2) AS runner_up, any_value(known) AS known{truth} FROM {out}b GROUP BY {keys}, model{extra})"""


VAL_ITEMS = "vi AS (SELECT doc_id AS item_id, lang AS y_class, dim.label AS y, source, n_chars FROM sp JOIN dim ON dim.class = sp.lang WHERE split = 'val')"
SCORES = ",\n".join(
    x.strip()
    for x in (
        C.SPLIT, FIT, VAL_ITEMS,
        "vt AS (SELECT doc_id AS item_id, model, token, k FROM tok WHERE split = 'val')",
        vectors_sql("vi", "vt", "item_id", "sc"),
    )
)
PRED = SCORES + ",\n" + pred_sql("sc", "item_id", "pd", "source, n_chars")

_GRID_SQL = "(VALUES " + ", ".join(f"('{c}', {s}::DOUBLE)" for c, ss in stress.GRID.items() for s in ss) + ") g(condition, severity)"
SWEEP = ",\n".join(
    (
        C.SPLIT.strip(), FIT.strip(), VAL_ITEMS,
        f"""pw AS (SELECT doc_id AS item_id, condition, severity, CASE condition WHEN 'clip' THEN left(w, severity::INT) WHEN 'mirror' THEN reverse(w)
              WHEN 'strip' THEN nullif(left(w, greatest(length(w) - severity::INT, 0)), '')
              WHEN 'drop' THEN CASE WHEN ('0x' || substr(md5('drop:' || w), 1, 8))::BIGINT / 4294967296.0::DOUBLE >= severity THEN w END ELSE w END AS w
            FROM (SELECT * FROM words WHERE split = 'val') CROSS JOIN {_GRID_SQL})""",
        f"pt AS MATERIALIZED ({tokens_sql('pw', 'item_id, condition, severity')})",
        f"gi AS (SELECT * FROM vi CROSS JOIN {_GRID_SQL})",
        vectors_sql("gi", "pt", "item_id, condition, severity", "sw"),
        pred_sql("sw", "item_id, condition, severity", "ps"),
    )
)
JUNK = ",\n".join(
    (
        "ji AS (SELECT 'benchmark' AS kind, item_id::VARCHAR AS item, text FROM benchmark UNION ALL SELECT 'conversations', conv_id || '/' || turn, text FROM conversations)",
        "jw AS (SELECT kind, item, unnest(regexp_extract_all(lower(text), '\\pL+')) AS w FROM ji)",
        f"jt AS MATERIALIZED ({tokens_sql('jw', 'kind, item')})",
        vectors_sql("(SELECT kind, item FROM ji)", "jt", "kind, item", "js"),
        pred_sql("js", "kind, item", "jp"),
    )
)
OOF = ",\n".join(
    (
        DIM,
        C.FOLDS.strip(),
        "fw AS (SELECT doc_id, fold, lang, unnest(regexp_extract_all(lower(text), '\\pL+')) AS w FROM fd)",
        f"ft AS MATERIALIZED ({tokens_sql('fw', 'doc_id, fold, lang')})",
        "fl AS (SELECT unnest(range(5)) AS fold)",
        "fc AS MATERIALIZED (SELECT fl.fold, model, token, lang AS class, sum(k) AS n FROM ft JOIN fl ON fl.fold <> ft.fold GROUP BY ALL)",
        "fv AS (SELECT DISTINCT fold, model, token FROM fc)",
        "fs AS (SELECT fold, model, count(*) AS v FROM fv GROUP BY ALL)",
        "fo AS (SELECT fold, model, class, sum(n) AS t FROM fc GROUP BY ALL)",
        """fnb AS MATERIALIZED (SELECT fv.fold, fv.model, fv.token, dim.label, round(ln((coalesce(fc.n, 0) + 1)::DOUBLE / (coalesce(t, 0) + v)) * 1000000)::BIGINT AS lp
             FROM fv JOIN fs USING (fold, model) CROSS JOIN dim LEFT JOIN fc ON fc.fold = fv.fold AND fc.model = fv.model AND fc.token = fv.token AND fc.class = dim.class
             LEFT JOIN fo ON fo.fold = fv.fold AND fo.model = fv.model AND fo.class = dim.class)""",
        """fpri AS (SELECT fl.fold, dim.class, dim.label, round(ln(greatest(count(fd.doc_id) FILTER (fd.lang = dim.class), 1)::DOUBLE / count(fd.doc_id)) * 1000000)::BIGINT AS lp
             FROM fl CROSS JOIN dim JOIN fd ON fd.fold <> fl.fold GROUP BY ALL)""",
        "fi AS (SELECT doc_id AS item_id, fold, lang AS y_class, dim.label AS y, source, n_chars FROM fd JOIN dim ON dim.class = fd.lang)",
        "fti AS (SELECT doc_id AS item_id, fold, model, token, k FROM ft)",
        vectors_sql("fi", "fti", "item_id", "fsc", nb_on="USING (fold, model, token)", pri="fpri", pri_on="pri.fold = i.fold", nb="fnb"),
        pred_sql("fsc", "item_id", "po", "fold"),
    )
)


def metrics_sql(src: str, keys: str, minority: int = 50, k: int = 5, counts: str = "tc") -> str:
    """SELECT of all metrics per keys (a comma list) from prediction rows."""
    few = f"coalesce(c.n, 0) < {minority}" if counts else "false"
    join = f"LEFT JOIN {counts} c ON c.label = x.label" if counts else ""
    return f"""SELECT {keys}, sum(n_true)::BIGINT AS n, sum(tp)::DOUBLE / sum(n_true) AS top1, sum(hits)::DOUBLE / sum(n_true) AS topk,
      avg(tp / n_true::DOUBLE) FILTER (n_true > 0) AS balanced_acc, avg(2 * tp / (n_true + n_pred)::DOUBLE) FILTER (n_true > 0) AS macro_f1,
      CASE WHEN coalesce(sum(n_true) FILTER ({few}), 0) > 0 THEN sum(tp) FILTER ({few})::DOUBLE / sum(n_true) FILTER ({few}) END AS minority_acc,
      avg(tp / n_true::DOUBLE) FILTER (n_true > 0 AND {few}) AS minority_macro, count(*) FILTER (n_true > 0) AS n_classes_present
    FROM (SELECT {keys}, dim.label, count(*) FILTER (y = dim.label) AS n_true, count(*) FILTER (y = dim.label AND pred = dim.label) AS tp,
                 count(*) FILTER (pred = dim.label) AS n_pred, count(*) FILTER (y = dim.label AND rank_true <= {k}) AS hits FROM {src} CROSS JOIN dim GROUP BY {keys}, dim.label) x
    {join} GROUP BY {keys}"""
