"""Score tables: a naive-Bayes text scorer, model hooks, prediction columns.

A score table has one row per (model, item) with ``scores``, an array<double> in label order.
Everything that looks at one item is row-local, scoring included; only aggregates over items shuffle.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.bounds import Classes, attach_row, small
from tallyforge.functions.vectors import first_max, let, ordered, rank_of, with_softmax

# Log-probabilities are kept as whole millionths, so sums are exact in any order.
SCALE = 1_000_000
# Fixed value: letters counted as vowels.
VOWELS = "aeiouyàâäáæèéêëíìîïóòôöœúùûü"


def words_of(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` and ``words``: all words of the whole text in lower case (a missing text has none)."""
    found = F.expr(rf"regexp_extract_all(lower(`{text}`), '\\p{{L}}+', 0)")
    return df.select(*keep, F.coalesce(found, F.array().cast("array<string>")).alias("words"))


# Feature models: what a word tells the scorer, as a number.
FEATURES: dict[str, Callable[[Column], Column]] = {
    "lengths": lambda w: F.length(w),
    "finals": lambda w: F.ascii(F.substring(w, -1, 1)),
    "vowels": lambda w: F.length(w) - F.length(F.translate(w, VOWELS, "")),
}
_NO_VOWELS = dict.fromkeys(map(ord, VOWELS))
# The same numbers of a word in Python: a task of ``score_words`` takes them once per distinct word.
FEATURE_OF: dict[str, Callable[[str], int]] = {
    "lengths": len,
    "finals": lambda w: ord(w[-1]) if w else 0,
    "vowels": lambda w: len(w) - len(w.translate(_NO_VOWELS)),
}
TOKEN = "tok_"


def tokens_of(words: DataFrame, models: Sequence[str] = tuple(FEATURES)) -> DataFrame:
    """``words`` replaced by one array of tokens per model (a word that is NULL gives none)."""

    def array(m: str) -> Column:
        return F.transform(F.filter("words", lambda w: w.isNotNull()), lambda w: FEATURES[m](w).cast("bigint"))

    return words.select("*", *[array(m).alias(TOKEN + m) for m in models]).drop("words")


def _models_in(tokens: DataFrame) -> list[str]:
    return [c[len(TOKEN):] for c in tokens.columns if c.startswith(TOKEN)]


@dataclass(frozen=True)
class NaiveBayes:
    """Fitted models: (model, fold) -> sorted tokens and their log-probabilities (tokens x classes) in millionths.

    ``prior`` has the class log-priors by fold. Without folds the fold is 0. A model has one row per
    distinct token (word lengths, letters, vowel counts), small enough to be held by every task.
    """

    tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]
    prior: dict[int, np.ndarray]


# Tokens, and cells of a rows x tokens table, that a task holds at a time.
SLICE = 1 << 20


def _slices(b: pa.RecordBatch, column: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with at most ``size`` (SLICE) tokens in a list column; a longer row is a slice of its own."""
    size = size or SLICE
    ends = np.cumsum(np.diff(b.column(column).offsets.to_numpy()))
    at = 0
    while at < b.num_rows:
        before = int(ends[at - 1]) if at else 0
        end = max(int(np.searchsorted(ends, before + size, "right")), at + 1)
        yield b.slice(at, end - at)
        at = end


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a list column and the number of each row's."""
    n = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), n.astype(np.int64)


def _count_tokens(n_models: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _slices(whole, 2)):
            label, fold = b.column(0).to_numpy(), b.column(1).to_numpy()
            for m in range(n_models):
                token, n = _values(b.column(2 + m))
                names, place = np.unique(token, return_inverse=True)
                kinds, kind = np.unique(np.stack([label, fold]), axis=1, return_inverse=True)
                code, count = np.unique(np.repeat(kind.ravel() * len(names), n) + place, return_counts=True)
                cols = [np.full(len(count), m), *kinds[:, code // max(len(names), 1)], names[code % max(len(names), 1)], count]
                yield pa.record_batch([pa.array(c.astype(np.int64)) for c in cols], names=["m", "label", "fold", "token", "n"])

    return run


def _word_counts(words: DataFrame, models: Sequence[str], fold: Column) -> DataFrame:
    """(m, label, fold, token, n) of a ``words`` column: first counted by all features of a word together."""
    w = words.where("label is not null").select(F.col("label").cast("bigint").alias("label"), fold.alias("fold"), F.explode("words").alias("w")).where("w is not null")
    joint = w.groupBy("label", "fold", *[FEATURES[m](F.col("w")).cast("bigint").alias(TOKEN + m) for m in models]).agg(F.count("*").alias("n"))
    each = F.inline(F.array(*[F.struct(F.lit(i).alias("m"), F.col(TOKEN + m).alias("token")) for i, m in enumerate(models)]))
    return joint.select("label", "fold", "n", each)


def _log_share(n: np.ndarray) -> np.ndarray:
    return np.round(np.log(np.maximum(n, 1) / max(n.sum(), 1)) * SCALE).astype(np.int64)


def nb_fit(tokens: DataFrame, n_classes: int, folds: int = 0) -> NaiveBayes:
    """Laplace-smoothed log-probabilities from token arrays (or ``words``, for all FEATURES) and label[, fold]: an explicit step that runs two jobs.

    Each task counts its rows' tokens before the shuffle. With ``folds`` = k all k out-of-fold models
    (counts outside the fold) come from the same pass.
    """
    models = _models_in(tokens)
    fold = F.col("fold").cast("bigint") if folds else F.lit(0).cast("bigint")
    if "words" in tokens.columns:
        models, d = list(FEATURES), tokens
        counts = _word_counts(tokens, models, fold)
    else:
        d = tokens.where("label is not null").select(F.col("label").cast("bigint").alias("label"), fold.alias("fold"), *[TOKEN + m for m in models])
        counts = d.mapInArrow(_count_tokens(len(models)), "m bigint, label bigint, fold bigint, token bigint, n bigint")
    rows = np.array(counts.groupBy("m", "label", "fold", "token").agg(F.sum("n").alias("n")).collect(), dtype=np.int64).reshape(-1, 5)
    tables = {}
    for i, m in enumerate(models):
        own = rows[rows[:, 0] == i]
        for f in range(max(folds, 1)):
            part = own[own[:, 2] != f] if folds else own
            names, place = np.unique(part[:, 3], return_inverse=True)
            n = np.zeros((len(names), n_classes), np.int64)
            np.add.at(n, (place, part[:, 1]), part[:, 4])
            tables[m, f] = names, np.round(np.log((n + 1) / (n.sum(axis=0) + len(names))) * SCALE).astype(np.int64)
    return NaiveBayes(tables, nb_prior(d, n_classes, folds))


def nb_prior(items: DataFrame, n_classes: int, folds: int = 0) -> dict[int, np.ndarray]:
    """Class log-priors in millionths by fold (items outside the fold; fold 0 without folds)."""
    fold = F.col("fold").cast("bigint") if folds else F.lit(0).cast("bigint")
    rows = items.where("label is not null").groupBy("label", fold.alias("fold")).agg(F.count("*").alias("n")).collect()
    n = np.zeros((max(folds, 1), n_classes), np.int64)
    for r in rows:
        n[r.fold, r.label] += r.n
    return {f: _log_share(n.sum(axis=0) - n[f]) if folds else _log_share(n[0]) for f in range(len(n))}


def _sums(token: np.ndarray, row: np.ndarray, rows: int, names: np.ndarray, lps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the log-probabilities of a row's tokens by class, its known tokens), by counting a row's tokens first.

    Counts and millionths are whole numbers, so the products of the two tables are exact.
    """
    return _sums_at(_places(token, names), row, rows, names, lps)


def _places(token: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Place of each token among the sorted names, -1 if it is none of them."""
    place = np.searchsorted(names, token)
    place[place == len(names)] = -1
    known = place >= 0
    place[known] = np.where(names[place[known]] == token[known], place[known], -1)
    return place


def _sums_at(place: np.ndarray, row: np.ndarray, rows: int, names: np.ndarray, lps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    value, seen = np.zeros((rows, lps.shape[1])), np.zeros(rows, np.int64)
    known = place >= 0
    row, place = row[known], place[known]
    step = max(1, SLICE // max(len(names), 1))
    for low in range(0, rows, step):
        a, b = np.searchsorted(row, [low, low + step])
        n = min(step, rows - low)
        for at in range(a, b, SLICE):
            cell = (row[at : min(at + SLICE, b)] - low) * len(names) + place[at : min(at + SLICE, b)]
            counts = np.bincount(cell, minlength=n * len(names)).reshape(n, len(names))
            value[low : low + n] += counts.astype(float) @ lps.astype(float)
            seen[low : low + n] += counts.sum(axis=1)
    return value, seen


def _score_batches(model: NaiveBayes, models: Sequence[str], with_fold: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _slices(whole, 2)):
            fold = b.column(1).to_numpy().astype(np.int64)
            for k, m in enumerate(models):
                token, n = _values(b.column(2 + k))
                of_token = np.repeat(np.arange(len(n)), n)
                width = len(next(iter(model.prior.values())))
                value, seen = np.zeros((len(n), width)), np.zeros(len(n), np.int64)
                for f in np.unique(fold):
                    own = np.flatnonzero(fold == f)
                    at = slice(None) if len(own) == len(fold) else np.flatnonzero(fold[of_token] == f)
                    rows = of_token[at] if len(own) == len(fold) else np.searchsorted(own, of_token[at])
                    value[own], seen[own] = _sums(token[at], rows, len(own), *model.tables[m, int(f)])
                prior = np.stack([model.prior[int(f)] for f in fold]) if len(fold) else np.zeros((0, width), np.int64)
                score = (prior.astype(float) + value) / SCALE
                scores = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * width), pa.array(score.ravel()))
                name = pa.array([m] * len(n), pa.string())
                cols = [b.column(0), name, *([b.column(1)] if with_fold else []), scores, pa.array(seen)]
                yield pa.record_batch(cols, names=["_row", "model", *(["fold"] if with_fold else []), "scores", "known"])

    return run


def nb_score(tokens: DataFrame, model: NaiveBayes, keys: Sequence[str], folds: int = 0) -> DataFrame:
    """(keys, model[, fold], scores, known) per row and model; ``known`` = tokens the model knew. No shuffle.

    All words of a text count alike: a score is the prior plus the sum over all its tokens.
    """
    models = _models_in(tokens)
    fold = F.col("fold").cast("bigint") if folds else F.lit(0).cast("bigint")
    packed = tokens.select(F.struct(*keys).alias("_row"), fold.alias("_fold"), *[TOKEN + m for m in models])
    fields = [T.StructField("_row", packed.schema["_row"].dataType), T.StructField("model", T.StringType())]
    fields += [T.StructField("fold", T.LongType())] if folds else []
    fields += [T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("known", T.LongType())]
    done = packed.mapInArrow(_score_batches(model, models, bool(folds)), T.StructType(fields))
    extra = [F.col("fold").cast(tokens.schema["fold"].dataType).alias("fold")] if folds else []
    return done.select(*[F.col("_row")[k].alias(k) for k in keys], "model", *extra, "scores", "known")


# Words that a task of ``score_words`` holds at a time, and distinct words whose tokens it remembers.
WORDS = 1 << 18
MEMO = 100_000


def _score_words(model: NaiveBayes, models: Sequence[str], variants: Callable[[str], Sequence[str | None]] | None):
    def tokens(word: str) -> bytes:
        forms = variants(word) if variants else (word,)
        # many forms of a word are alike
        told = {w: array("q", [-1 if w is None else FEATURE_OF[m](w) for m in models]).tobytes() for w in set(forms)}
        return b"".join([told[w] for w in forms])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, forms = len(next(iter(model.prior.values()))), len(tokens("a")) // 8
        memo: dict[str, bytes] = {}
        for b in (part for whole in batches for part in _slices(whole, 2, WORDS)):
            fold = b.column(1).to_numpy().astype(np.int64)
            coded = b.column(2).flatten().dictionary_encode()
            code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), np.diff(b.column(2).offsets.to_numpy()))
            row, code = row[code >= 0], code[code >= 0]
            names = coded.dictionary.to_pylist()
            if len(memo) > MEMO:
                memo = {}
            for w in names:
                if w not in memo:
                    memo[w] = tokens(w)
            told = np.frombuffer(b"".join([memo[w] for w in names]), np.int64).reshape(len(names), forms)
            prior = np.stack([model.prior[int(f)] for f in fold]).astype(float)
            # the words of each fold: its number, rows, and each word's row among them and code
            parts = []
            for f in np.unique(fold):
                own, at = np.flatnonzero(fold == f), fold[row] == f
                parts.append((int(f), own, np.searchsorted(own, row[at]), code[at]))
            for j in range(forms):
                m = models[j % len(models)]
                value, seen = np.zeros((b.num_rows, width)), np.zeros(b.num_rows, np.int64)
                for f, own, rows, codes in parts:
                    known, lps = model.tables[m, f]
                    value[own], seen[own] = _sums_at(_places(told[:, j], known)[codes], rows, len(own), known, lps)
                scores = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * width), pa.array(((prior + value) / SCALE).ravel()))
                cell = pa.array(np.full(b.num_rows, j // len(models)), pa.int32())
                cols = [b.column(0), cell, pa.array([m] * b.num_rows, pa.string()), b.column(1), scores, pa.array(seen)]
                yield pa.record_batch(cols, names=["_row", "cell", "model", "fold", "scores", "known"])

    return run


def score_words(
    words: DataFrame, model: NaiveBayes, keys: Sequence[str], folds: int = 0, variants: Callable[[str], Sequence[str | None]] | None = None
) -> DataFrame:
    """``nb_score`` of a ``words`` column for all FEATURES, without token arrays: (keys[, cell], model[, fold], scores, known).

    Tokens are taken once per distinct word of a slice. With ``variants`` a word is scored in several forms (None: left
    out); ``cell`` is the number of the form and there is one row per form.
    """
    fold = F.col("fold").cast("bigint") if folds else F.lit(0).cast("bigint")
    packed = words.select(F.struct(*keys).alias("_row"), fold.alias("_fold"), "words")
    fields = [T.StructField("_row", packed.schema["_row"].dataType), T.StructField("cell", T.IntegerType()), T.StructField("model", T.StringType())]
    fields += [T.StructField("fold", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("known", T.LongType())]
    done = packed.mapInArrow(_score_words(model, list(FEATURES), variants), T.StructType(fields))
    extra = ["cell"] if variants else []
    own = [F.col("fold").cast(words.schema["fold"].dataType).alias("fold")] if folds else []
    return done.select(*[F.col("_row")[k].alias(k) for k in keys], *extra, "model", *own, "scores", "known")


def batch_score(df: DataFrame, make_fn: Callable[[], Callable], schema: str) -> DataFrame:
    """Apply any Python model in Arrow batches; ``make_fn`` loads it once per task."""

    def run(batches):
        fn = make_fn()
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)


def softmax(scores: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Adds ``probs``."""
    return with_softmax(scores, "scores", "probs", temperature)


def to_long(df: DataFrame, vector: str, value: str, *keep: str) -> DataFrame:
    """One row per (row, class label) of a vector column."""
    return df.select(*keep, F.posexplode(vector).alias("label", value))


def prior_vector(log_priors: DataFrame) -> DataFrame:
    """One row with the log-priors in label order, from a class-sized table."""
    pairs = F.array_sort(F.collect_list(F.struct("label", "log_prior")))
    return log_priors.agg(F.transform(pairs, lambda p: p["log_prior"]).alias("log_priors"))


def logit_adjust(scores: DataFrame, log_priors: DataFrame, tau: float | Sequence[float]) -> DataFrame:
    """scores - tau * log_prior; several taus give one row per tau, in one job."""
    taus = [tau] if isinstance(tau, int | float) else list(tau)
    d = attach_row(scores, prior_vector(log_priors))
    d = d.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus])))
    adjusted = F.transform("scores", lambda s, i: s - F.col("tau") * F.get("log_priors", i))
    return d.withColumn("scores", adjusted).drop("log_priors")


def predict(scores: DataFrame, vector: str = "scores") -> DataFrame:
    """Adds probs, pred, p1, runner_up, p2, margin, p_true, rank_true and correct. No shuffle."""
    d = with_softmax(scores, vector, "probs") if vector == "scores" else scores.withColumn("probs", F.col(vector))
    d = d.withColumn("_best", F.slice(ordered(F.col(vector)), 1, 2)).withColumn("pred", first_max(F.col(vector)))
    second = F.get("_best", F.lit(1))["label"]
    d = d.withColumn("runner_up", second).withColumn("p1", F.get("probs", F.col("pred"))).withColumn("p2", F.get("probs", second))
    d = d.withColumn("margin", F.col("p1") - F.col("p2")).drop("_best")
    if "y" in scores.columns:
        d = d.withColumn("p_true", F.get("probs", F.col("y"))).withColumn("rank_true", rank_of(F.col(vector), F.col("y")))
        d = d.withColumn("correct", F.col("pred") == F.col("y"))
    return d


def predict_topk(scores: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """The k best (rank, label, prob) per item."""
    d = with_softmax(scores).withColumn("_o", F.slice(ordered(F.col("scores")), 1, k))
    rows = d.select(*keys, "probs", F.posexplode("_o").alias("rank", "_c"))
    return rows.select(*keys, (F.col("rank") + 1).alias("rank"), F.col("_c.label").alias("label"), F.get("probs", F.col("_c.label")).alias("prob"))


def named(label: Column, classes: Classes) -> Column:
    """Class name of a label."""
    return F.get(F.array(*[F.lit(c) for c in classes.require_names()]), label)


def soft_targets(scores: DataFrame, keys: Sequence[str], width: int, temperature: float = 4.0) -> DataFrame:
    """Distillation targets: mean over teachers of softmax(scores / T)."""
    from tallyforge.operators.ensemble import mean_over

    return mean_over(with_softmax(scores, "scores", "probs", temperature), keys, "model", "probs", width)


def loss_table(
    scores: DataFrame, by: Sequence[str], weights: DataFrame, rows: int | None, smoothing: float = 0.1, gamma: float = 2.0
) -> DataFrame:
    """Mean cross entropy, its smoothed and weighted forms, focal and class-balanced focal loss.

    ``weights`` is class-sized: label, weight (inverse frequency) and cb_weight.
    """
    total = lambda v, m: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - m))
    lse = let(F.col("scores"), lambda v: let(F.array_max(v), lambda m: F.log(total(v, m)) + m))
    d = scores.withColumn("_lse", lse)
    d = d.withColumn("ce", F.col("_lse") - F.get("scores", F.col("y")))
    mean_all = F.col("_lse") - F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / F.size("scores")
    d = d.withColumn("smooth", (1 - F.lit(smoothing)) * F.col("ce") + F.lit(smoothing) * mean_all)
    d = d.withColumn("focal", F.pow(1 - F.exp(-F.col("ce")), F.lit(float(gamma))) * F.col("ce"))
    w = small(weights.select(F.col("label").alias("y"), "weight", "cb_weight"), rows)
    d = d.join(w, "y")
    return d.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("ce").alias("ce"),
        F.avg("smooth").alias("ce_smooth"),
        (F.sum(F.col("weight") * F.col("ce")) / F.sum("weight")).alias("ce_weighted"),
        F.avg("focal").alias("focal"),
        F.avg(F.col("cb_weight") * F.col("focal")).alias("cb_focal"),
    )
