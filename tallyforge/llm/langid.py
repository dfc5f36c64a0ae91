"""Language identification with a byte convolutional network, trained in numpy.

The network reads windows of WINDOW bytes: filters of several widths over one-hot bytes, the
maximum of each filter over the window, ReLU, and a softmax layer. A text is cut into windows of
STEP new bytes each (the last one padded with zero bytes), so every byte and every n-gram of the
whole text is read; the class probabilities of its windows are averaged by the bytes they hold.

The training set is a bounded sample: about ``per_lang`` labelled rows of each language, chosen
by the hash of the id, with ``per_row`` windows spread over each text. ``per_lang``, ``per_row``
and the seed are parameters. Only text and language are learnt from, and only text is predicted
from.

Defined results: a NULL text or one without a letter gives ``und`` and score 0; so does every
text if no row is labelled. Repeated rows get the same result each; an empty table gives an empty
result. Of equally probable languages (ties) the first in the alphabet counts; a very long text is read in
windows, all of them. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tallyforge.llm.common import packed, rows_of

WIDTHS = (2, 3, 4)
FILTERS = 16
STEP = 125
WINDOW = STEP + max(WIDTHS) - 1
UNKNOWN = "und"
BLOCK = 64


@dataclass
class ByteNet:
    """``taps[i][k]`` is the 256 x FILTERS table of place k of the filters of width WIDTHS[i]."""

    langs: list[str]
    taps: list[np.ndarray]
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters by byte pair: what bytes (p, p+1) and what bytes (p+2, p+3) add at place p."""
        first = np.concatenate([(t[0][:, None, :] + t[1][None, :, :]).reshape(65536, -1) for t in self.taps], axis=1)
        third = np.repeat(self.taps[1][2], 256, axis=0)
        last = (self.taps[2][2][:, None, :] + self.taps[2][3][None, :, :]).reshape(65536, -1)
        return first, np.concatenate([third, last], axis=1)

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.dense + self.dense_bias
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _pool(first: np.ndarray, second: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Maximum of each filter over each window (n x WINDOW bytes), BLOCK windows at a time."""
    out = np.empty((len(windows), first.shape[1]), np.float32)
    f = FILTERS
    for at in range(0, len(windows), BLOCK):
        w = windows[at : at + BLOCK].astype(np.intp)
        pair = (w[:, :-1] << 8) | w[:, 1:]
        y = np.take(first, pair[:, :STEP], axis=0, mode="clip")
        y[:, :, f:] += np.take(second, pair[:, 2 : 2 + STEP], axis=0, mode="clip")
        y.max(axis=1, out=out[at : at + BLOCK])
    return out


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, number of the text, bytes held) over all texts; an empty text has one window."""
    n = np.array([len(t) for t in texts], dtype=np.int64)
    count = np.maximum(1, -(-n // STEP))
    room = count * STEP + WINDOW - STEP
    base = np.concatenate([[0], np.cumsum(room)])
    buffer = np.zeros(base[-1], np.uint8)
    for b, t in zip(base, texts, strict=False):
        buffer[b : b + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    windows = np.lib.stride_tricks.sliding_window_view(buffer, WINDOW)[base[owner] + place * STEP]
    return windows, owner, np.clip(n[owner] - place * STEP, 1, STEP)


def fit(texts: list[bytes], langs: list[str], epochs: int = 12, rate: float = 0.02, seed: int = 7) -> ByteNet:
    """Train on windows (of at most WINDOW bytes) by Adam on mini-batches; the same rows give the same net."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for i, t in enumerate(texts):
        x[i, : min(len(t), WINDOW)] = np.frombuffer(t[:WINDOW], np.uint8)
    y = np.array([names.index(v) for v in langs])
    total = FILTERS * len(WIDTHS)
    taps = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    net = ByteNet(names, taps, np.zeros(total, np.float32), rng.normal(0, 0.1, (total, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    params = [*net.taps, net.bias, net.dense, net.dense_bias]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at : at + 128]
            b = x[rows]
            best, where = [], []
            for t, w in zip(net.taps, WIDTHS, strict=True):
                a = sum(t[k][b[:, k : k + STEP]] for k in range(w))
                pos = a.argmax(axis=1)
                where.append(pos)
                best.append(np.take_along_axis(a, pos[:, None, :], axis=1)[:, 0])
            hidden = np.concatenate(best, axis=1) + net.bias
            act = np.maximum(hidden, 0)
            p = net.probabilities(hidden - net.bias)
            p[np.arange(len(rows)), y[rows]] -= 1
            p /= len(rows)
            d_hidden = (p @ net.dense.T) * (hidden > 0)
            grads: list[np.ndarray] = []
            for i, w in enumerate(WIDTHS):
                g = np.zeros_like(net.taps[i])
                d = d_hidden[:, i * FILTERS : (i + 1) * FILTERS]
                cols = np.broadcast_to(np.arange(FILTERS), d.shape)
                for k in range(w):
                    np.add.at(g[k], (np.take_along_axis(b, where[i] + k, axis=1), cols), d)
                grads.append(g)
            grads += [d_hidden.sum(axis=0), act.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, a1, a2 in zip(params, grads, m, v, strict=True):
                a1 += 0.1 * (g - a1)
                a2 += 0.01 * (g * g - a2)
                q -= rate * (a1 / (1 - 0.9**step)) / (np.sqrt(a2 / (1 - 0.99**step)) + 1e-8)
    return net


def training_rows(labelled: DataFrame, key: Column, text: Column, lang: Column, per_lang: int = 500, per_row: int = 6) -> DataFrame:
    """(lang, window): about ``per_lang`` rows of each language by hash, ``per_row`` windows of each.

    A row is taken if the hash of its id lies below the share that gives ``per_lang`` rows, so the
    sample is a fixed size for any table and no language is gathered or sorted.
    """
    d = labelled.select(key.alias("key"), text.cast("binary").alias("text"), lang.alias("lang")).where("lang is not null and text is not null")
    # one row per language: the net holds a column for each of them on the driver anyway
    counts = d.groupBy("lang").agg((F.lit(float(per_lang)) / F.count("*")).alias("share")).collect()
    share = F.broadcast(labelled.sparkSession.createDataFrame([(r.lang, r.share) for r in counts], "lang string, share double"))
    u = F.conv(F.substring(F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    taken = d.join(share, "lang").where(u < F.col("share"))
    room = F.greatest(F.octet_length("text") - WINDOW, F.lit(0))
    place = lambda i: (i * room / max(per_row - 1, 1)).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(per_row - 1)), lambda i: F.substring("text", place(i), F.lit(WINDOW)))
    return taken.select("lang", F.explode(F.array_distinct(cut)).alias("window"))


def train(labelled: DataFrame, key: Column, text: Column, lang: Column, per_lang: int = 500, per_row: int = 6, **options) -> ByteNet | None:
    """The net for the languages of ``labelled``; None if no row has both a text and a language."""
    rows = sorted((r["lang"], bytes(r["window"])) for r in training_rows(labelled, key, text, lang, per_lang, per_row).collect())
    return fit([t for _, t in rows], [v for v, _ in rows], **options) if rows else None


def _predict(net: ByteNet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = net.tables()
        for b in rows_of(batches, 512):
            texts = [t or b"" for t in b.column(1).to_pylist()]
            windows, owner, held = windows_of(texts)
            p = net.probabilities(_pool(first, second, windows)) * held[:, None]
            sums = np.zeros((len(texts), len(net.langs)))
            np.add.at(sums, owner, p)
            sums /= np.bincount(owner, held, len(texts))[:, None]
            best = sums.argmax(axis=1)
            known = b.column(2).to_numpy(zero_copy_only=False)
            pred = [net.langs[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            score = np.where(known, np.clip(sums[np.arange(len(texts)), best], 0, 1), 0.0)
            yield pa.record_batch([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["_row", "_pred", "_score"])

    return run


def identify(df: DataFrame, net: ByteNet | None, text_col: str = "text", pred: str = "lang_pred", score: str = "lang_score", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with the predicted language and its probability."""
    text = F.col(text_col)
    columns = [c for c in (df.columns if keep is None else keep) if c not in (pred, score)]
    if net is None:
        return df.select(*columns, F.lit(UNKNOWN).alias(pred), F.lit(0.0).alias(score))
    known = F.coalesce(text.rlike("\\p{L}"), F.lit(False))
    rows, own = packed(df, columns, text.cast("binary"), known)
    out = StructType([StructField("_row", own), StructField("_pred", StringType()), StructField("_score", DoubleType())])
    done = rows.mapInArrow(_predict(net), out)
    return done.select(*[F.col("_row")[c].alias(c) for c in columns], F.col("_pred").alias(pred), F.col("_score").alias(score))


def known_language(docs: DataFrame, net: ByteNet | None, text_col: str = "text", least: float | None = None) -> DataFrame:
    """The rows whose language is known: predicted with a probability of at least ``least``.

    Texts without any letter go; so do those the net cannot tell. Without ``least`` that is a probability
    below 1.2 times that of a guess (0.3 with four languages): short texts are often unsure between
    two languages, and are kept.
    """
    marked = identify(docs, net, text_col, "_lang_pred", "_lang_score")
    bound = least if least is not None else min(1.2 / max(len(net.langs) if net else 1, 1), 0.99)
    return marked.where((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= bound)).select(*docs.columns)
