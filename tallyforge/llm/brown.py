"""Class-based bigram scoring (Brown clusters found by exchange).

A text is scored as the product of class transitions and word emissions:
``P(class | class before) * P(word | class)``. Every word of the training texts has a class of its own finding:

* Exchange: a *type* is a word that makes up at least 1 / TYPE_SHARE of the training tokens, or an ending:
  rarer words rest, while the classes are formed, in the class of their last three characters, of rare endings in that of
  their last two, the others together. Each round computes, from the bigram counts of all training texts, how
  often each type follows and precedes each class, and moves types to the class with the largest gain in
  likelihood. The types are spread over tasks; a task moves its types one after the other. Every
  other type rests in a round, so that tasks do not undo each other's moves.
* The rarer words then leave their endings: the classes before and after each of their places are gathered by word, and
  each word, also one that is seen once, moves by the same gain, with its own counts taken out of where it rested. This is
  one round for all of them, spread over tasks by word; a word's tokens there are below 1 / TYPE_SHARE of all.
* Then the class pairs are counted anew over all training texts, so transitions and emissions belong to the classes found.

The shares bound what tasks hold (no more than TYPE_SHARE words can be that frequent, and the same holds for
each kind of ending): words with at least 1 / NEAR_SHARE of the tokens are looked up in the tasks; count and class of any
other word come by a shuffle, so the vocabulary may grow without limit and no word is left out. Texts are cut into words in
chunks; a chunk lists each of its other words once and its places name them by number, so one row per word and chunk, not
per place, goes to the word's task and comes back with count and class.

Defined results: a NULL text counts as empty, which is one token, the end; a training set without
rows gives a uniform model of one unknown word; a word never seen in training counts as the unseen word of the class in which
its ending took part in the exchange; of classes with equal gains (ties) a word stays where it is, else the
lowest number counts; a very long text is read whole by one task; NULL ids count as the empty text for the choice of
training rows; repeated rows are scored each; an empty table gives an empty result. Only the id
and the text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.bounds import arrow_batches, settle, settled_tables, shuffles_dropped
from tallyforge.llm.common import LOWER, rows_of

TYPE_SHARE = 50_000
NEAR_SHARE = 400_000
CLASSES = 96
ROUNDS = 8
DELTA = 0.1
END = b""
FLUSH = 500_000
# Bytes of the numbers of a chunk of texts (2 or 4 a word); words whose class is chosen at a time; words of chunks that are
# sent back at a time.
CHUNK = 6 << 20
GROUP = 512
PLACES = 1 << 20
# Bytes that Python gets at a time: rows of chunks are large.
BATCH = 32 << 20


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text.translate(LOWER).split() if text else ()), END]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(c: Counter) -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    c: Counter = Counter()
    for b in rows_of(batches, 256):
        for t in b.column(0).to_pylist():
            c.update(tokens(t))
        if len(c) > FLUSH:
            yield out(c)
            c = Counter()
    yield out(c)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``texts`` (one binary column); the end is the empty word."""
    return texts.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: bytes, size: int) -> bytes:
    tail = word[-4 * size :]
    return tail[-size:] if tail.isascii() else tail.decode("utf-8", "ignore")[-size:].encode()


@dataclass
class Types:
    """The types: ``words`` and the endings ``by3``, ``by2`` and ``rest`` name positions of ``count``.

    ``inside`` is the number of different words that an ending stands for (1 for a word).
    """

    words: dict[bytes, int]
    by3: dict[bytes, int]
    by2: dict[bytes, int]
    rest: int
    count: np.ndarray
    inside: np.ndarray

    def of(self, word: bytes) -> int:
        t = self.words.get(word)
        if t is None:
            t = self.by3.get(ending(word, 3))
        if t is None:
            t = self.by2.get(ending(word, 2))
        return self.rest if t is None else t


def find_types(vocab: DataFrame, total: int) -> Types:
    least = max(1, math.ceil(total / TYPE_SHARE))
    words = sorted((-r.n, bytes(r.word)) for r in vocab.where((F.col("n") >= least) | (F.octet_length("word") == 0)).collect())
    rare = vocab.where((F.col("n") < least) & (F.octet_length("word") > 0)).select("n", F.col("word").cast("string").alias("w"))
    rare = rare.select("n", F.right("w", F.lit(3)).alias("e3"), F.right("w", F.lit(2)).alias("e2"))
    # one pass: sums by both endings; the endings of two characters without those three that are types
    sums = settle(rare.groupBy("e2", "e3").agg(F.sum("n").alias("n"), F.count("*").alias("words")), "endings")
    three = sums.groupBy("e3").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).where(F.col("n") >= least)
    left = sums.join(F.broadcast(three.select("e3")), "e3", "left_anti")
    two = left.groupBy("e2").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).where(F.col("n") >= least)
    rest = left.join(F.broadcast(two.select("e2")), "e2", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    by3, by2 = (sorted((r[0].encode(), r.n, r.words) for r in x.collect()) for x in (three, two))
    count = [-n for n, _ in words] + [n for _, n, _ in by3 + by2] + [rest[0]]
    inside = [1] * len(words) + [k for _, _, k in by3 + by2] + [rest[1]]
    at2 = len(words) + len(by3)
    return Types(
        {w: i for i, (_, w) in enumerate(words)},
        {e: len(words) + i for i, (e, _, _) in enumerate(by3)},
        {e: at2 + i for i, (e, _, _) in enumerate(by2)},
        len(count) - 1,
        np.array(count, dtype=np.int64),
        np.array(inside, dtype=np.int64),
    )


def _sums(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(code, return_inverse=True)
    return keys, np.bincount(where, n, len(keys)).astype(np.int64)


@dataclass
class Lookup:
    """Words as numbers: those of ``near`` have their place, any other word len(near) + its ending's place.

    ``kind`` is the type of each number; the end is the empty word of ``near``.
    """

    types: Types
    near: list[bytes]
    count: np.ndarray  # how often each near word occurs
    kind: np.ndarray
    tokens: int  # N
    distinct: int  # V

    @property
    def end(self) -> int:
        return self.near.index(END)

    @property
    def dtype(self) -> type:
        return np.uint16 if len(self.kind) <= 1 << 16 else np.int32


def find_words(vocab: DataFrame) -> Lookup:
    total, distinct = vocab.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    types = find_types(vocab, total)
    if END not in types.words:  # no training row
        types = Types({END: 0}, {}, {}, 1, np.array([0, 0]), np.array([1, 0]))
    near = {bytes(r.word): r.n for r in vocab.where((F.col("n") >= near_least(total)) | (F.octet_length("word") == 0)).collect()} or {END: 0}
    words = sorted(near)
    kind = [types.of(w) for w in words] + list(range(len(types.words), len(types.count)))
    return Lookup(types, words, np.array([near[w] for w in words], dtype=np.int64), np.array(kind, dtype=np.int64), total, distinct)


def near_least(total: int) -> int:
    return max(1, math.ceil(total / NEAR_SHARE))


class Numbers(dict):
    """Number of each word of a chunk: near ones have their place, any other len(near) + its place in ``far``, where it goes when first met."""

    def __init__(self, near: list[bytes]):
        super().__init__(zip(near, range(len(near)), strict=True))
        self.near, self.far = len(near), []

    def __missing__(self, word: bytes) -> int:
        k = self[word] = self.near + len(self.far)
        self.far.append(word)
        return k


class Chunk:
    """Texts on their way to one row of ``encode``."""

    def __init__(self, look: Lookup, train: bool):
        self.look, self.train = look, train
        self.gap = np.array([look.end], dtype=np.int32)
        self.clear()

    def clear(self) -> None:
        self.number = Numbers(self.look.near)
        self.ids: list[pa.Array] = []
        self.path = [self.gap]
        self.sizes: list[int] = []
        self.bytes = 0

    def add(self, ids: pa.Array, texts: list[bytes | None]) -> None:
        of = self.number.__getitem__
        self.ids.append(ids)
        for t in texts:
            words = t.translate(LOWER).split() if t else []
            self.path += (np.fromiter(map(of, words), np.int32, len(words)), self.gap)
            self.sizes.append(len(words) + 1)
            self.bytes += np.dtype(self.look.dtype).itemsize * len(words)

    def row(self) -> pa.RecordBatch:
        near, types, far = len(self.look.near), self.look.types, self.number.far
        path = np.concatenate(self.path)
        code = np.arange(near + len(far))
        code[near:] = [types.of(w) for w in far]
        code[near:] += near - len(types.words)
        ids = pa.concat_arrays(self.ids)
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([self.train])]
        told = [np.array(self.sizes, dtype=np.int32), code.astype(self.look.dtype)[path], path[path >= near] - near]
        arrays += [pa.array([x], pa.binary()) for x in (*(x.tobytes() for x in told), b" ".join(far))]
        self.clear()
        return pa.record_batch(arrays, names=["doc_id", "train", "sizes", "seq", "far", "words"])


def _encode(look: Lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = [Chunk(look, True), Chunk(look, False)]
        for b in rows_of(batches, 64):
            train = pc.fill_null(b.column(1), False)
            for chunk in chunks:
                rows = b.filter(pc.equal(train, chunk.train))
                chunk.add(rows.column(0), rows.column(2).to_pylist())
                if chunk.bytes >= CHUNK:
                    yield chunk.row()
        yield from (chunk.row() for chunk in chunks if chunk.sizes)

    return run


def encode(docs: DataFrame, look: Lookup) -> DataFrame:
    """The rows of ``docs`` (doc_id, train, text) in chunks, those of training and others apart; settled. Per chunk:

    (chunk, doc_id: ids of its texts, train, sizes: tokens of each, seq: the numbers of all words, an end before, between and
    after the texts, words: each word not near, once, far: the place in ``words`` of each such place of ``seq``, in order).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    done = docs.mapInArrow(_encode(look), f"doc_id array<{kind}>, train boolean, sizes binary, seq binary, far binary, words binary")
    return settle(done.withColumn("chunk", F.monotonically_increasing_id()), "encoded")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Scalar]]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(name)[i] for name in b.schema.names}


def _array(x: pa.Scalar | bytes, dtype: type) -> np.ndarray:
    x = x.as_py() if isinstance(x, pa.Scalar) else x
    return np.frombuffer(x, dtype=dtype) if x else np.zeros(0, dtype)


def _sums(code: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(code, return_inverse=True)
    return keys, np.bincount(where, n, len(keys)).astype(np.int64)


def _pairs(look: Lookup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(look.types.count)
        for row in _rows(batches):
            a = look.kind[_array(row["seq"], look.dtype)]
            code, n = np.unique(a[:-1] * size + a[1:], return_counts=True)
            yield pa.record_batch([pa.array(code), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return run


def type_pairs(encoded: DataFrame, look: Lookup) -> DataFrame:
    """(pair, n): how often type ``pair % size`` follows type ``pair // size``, over all texts; an end precedes each first word."""
    return encoded.select("seq").mapInArrow(_pairs(look), "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def _profiles(cls: np.ndarray, classes: int):
    """Pairs to (type, slot, n): slot c is 'after class c', slot classes + c 'before class c', the last one 'after itself'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, slots = len(cls), 2 * classes + 1
        for b in batches:
            pair, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            u, v = pair // size, pair % size
            same = u == v
            code = np.concatenate([v * slots + cls[u], u * slots + classes + cls[v], u[same] * slots + 2 * classes])
            keys, total = _sums(code, np.concatenate([n, n, n[same]]))
            yield pa.record_batch([pa.array(keys // slots), pa.array(keys % slots), pa.array(total)], names=["type", "slot", "n"])

    return run


def _class_cells(cls: np.ndarray, classes: int):
    """Profile rows to the class pair counts they hold: those of slots 'before class y'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for b in batches:
            kind, slot, n = (b.column(i).to_numpy() for i in range(3))
            own = (slot >= classes) & (slot < 2 * classes)
            np.add.at(total, cls[kind[own]] * classes + slot[own] - classes, n[own])
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


def class_profile(pairs: DataFrame, cls: np.ndarray, classes: int) -> tuple[DataFrame, np.ndarray]:
    """(profile of every type, class pair counts) under the classes ``cls``, by one pass over the pairs."""
    profile = pairs.mapInArrow(_profiles(cls, classes), "type bigint, slot bigint, n bigint").groupBy("type", "slot").agg(F.sum("n").alias("n"))
    profile = settle(profile, "profile")
    m = np.zeros(classes * classes)
    for r in profile.mapInArrow(_class_cells(cls, classes), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        m[r.cell] = r.n
    return profile, m.reshape(classes, classes)


def best_class(c: np.ndarray, own: int, left: np.ndarray, right: np.ndarray, self_n: float) -> int:
    """The class with the largest likelihood for one type; ``c`` (class pair counts) is changed to it.

    ``left[x]``: how often the type follows class x; ``right[y]``: how often class y follows it.
    """
    left, right = left.copy(), right.copy()
    left[own] -= self_n
    right[own] -= self_n
    c[:, own] -= left
    c[own, :] -= right
    c[own, own] -= self_n
    f = _xlogx(c)
    # how often each class precedes and follows, the pairs with this type's neighbours included
    before, after = c.sum(axis=1) + left, c.sum(axis=0) + right
    n_left, n_right = left.sum() + self_n, right.sum() + self_n
    cols = _xlogx(c + left[:, None]) - f
    rows = _xlogx(c + right[None, :]) - f
    d = np.arange(len(c))
    corner = _xlogx(c[d, d] + left + right + self_n) - f[d, d]
    gain = cols.sum(axis=0) - cols[d, d] + rows.sum(axis=1) - rows[d, d] + corner
    gain -= _xlogx(before + n_right) - _xlogx(before) + _xlogx(after + n_left) - _xlogx(after)
    gain[0] = -np.inf  # class 0 is the end's alone
    # a move must be worth more than rounding
    best = int(gain.argmax()) if gain.max() > gain[own] + 1e-6 else own
    c[:, best] += left
    c[best, :] += right
    c[best, best] += self_n
    return best


def _exchange(cls: np.ndarray, matrix: np.ndarray, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = len(matrix)
        cols = [np.concatenate(x) for x in zip(*[[b.column(i).to_numpy() for i in range(3)] for b in batches], strict=True)]
        if not cols:
            return
        kinds, where = np.unique(cols[0], return_inverse=True)
        table = np.zeros((len(kinds), 2 * classes + 1))
        table[where, cols[1]] = cols[2]
        c = matrix.copy()
        moved = [(int(t), best_class(c, int(cls[t]), row[:classes], row[classes:-1], row[-1])) for t, row in zip(kinds, table, strict=True) if cls[t] and (t + turn) % 2]
        yield pa.record_batch([pa.array([t for t, _ in moved], pa.int64()), pa.array([k for _, k in moved], pa.int64())], names=["type", "cls"])

    return run


def exchange(pairs: DataFrame, types: Types, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(class of each type, class pair counts) after ``rounds`` rounds; the end alone is class 0.

    A task of a round holds the profiles of about 500 types (2 x classes + 1 numbers each).
    """
    size = len(types.count)
    classes = max(2, min(classes, size))
    order = np.argsort(-types.count, kind="stable")
    cls = np.empty(size, np.int64)
    cls[order] = 1 + np.arange(size) % (classes - 1)
    cls[types.words[END]] = 0
    for turn in range(rounds):
        with settled_tables(pairs.sparkSession):
            profile, matrix = class_profile(pairs, cls, classes)
            dealt = profile.repartition(max(1, size // 500), "type").sortWithinPartitions("type", "slot")
            for r in dealt.mapInArrow(_exchange(cls, matrix, turn), "type bigint, cls bigint").collect():
                cls[r.type] = r.cls
    with settled_tables(pairs.sparkSession):
        return cls, class_profile(pairs, cls, classes)[1]


class Gains:
    """``best_class`` of many words, each against the same class pair counts ``c``, which stay as they are.

    Only the row and the column of a word's own class lose its counts, so for most cells the gain is that of ``c``, from
    tables for small counts; the cells of the own class and of the diagonal are put right afterwards.
    """

    LEVELS = 16

    def __init__(self, c: np.ndarray):
        self.sides = [(x, _xlogx(x), self._table(x)) for x in (np.ascontiguousarray(c), np.ascontiguousarray(c.T))]
        self.diagonal = c.diagonal().copy()
        self.sums = c.sum(axis=1), c.sum(axis=0)

    def _table(self, c: np.ndarray) -> np.ndarray:
        f = _xlogx(c)
        return np.concatenate([_xlogx(c + n) - f for n in range(1, self.LEVELS + 1)])

    def _added(self, side: int, own: np.ndarray, here: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Sum over the classes x != k of what ``here[x]`` adds to the cell (x, k), for each word and k."""
        c, f, table = self.sides[side]
        gain = np.zeros(here.shape)
        i, x = np.nonzero(here)
        if not len(i):
            return gain
        n = here[i, x]
        level = np.minimum(n, self.LEVELS + 1).astype(np.int64)
        # counts that many words have: as a product of matrices; the others one by one
        times = np.bincount(level, minlength=self.LEVELS + 2)
        often = times > 2 * len(own)
        often[-1] = False
        for k in np.flatnonzero(often):
            gain += (here == k).astype(float) @ table[(k - 1) * len(c) : k * len(c)]
        few = np.flatnonzero(~often[level])
        if len(few):
            i1, x1, n1 = i[few], x[few], n[few]
            rows = table[np.minimum(level[few], self.LEVELS) * len(c) - len(c) + x1]
            many = np.flatnonzero(n1 > self.LEVELS)
            rows[many] = _xlogx(c[x1[many]] + n1[many, None]) - f[x1[many]]
            first = np.flatnonzero(np.diff(i1, prepend=-1))
            gain[i1[first]] += np.add.reduceat(rows, first)
        gain[i, x] -= _xlogx(c[x, x] + n) - f[x, x]
        at = np.flatnonzero(here[np.arange(len(own)), own])
        o, k = own[at], here[at, own[at]][:, None]
        rest = c[o] - other[at]
        gain[at] += _xlogx(rest + k) - _xlogx(rest) - _xlogx(c[o] + k) + f[o]
        # in the own class: what the word's own counts add to the cells without them
        o = own[i]
        stay = np.where(x == o, 0.0, f[x, o] - _xlogx(c[x, o] - n))
        gain[np.arange(len(own)), own] = np.bincount(i, stay, len(own))
        return gain

    @staticmethod
    def _margin(sums: np.ndarray, own: np.ndarray, n: np.ndarray) -> np.ndarray:
        values, at = np.unique(n, return_inverse=True)
        out = (_xlogx(sums + values[:, None]) - _xlogx(sums))[at]
        out[np.arange(len(own)), own] = _xlogx(sums[own]) - _xlogx(sums[own] - n)
        return out

    def best(self, own: np.ndarray, left: np.ndarray, right: np.ndarray, self_n: np.ndarray) -> np.ndarray:
        w, d = np.arange(len(own)), self.diagonal
        left, right = left.astype(float), right.astype(float)
        left[w, own] -= self_n
        right[w, own] -= self_n
        gain = self._added(0, own, left, right) + self._added(1, own, right, left)
        corner = left + right + self_n[:, None]
        i, x = np.nonzero(corner)
        inside = x == own[i]
        n, cell = corner[i, x], d[x]
        gain[i, x] += np.where(inside, _xlogx(cell) - _xlogx(cell - n), _xlogx(cell + n) - _xlogx(cell))
        gain -= self._margin(self.sums[0], own, right.sum(axis=1) + self_n) + self._margin(self.sums[1], own, left.sum(axis=1) + self_n)
        gain[:, 0] = -np.inf
        top = gain >= gain.max(axis=1, keepdims=True) - 1e-6
        return np.where(top[w, own], own, top.argmax(axis=1))


def best_classes(c: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray, self_n: np.ndarray) -> np.ndarray:
    """``best_class`` of many words, one per row of ``left`` and ``right``, each against the same ``c``."""
    return Gains(c).best(own, left, right, self_n)


def _contexts(look: Lookup, cls: np.ndarray, classes: int):
    """Chunks to (word, own, around, again, chunk, at), a row per chunk for each of its words that is no type: its class so far,
    the classes around its places (uint16: before * classes + after), how often it follows itself, and where the chunk lists it
    (-1: a near word, not listed). Of a chunk that is not of training only the listed words count, without places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(look.near)
        near = pa.array(look.near, pa.binary())
        class_of = cls[look.kind]
        rare = look.kind >= len(look.types.words)
        for row in _rows(batches):
            seq, train = _array(row["seq"], look.dtype), row["train"].as_py()
            c = class_of[seq]
            at = np.flatnonzero(rare[seq] if train else seq >= size)
            if not len(at):
                continue
            key = seq[at].astype(np.int64)
            key[key >= size] = size + _array(row["far"], np.int32)
            same = np.zeros(len(at), np.int64)
            same[1:] = (key[1:] == key[:-1]) & (at[1:] == at[:-1] + 1)
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            found = key[first]
            words = pa.concat_arrays([near, pa.array(row["words"].as_py().split(), pa.binary())]).take(pa.array(found))
            own = c[at][order][first].astype(np.int32)
            again = np.add.reduceat(same[order], first) if train else np.zeros(len(first), np.int64)
            around = (c[at - 1] * classes + c[at + 1])[order].astype(np.uint16)
            places = (np.append(first, len(key)) if train else np.zeros(len(first) + 1)).astype(np.int32) * 2
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(places), pa.py_buffer(around)])
            chunk = np.full(len(first), row["chunk"].as_py(), dtype=np.int64)
            listed = np.maximum(found - size, -1).astype(np.int32)
            arrays = [words, pa.array(own), packed, pa.array(again), pa.array(chunk), pa.array(listed)]
            yield pa.record_batch(arrays, names=["word", "own", "around", "again", "chunk", "at"])

    return run


def _choose(matrix: np.ndarray):
    """Rows of ``_contexts``, those of a word together, to (word, n, cls, chunks, at): the lists tell where chunks list it."""
    classes = len(matrix)
    gains: list[Gains] = []

    def chosen(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        if not rows.num_rows:
            return
        words = rows.column("word").combine_chunks().dictionary_encode()
        at = words.indices.to_numpy()
        first = np.flatnonzero(np.diff(at, prepend=-1))
        own = rows.column("own").to_numpy()[first].astype(np.int64)
        again = np.add.reduceat(rows.column("again").to_numpy(), first)
        around = rows.column("around").to_pylist()
        chunk, listed = rows.column("chunk").to_numpy(), rows.column("at").to_numpy()
        ends = np.append(first, len(at))
        for k in range(0, len(first), GROUP):
            e = ends[k : k + GROUP + 1]
            m = len(e) - 1
            here = around[e[0] : e[-1]]
            word = np.repeat(at[e[0] : e[-1]] - k, [len(x) // 2 for x in here])
            code = np.frombuffer(b"".join(here), dtype=np.uint16)
            left = np.bincount(word * classes + code // classes, minlength=m * classes).reshape(m, classes)
            right = np.bincount(word * classes + code % classes, minlength=m * classes).reshape(m, classes)
            best = gains[0].best(own[k : k + m], left, right, again[k : k + m].astype(float))
            n = left.sum(axis=1)
            known = n > 0  # a word of other texts only is not
            near = np.arange(e[0], e[-1])
            of = at[near] - k
            near, of = (x[known[of] & (listed[near] >= 0)] for x in (near, of))
            lists = pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=m)[known])).astype(np.int32))
            arrays = [words.dictionary.slice(k, m).filter(pa.array(known)), pa.array(n[known]), pa.array(best[known].astype(np.int32))]
            arrays += [pa.ListArray.from_arrays(lists, pa.array(x[near])) for x in (chunk, listed)]
            yield pa.record_batch(arrays, names=["word", "n", "cls", "chunks", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains.append(Gains(matrix))
        held: list[pa.RecordBatch] = []
        for b in batches:
            w = b.column("word")
            last = pc.index(pc.equal(w, w[-1]), True).as_py() if b.num_rows else 0
            if b.num_rows and (last or (held and held[-1].column("word")[-1] != w[-1])):
                yield from chosen(pa.Table.from_batches([*held, b.slice(0, last)]))
                held = []
            held.append(b.slice(last))
        if held:
            yield from chosen(pa.Table.from_batches(held))

    return run


def rare_classes(encoded: DataFrame, look: Lookup, cls: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """(word, n, cls, chunks, at) of every word of the training texts that is no type: its count, the class it moves to and, if it
    is not near, its place in the words of each chunk, of training or not; settled."""
    if len(matrix) > 256:
        raise ValueError("at most 256 classes")
    kind = "word binary, own int, around binary, again bigint, chunk bigint, at int"
    around = encoded.select("chunk", "train", "seq", "far", "words").mapInArrow(_contexts(look, cls, len(matrix)), kind)
    dealt = around.repartition("word").sortWithinPartitions("word")
    return settle(dealt.mapInArrow(_choose(matrix), "word binary, n bigint, cls int, chunks array<bigint>, at array<int>"), "classes")


@dataclass
class Classes:
    """Class of each type and of each number of ``look`` (that of an ending: of unseen words)."""

    look: Lookup
    of_type: np.ndarray
    of_code: np.ndarray


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row in _rows(batches):
        words = row["words"].as_py().split()
        arrays = [pa.array(words, pa.binary()), pa.array(np.full(len(words), row["chunk"].as_py(), dtype=np.int64)), pa.array(np.arange(len(words), dtype=np.int32))]
        yield pa.record_batch(arrays, names=["word", "chunk", "at"])


def located(encoded: DataFrame, vocab: DataFrame) -> DataFrame:
    """(word, n, cls, chunks, at) of the words of ``vocab`` for chunks that were not there when it was made: one row per word and chunk."""
    listed = encoded.select("chunk", "words").mapInArrow(_listed, "word binary, chunk bigint, at int")
    return listed.join(vocab.select("word", "n", "cls"), "word").select("word", "n", "cls", F.array("chunk").alias("chunks"), F.array("at").alias("at"))


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, cls, chunks, at) to (chunk, at, told): places in the chunk's words (int32) and n * 256 + cls of each (int64), about PLACES at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def out() -> pa.RecordBatch:
        chunk, at, told = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(chunk, kind="stable")
        keys, first = np.unique(chunk[order], return_index=True)
        ends = np.append(first, len(order)).astype(np.int32)
        packed = [pa.BinaryArray.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x[order])]) for x in (at, told)]
        return pa.record_batch([pa.array(keys), *packed], names=["chunk", "at", "told"])

    for b in batches:
        told = b.column("n").to_numpy() * 256 + b.column("cls").to_numpy()
        times = pc.list_value_length(b.column("at")).to_numpy()
        chunk, at = (b.column(x).flatten().to_numpy() for x in ("chunks", "at"))
        held.append((chunk, at, np.repeat(told, times)))
        size += len(at)
        if size >= PLACES:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def _classed(known: Classes):
    """Chunks with what is told of their words to the rows of ``classed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = known.look
        for row in _rows(batches):
            seq, far = _array(row["seq"], look.dtype), _array(row["far"], np.int32)
            of = np.full(far.max(initial=-1) + 1, -1, dtype=np.int64)
            for x in row["told"].as_py() or ():
                of[_array(x["at"], np.int32)] = _array(x["told"], np.int64)
            told = of[far]
            c = known.of_code[seq]
            n = np.zeros(len(seq), np.int64)
            inside = seq < len(look.near)
            n[inside] = look.count[seq[inside]]
            n[~inside] = np.maximum(told, 0) >> 8
            c[~inside] = np.where(told >= 0, told & 255, c[~inside])
            size = _array(row["sizes"], np.int32).astype(np.int64)
            first = np.cumsum(size) - size + 1
            path = c.astype(np.uint8).tobytes()
            arrays = [
                row["doc_id"].values,
                pa.repeat(row["train"], len(size)),
                pa.array(size),
                pa.array(np.add.reduceat((n > 0).astype(np.int64), first)),
                pa.array(np.add.reduceat(np.log10(n + DELTA), first)),
                pa.array([path[i - 1 : i + k] for i, k in zip(first.tolist(), size.tolist(), strict=True)], pa.binary()),
            ]
            yield pa.record_batch(arrays, names=["doc_id", "train", "n_tokens", "n_known", "logs", "path"])

    return run


def classed(encoded: DataFrame, known: Classes, words: DataFrame, owned: bool = True) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, logs, path) per text; settled.

    ``logs``: sum of log10(count + DELTA); ``path``: the classes (uint8) of the end before the text, its words and its end.
    Words that are not near get count and class from ``words`` (n, cls, chunks, at), which names their chunks: each chunk
    gets what its words need, packed.
    """
    kind = encoded.schema["doc_id"].dataType.elementType.simpleString()
    told = words.select("n", "cls", "chunks", "at").mapInArrow(_told, "chunk bigint, at binary, told binary")
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("at", "told")).alias("told"))
    rows = encoded.drop("words").join(told, "chunk", "left")
    kind = f"doc_id {kind}, train boolean, n_tokens bigint, n_known bigint, logs double, path binary"
    return settle(rows.mapInArrow(_classed(known), kind), "classed", owned)


def _path_pairs(classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for b in rows_of(batches, 512):
            for p in b.column(0).to_pylist():
                c = np.frombuffer(p, dtype=np.uint8).astype(np.int64)
                total += np.bincount(c[:-1] * classes + c[1:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    return run


@dataclass
class BrownModel:
    """What a task needs to score: everything is as large as the tables of types and near words."""

    known: Classes
    step: np.ndarray  # log10 P(class | class before)
    norm: np.ndarray  # log10 of the mass of each class, its unseen word included

    @property
    def types(self) -> Types:
        return self.known.look.types

    @property
    def cls(self) -> np.ndarray:
        return self.known.of_type

    @property
    def emit(self) -> np.ndarray:
        """log10 P(word | class) of the types that are words; of an ending: that of the unseen word of its class."""
        count = np.where(np.arange(len(self.cls)) < len(self.types.words), self.types.count, 0)
        return np.log10(count + DELTA) - self.norm[self.cls]

    @property
    def tokens(self) -> int:
        return self.known.look.tokens


def find_classes(encoded: DataFrame, look: Lookup, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Classes, DataFrame, np.ndarray]:
    """Classes of all words of the training texts, the table of ``rare_classes`` of those that are no types, and log10 of the classes' masses."""
    with settled_tables(encoded.sparkSession):
        pairs = settle(type_pairs(encoded.where("train"), look), "type-pairs")
        cls, matrix = exchange(pairs, look.types, classes, rounds)
    k = len(matrix)
    vocab = rare_classes(encoded, look, cls, matrix)
    of_code = cls[look.kind]
    place = {w: i for i, w in enumerate(look.near)}
    for r in vocab.where(F.col("n") >= near_least(look.tokens)).collect():
        of_code[place[bytes(r.word)]] = r.cls
    own = np.arange(len(look.types.words))
    mass = np.bincount(cls[own], look.types.count[own], k)
    inside = np.bincount(cls[own], minlength=k).astype(float)
    for r in vocab.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect():
        mass[r.cls] += r.n
        inside[r.cls] += r.words
    return Classes(look, cls, of_code), vocab, np.log10(mass + DELTA * (inside + 1))


def find_steps(paths: DataFrame, total: int, classes: int) -> np.ndarray:
    """log10 P(class | class before) from the class pairs of all ``paths``."""
    matrix = np.zeros(classes * classes)
    for r in paths.select("path").mapInArrow(_path_pairs(classes), "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        matrix[r.cell] = r.n
    matrix = matrix.reshape(classes, classes)
    share = (matrix.sum(axis=0) + DELTA) / (total + DELTA * classes)
    return np.log10((matrix + share[None, :]) / (matrix.sum(axis=1, keepdims=True) + 1))


def _score(model: BrownModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = model.known.look
        base_norm = math.log10(look.tokens + DELTA * (look.distinct + 1))
        for b in rows_of(batches, 512):
            logs, sizes = b.column("logs").to_numpy(), b.column("n_tokens").to_numpy()
            steps = []
            for p in b.column("path").to_pylist():
                c = np.frombuffer(p, dtype=np.uint8)
                steps.append(float(model.step[c[:-1], c[1:]].sum()) - float(model.norm[c[1:]].sum()))
            arrays = [b.column("doc_id"), b.column("n_tokens"), b.column("n_known"), pa.array(logs - sizes * base_norm), pa.array(logs + np.array(steps))]
            yield pa.record_batch(arrays, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return run


def scored(paths: DataFrame, model: BrownModel) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) per row of ``classed``; log10 probabilities of the whole text."""
    kind = paths.schema["doc_id"].dataType.simpleString()
    return paths.drop("train").mapInArrow(_score(model), f"doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double")


def learned_words(texts: DataFrame) -> Lookup:
    with settled_tables(texts.sparkSession):
        return find_words(settle(word_counts(texts), "vocabulary"))


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Jobs within the block keep no shuffle files once they are done and hand Python few chunks at a time."""
    with shuffles_dropped(spark), arrow_batches(spark, 10_000, BATCH):
        yield


def fit(texts: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[BrownModel, DataFrame]:
    """The model of all rows of ``texts`` (one binary column) and the table of rarer words (word, n, cls and more; settled)."""
    with lean(texts.sparkSession):
        look = learned_words(texts)
        encoded = encode(texts.select(F.lit(0).alias("doc_id"), F.lit(True).alias("train"), F.col("text")), look)
        known, vocab, norm = find_classes(encoded, look, classes, rounds)
        return BrownModel(known, find_steps(classed(encoded, known, vocab), look.tokens, len(norm)), norm), vocab


def score(docs: DataFrame, model: BrownModel, vocab: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) per row of ``docs``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.lit(False).alias("train"), F.col(text_col).cast("binary").alias("text"))
    with lean(docs.sparkSession):
        encoded = encode(d, model.known.look)
        return scored(classed(encoded, model.known, located(encoded, vocab)), model)


def fit_and_score(docs: DataFrame, train: Column, classes: int = CLASSES, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[BrownModel, DataFrame]:
    """``score`` of all rows of ``docs`` by the ``fit`` of its rows ``train``; the texts are cut into words twice in all.

    Of the tables on the way only that of ``classed`` stays, which the result reads.
    """
    spark = docs.sparkSession
    with lean(spark), settled_tables(spark):
        look = learned_words(training_texts(docs, train, text_col))
        d = docs.select(F.col(id_col).alias("doc_id"), train.alias("train"), F.col(text_col).cast("binary").alias("text"))
        encoded = encode(d, look)
        known, vocab, norm = find_classes(encoded, look, classes, rounds)
        paths = classed(encoded, known, vocab, owned=False)
        model = BrownModel(known, find_steps(paths.where("train"), look.tokens, len(norm)), norm)
    return model, scored(paths, model)


def training_texts(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    return docs.where(train).select(F.col(text_col).cast("binary").alias("text"))
