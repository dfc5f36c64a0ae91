"""Removal of repeated passages, found with sharded Aho-Corasick automata.

A window is WINDOW consecutive words. Its anchor is the smallest hash among its runs of PHRASE
words, so equal windows have equal anchors wherever they stand. The steps:

1. *Anchors.* Every text gives the hashes of its anchors; those that occur once in the whole
   corpus cannot lie in a recurring window.
2. *Segments.* Texts with recurring anchors are cut into segments: windows next to each other with
   the same anchor. Every window lies in exactly one segment. Windows of anchors with more than
   ``hot`` occurrences are segments of their own, keyed by the hash of the whole window, so a
   frequent phrase in ever new surroundings is spread over as many keys as it has windows.
3. *Confirm.* A task counts its equal segments before they are dealt by anchor, so a passage in a third of all
   texts is a row per task. Per anchor, the windows of its different segments are compared word by word; each run of windows
   that occur twice or more is a confirmed passage, kept once, without its places.
4. *Automata.* The confirmed passages are the patterns of Aho-Corasick automata over word numbers, one per
   shard of anchors and at most BLOCK segments; the segments of all texts of the shard are streamed through
   it, and what it reports are the occurrences: no other step marks a place. A passage can only occur in segments
   of its own anchor, so no segment needs to pass through another shard's automaton.
5. *Removal.* The located spans go back to the texts they come from.

Defined results: a NULL or empty text has no words, nothing is removed and the kept text is
empty; repeated rows repeat their passages and each gets its row; rows with a NULL id are
treated like any other; texts below WINDOW words stay whole; a very long text is cut into segments like any
other and put together again by one task; of equal anchors (ties) each place counts; an empty table gives an empty
result. Only the id and the text are read, so further columns of any name do not matter.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle
from tallyforge.llm.common import gram_hashes, rows_of, word_hashes, words_of

WINDOW = 35
PHRASE = 12
# Most windows in a segment.
LONGEST = 64
# Segments that share one automaton.
BLOCK = 4096
HOT = 5_000


def _slide(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over every ``size`` neighbours, by doubling."""
    out, have = x, 1
    while have < size:
        more = min(have, size - have)
        out = op(out[:-more], out[more:])
        have += more
    return out


def anchors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
    """(hash of every phrase, anchor of every window); None for a text below WINDOW words."""
    if len(words) < WINDOW:
        return None
    g = gram_hashes(word_hashes(words), PHRASE)
    return g, _slide(g, WINDOW - PHRASE + 1, np.minimum)


def anchor_places(g: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The anchors of a text, once for each place that is some window's anchor."""
    pad = np.zeros(WINDOW - PHRASE, np.uint64)
    highest = _slide(np.concatenate([pad, m, pad]), WINDOW - PHRASE + 1, np.maximum)
    return g[g == highest]


def _first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows_of(batches, 512):
        n, sha, own = [], [], []
        for t in b.column(2).to_pylist():
            words = words_of(t)
            found = anchors(words)
            n.append(len(words))
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            own.append(None if found is None else anchor_places(*found).view(np.int64))
        cols = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(own, pa.list_(pa.int64()))]
        yield pa.record_batch([b.column(0), b.column(1), *cols], names=["doc_id", "th", "n_words", "sha", "anchors"])


def _cut(words: list[bytes], known: dict[int, bool]) -> Iterator[tuple[int, int, bytes]]:
    """(key, first word, segment) of every segment whose anchor is in ``known`` (anchor: hot)."""
    g, m = anchors(words)
    m = m.view(np.int64)
    edge = np.flatnonzero(m[1:] != m[:-1]) + 1
    for i, j in zip(np.r_[0, edge].tolist(), np.r_[edge, len(m)].tolist(), strict=True):
        hot = known.get(int(m[i]))
        if hot is None:
            continue
        step = 1 if hot else LONGEST
        for s in range(i, j, step):
            text = b" ".join(words[s : min(s + step, j) + WINDOW - 1])
            yield (xxhash.xxh3_64_intdigest(text) - (1 << 63) if hot else int(m[i])), s, text


def _texts_of_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, segment, n): the segments of a batch of texts, equal ones counted."""
    for b in rows_of(batches, 1024):
        seen: Counter[tuple[int, bytes]] = Counter()
        for text, own in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            seen.update((k, x) for k, _, x in _cut(words_of(text), {a["anchor"]: a["hot"] for a in own}))
        cols = [pa.array([k for k, _ in seen], pa.int64()), pa.array([x for _, x in seen], pa.binary()), pa.array(seen.values(), pa.int64())]
        yield pa.record_batch(cols, names=["key", "segment", "n"])


def _places_of_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, th, start, key, sid): where each segment stands."""
    for b in rows_of(batches, 256):
        doc, th, key, start, sid = [], [], [], [], []
        for d, t, text, own in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
            for k, s, x in _cut(words_of(text), {a["anchor"]: a["hot"] for a in own}):
                doc.append(d)
                th.append(t)
                start.append(s)
                key.append(k)
                sid.append(xxhash.xxh3_128_digest(x))
        cols = [pa.array(doc, b.column(0).type), pa.array(th, pa.int64()), pa.array(start, pa.int64()), pa.array(key, pa.int64()), pa.array(sid, pa.binary())]
        yield pa.record_batch(cols, names=["doc_id", "th", "start", "key", "sid"])


def passages(group: dict[bytes, int]) -> set[bytes]:
    """The confirmed passages of one key: every run of windows that occur twice or more, each once.

    ``group`` has the number of occurrences of each segment; windows are compared as text.
    """
    parts, seen = [], Counter()
    for text, n in group.items():
        words = text.split(b" ")
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        starts = [0, *ends[:-1]]
        windows = [text[starts[i] : ends[i + WINDOW - 1] - 1] for i in range(len(words) - WINDOW + 1)]
        parts.append((text, starts, ends, windows))
        for w in windows:
            seen[w] += n
    out = set()
    for text, starts, ends, windows in parts:
        i = 0
        while i < len(windows):
            j = i
            while j < len(windows) and seen[windows[j]] > 1:
                j += 1
            if j > i:
                out.add(text[starts[i] : ends[j + WINDOW - 2] - 1])
            i = j + 1
    return out


def locate(patterns: set[bytes], segments: list[bytes]) -> list[list[int]]:
    """Word spans [start, end, start, end ...] of the passages in each segment, by one automaton over word numbers."""
    if not patterns:
        return [[] for _ in segments]
    numbers: dict[bytes, int] = {}
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in patterns:
        code = tuple(numbers.setdefault(w, len(numbers) + 1) for w in p.split(b" "))
        automaton.add_word(code, len(code))
    automaton.make_automaton()
    out = []
    for text in segments:
        spans: list[int] = []
        # 0 stands for words that no passage has
        for end, size in automaton.iter(tuple(numbers.get(w, 0) for w in text.split(b" "))):
            a, b = end - size + 1, end + 1
            while spans and a <= spans[-1]:
                a = min(a, spans[-2])
                del spans[-2:]
            spans += [a, b]
        out.append(spans)
    return out


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, segment, n) sorted by key: the located spans of each segment that has any."""
    block: list[tuple[int, bytes]] = []
    patterns: set[bytes] = set()

    def flush() -> pa.RecordBatch:
        spans = locate(patterns, [x for _, x in block])
        rows = [(k, xxhash.xxh3_128_digest(x), s) for (k, x), s in zip(block, spans, strict=True) if s]
        block.clear()
        patterns.clear()
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = [pa.int64(), pa.binary(), pa.list_(pa.int32())]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "sid", "spans"])

    def close(key: int, group: dict[bytes, int]) -> None:
        found = passages(group)
        if found:
            patterns.update(found)
            block.extend((key, x) for x in group)

    now, group = None, {}
    for b in rows_of(batches):
        for key, segment, n in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True):
            if key != now:
                if group:
                    close(now, group)
                    if len(block) >= BLOCK:
                        yield flush()
                now, group = key, {}
            group[segment] = group.get(segment, 0) + n
    if group:
        close(now, group)
    if block:
        yield flush()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, th, text, places: array of (start, spans)): the text without its located spans."""
    for b in rows_of(batches, 256):
        n, gone, kept = [], [], []
        for text, places in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            words = words_of(text)
            off = np.zeros(len(words) + 1, np.int32)
            for p in places:
                at = np.array(p["spans"], dtype=np.int64) + p["start"]
                np.add.at(off, at[::2], 1)
                np.add.at(off, at[1::2], -1)
            out = np.cumsum(off[:-1]) > 0
            n.append(len(words))
            gone.append(int(out.sum()))
            kept.append(b" ".join(w for w, x in zip(words, out.tolist(), strict=True) if not x))
        cols = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())]
        yield pa.record_batch([b.column(0), b.column(1), *cols], names=["doc_id", "th", "n_words", "n_removed", "kept"])


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(changed, whole): texts with a recurring passage and all others.

    changed has (doc_id, th, n_words, n_removed, kept: binary), whole has (doc_id, th, n_words,
    sha of the words joined by one space). Rows with equal id and text share one key (doc_id, th),
    their results are equal; each of them still has its row.
    """
    base = _keyed(docs, id_col, text_col)
    first = settle(base.mapInArrow(_first_pass, "doc_id bigint, th bigint, n_words bigint, sha string, anchors array<bigint>"), "anchors")
    places = first.select("doc_id", "th", F.explode("anchors").alias("anchor"))
    again = places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", (F.col("n") > hot).alias("hot"))
    hits = places.join(again, "anchor").groupBy("doc_id", "th").agg(F.collect_set(F.struct("anchor", "hot")).alias("own"))
    found = settle(base.join(hits, _same(base, hits)).select(base["doc_id"], base["th"], "text", "own"), "anchored")

    segments = found.mapInArrow(_texts_of_segments, "key bigint, segment binary, n bigint")
    located = segments.repartition("key").sortWithinPartitions("key").mapInArrow(_shards, "key bigint, sid binary, spans array<int>")
    where = found.mapInArrow(_places_of_segments, "doc_id bigint, th bigint, start bigint, key bigint, sid binary")
    spans = where.join(located, ["key", "sid"]).groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "spans")).alias("places"))
    spans = settle(spans, "spans")
    texts = found.select("doc_id", "th", "text")
    changed = texts.join(spans, _same(texts, spans)).select(texts["doc_id"], texts["th"], "text", "places")
    changed = changed.mapInArrow(_remove, "doc_id bigint, th bigint, n_words bigint, n_removed bigint, kept binary")
    whole = first.join(spans, _same(first, spans), "left_anti").select("doc_id", "th", "n_words", "sha")
    return changed, whole


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) per row."""
    changed, whole = remove_repeats(docs, id_col, text_col, hot)
    own = whole.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return changed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")).unionByName(own)
