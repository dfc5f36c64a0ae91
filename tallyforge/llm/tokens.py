"""Token counts of whole texts by a given tokenizer, in batches that are balanced by bytes.

A row of the result needs only a length, so no token leaves the Arrow function:

1. *Blocks.* Rows are gathered until their texts have BLOCK bytes; a block is worked on at a time, so a
   task holds a bounded number of texts and of encodings, whether texts are short or long.
2. *Safe boundaries.* Each text is cut where no token can reach across: before a run of ASCII white space
   that follows a character which is no white space in any reading. The tokenizer cuts words there
   itself, and its special tokens have no space. Pieces above LONG bytes are cut further between ASCII
   letters and digits, and between a letter or digit and a full stop, comma, colon or the like. What has no such boundary
   (a single very long word) is encoded whole.
3. *Encoding.* Equal pieces of a block are encoded once, in calls of about BATCH bytes; their lengths are
   added up per text. Lengths of short pieces are kept for the task's later blocks, at most KNOWN of them.

The boundaries hold for byte-level BPE without prefix space that cuts words at white space (``safe``
is False otherwise, and texts are encoded whole).

Defined results: NULL and empty texts have 0 tokens; the strings of special tokens inside a text are what
the library makes of them by default; repeated rows repeat their counts; rows with a NULL id are rows like
any other; an empty table gives an empty result. Columns of any name are carried, added ones replace
carried ones of the same name.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tallyforge.llm.common import packed, rows_of

BLOCK = 4 << 20
BATCH = 1 << 20
LONG = 1 << 16
KNOWN = 200_000
LIMIT = 1024

_SPACE = " \t\n\u000b\f\r"
# Characters that some reading of \s counts as white space, beside the ASCII ones.
_ODD = "\u001c-\u001f\u0085  ᠎ -​    ⁠　﻿"
PIECES = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
HAS_ODD = re.compile(f"[{_ODD}]")
CUT = re.compile(f"(?<=[^{_SPACE}{_ODD}])(?=[{_SPACE}])")
FINE = re.compile("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9ぁ-ゖァ-ヺ一-龥])(?=[.,:;!?、。，])")


def pieces(text: str, long: int = LONG) -> list[str]:
    """The text cut at safe boundaries; the pieces joined are the text."""
    out = CUT.split(text) if HAS_ODD.search(text) else PIECES.findall(text)
    if any(len(p) > long for p in out):
        fine: list[str] = []
        for p in out:
            if len(p) <= long:
                fine.append(p)
                continue
            held: list[str] = []
            size = 0
            for q in FINE.split(p):
                held.append(q)
                size += len(q)
                if size > long:
                    fine.append("".join(held))
                    held, size = [], 0
            if held:
                fine.append("".join(held))
        out = fine
    return out


@lru_cache(maxsize=4)
def _loaded(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """(lengths of a list of texts, whether the safe boundaries hold) of a tokenizer file; loaded once per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    import json

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    facts = json.loads(t.to_str())
    before = facts.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and facts.get("normalizer") is None
    marks = all(not a["lstrip"] and not a["rstrip"] and not a["single_word"] and not re.search(rf"[{_SPACE}{_ODD}0-9.,:;!?]", a["content"]) for a in facts["added_tokens"])
    return lambda texts: [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)], plain and marks


def _batches(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in lists of about ``most`` bytes."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t.encode())
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def lengths(texts: list[str], count: Callable[[list[str]], list[int]], safe: bool, known: dict[str, int] | None = None) -> list[int]:
    """Tokens of each text; ``known`` holds lengths of pieces from earlier calls."""
    known = {} if known is None else known
    if len(known) > KNOWN:
        known.clear()
    cut = [pieces(t) if safe else [t] for t in texts]
    new = list({p for own in cut for p in own if p not in known})
    for batch in _batches(new, BATCH):
        known.update(zip(batch, count(batch), strict=True))
    out = [sum(map(known.__getitem__, own)) for own in cut]
    for p in new:
        if len(p) > 64:
            del known[p]
    return out


def _count(path: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, safe = _loaded(path)
        known: dict[str, int] = {}
        for b in rows_of(batches):
            sizes, at = b.column(2).to_pylist(), 0
            while at < b.num_rows:
                end, size = at, 0
                while end < b.num_rows and (end == at or size + sizes[end] <= block):
                    size += sizes[end]
                    end += 1
                own = b.slice(at, end - at)
                n = lengths(own.column(1).to_pylist(), count, safe, known)
                yield pa.record_batch([own.column(0), own.column(2), pa.array(n, pa.int64())], names=["_row", "n_bytes", "n_tokens"])
                at = end

    return run


def count_tokens(docs: DataFrame, text: Column, path: str, keep: list[str] | None = None, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """``keep`` (all) columns of ``docs`` with n_bytes (UTF-8), n_tokens and over_limit by the tokenizer file ``path``.

    ``path`` is read by every Python worker: a file of the installed tokenizer package, or in a folder that all executors see.
    """
    added = ("n_bytes", "n_tokens", "over_limit")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in added]
    whole = F.coalesce(text, F.lit(""))
    rows, own = packed(docs, keep, whole, F.octet_length(whole).cast("bigint"))
    done = rows.mapInArrow(_count(path, block), StructType().add("_row", own).add("n_bytes", LongType()).add("n_tokens", LongType()))
    return done.select(*[F.col("_row")[c].alias(c) for c in keep], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
