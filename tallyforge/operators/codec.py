"""Class codes, names, paths and labels as Column expressions and dimension joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes, attach_row, dense_labels, settle, small
from tallyforge.functions.skew import join_keyed

# Byte code 0xA0 is the code point U+0E00, and the ranges of each category.
CODE_BASE = 0xA0
POINT_BASE = 0x0E00
CATEGORY_RANGES = (
    ("digit", 0x0E50, 0x0E59),
    ("consonant", 0x0E01, 0x0E2F),
    ("vowel", 0x0E30, 0x0E39),
    ("vowel", 0x0E40, 0x0E45),
    ("tone_mark", 0x0E46, 0x0E4E),
)
# The 72 byte codes of the class universe.
CORPUS_CODES = (
    161, 162, 163, 164, 167, 168, 169, 170, 171, 173, 175, 176, 177, 178, 179, 180, 181, 182,
    183, 184, 185, 186, 187, 188, 189, 190, 191, 192, 193, 194, 195, 196, 197, 199, 200, 201,
    202, 203, 204, 205, 206, 207, 209, 210, 212, 213, 214, 215, 216, 217, 224, 225, 226, 227,
    228, 229, 230, 231, 232, 233, 234, 236, 240, 241, 242, 243, 244, 245, 246, 247, 248, 249,
)
# Fixed value: prefix, document number, subset, line and index of a corpus file name.
NAME_PATTERN = r"(?i)^(?:Copy of )?(be|bc|bl|ce)_(\d{3})(sg|tg)_(\d+)_(\d+)\.jpg$"
COPY_PREFIX = "Copy of "


def char_of(code: Column) -> Column:
    """Character of a byte code (code points below 65536)."""
    point = code.cast("bigint") - CODE_BASE + POINT_BASE
    return F.decode(F.unhex(F.lpad(F.hex(point), 4, "0")), "UTF-16BE")


def code_of(char: Column) -> Column:
    """Byte code of a character."""
    point = F.conv(F.hex(F.encode(char, "UTF-16BE")), 16, 10).cast("bigint")
    return (point - POINT_BASE + CODE_BASE).cast("int")


def class_dim(codes: DataFrame, code: str = "code") -> DataFrame:
    """(code, char, label): one row per distinct code; label = rank of the code."""
    distinct = codes.select(F.col(code).cast("int").alias("code")).distinct()
    return distinct.select(
        "code", char_of(F.col("code")).alias("char"), (F.dense_rank().over(Window.orderBy("code")) - 1).alias("label")
    )


def categorise(point: Column, ranges: Sequence[tuple[str, int, int]] = CATEGORY_RANGES, strict: bool = True) -> Column:
    """Category of a code point; outside all ranges it is an error (or NULL if not strict)."""
    out = None
    for name, lo, hi in ranges:
        hit = point.between(lo, hi)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    if strict:
        out = out.otherwise(F.raise_error(F.concat(F.lit("no category for code point "), point.cast("string"))))
    return out


def join_class_dim(df: DataFrame, cls: str, classes: Classes, how: str = "inner") -> DataFrame:
    """Adds ``label`` of the class column."""
    return df.join(classes.side.withColumnRenamed("class", cls), cls, how)


def parse_name(name: Column, pattern: str = NAME_PATTERN) -> list[Column]:
    """prefix, doc_id, subset, line, idx, is_copy, group, parsed; NULL parts if it does not match."""
    parsed = name.rlike(pattern)
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    return [
        part(1).alias("prefix"),
        part(2).try_cast("int").alias("doc_id"),
        part(3).alias("subset"),
        part(4).try_cast("int").alias("line"),
        part(5).try_cast("int").alias("idx"),
        name.startswith(COPY_PREFIX).alias("is_copy"),
        F.when(parsed, F.concat_ws("_", part(1), part(2))).alias("group"),
        parsed.alias("parsed"),
    ]


def label_of_name(name: Column, known_codes: Sequence[int], char_labels: Mapping[str, str]) -> Column:
    """The first 2-3 digit run if it is a known code, else the first known class character."""
    run = F.regexp_extract(name, r"(\d{2,3})", 1)
    number = F.when(run != "", run).try_cast("int")
    by_code = F.when(number.isin(list(known_codes)), number.cast("string"))
    if not char_labels:
        return by_code
    pairs = F.create_map(*[F.lit(x) for kv in char_labels.items() for x in kv])
    letters = F.filter(F.split(name, ""), lambda c: F.map_contains_key(pairs, c))
    return F.coalesce(by_code, F.element_at(pairs, F.get(letters, F.lit(0))))


def label_from_path(path: Column, known_codes: Sequence[int], char_labels: Mapping[str, str]) -> Column:
    """Label of the nearest labelled folder, innermost first, else of the file stem."""
    parts = F.split(path, "/")
    folders = F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    tried = F.transform(F.concat(folders, F.array(stem)), lambda n: label_of_name(n, known_codes, char_labels))
    return F.get(F.filter(tried, lambda x: x.isNotNull()), F.lit(0))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def label_from_manifest(df: DataFrame, manifest: DataFrame, path: str, file_col: str) -> DataFrame:
    """Label from a side table by base name; its label column is the first of label, code, char.

    The side table is reduced to one row per name (the last by label) before the join; a base
    name shared by very many items is split.
    """
    label = next((c for c in ("label", "code", "char") if c in manifest.columns), None)
    if label is None:
        raise ValueError("the manifest needs a label, code or char column")
    side = manifest.groupBy(basename(F.col(file_col)).alias("_name")).agg(F.max(F.col(label).cast("string")).alias("label"))
    return join_keyed(df.withColumn("_name", basename(F.col(path))), side, ["_name"], path, "left").drop("_name")


def normalised(name: Column, drop_prefix: str = r"^thai\s+character\s+") -> Column:
    """Trimmed lower case, prefix dropped, runs of ``-``, ``_`` and blanks as one blank."""
    s = F.regexp_replace(F.lower(F.trim(name)), drop_prefix, "")
    s = F.regexp_replace(s, r"[-_]+", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def normalise_name(df: DataFrame, col: str, aliases: DataFrame, alias_rows: int | None = None, drop_prefix: str = r"^thai\s+character\s+") -> DataFrame:
    """Adds ``class`` (NULL if unknown) by looking the normalised name up in (alias, class)."""
    side = aliases.select(normalised(F.col("alias"), drop_prefix).alias("_norm"), F.col("class"))
    return df.withColumn("_norm", normalised(F.col(col), drop_prefix)).join(small(side, alias_rows), "_norm", "left").withColumnRenamed("_norm", "norm_name")


def parse_external_names(df: DataFrame, col: str) -> DataFrame:
    """label-code-...-writer.png names: orig_label, code, writer; malformed names are dropped.

    A ``P-<digits>`` token anywhere in the name is the writer of the second naming scheme.
    """
    parts = F.split(F.col(col), "-")
    d = df.withColumn("orig_label", F.get(parts, F.lit(0))).withColumn(
        "code", F.get(parts, F.lit(1)).try_cast("int")
    )
    scheme_b = F.regexp_extract(col, r"(P-\d+)", 1)
    scheme_a = F.regexp_extract(col, r"-(\d+)(?:\s*-\s*Copy)?\.png$", 1)
    d = d.withColumn("writer_id", F.when(scheme_b != "", scheme_b).otherwise(scheme_a))
    return d.where((F.size(parts) >= 3) & F.col("code").isNotNull())


def parse_external_folders(df: DataFrame, col: str) -> DataFrame:
    """Paths root/folder/file of the second naming scheme: the folder is ``x-<code>-x-<label>``, maybe with more
    parts, and the file names its writer as ``P-<digits>`` (empty if it does not). Adds orig_label, code and writer_id; paths that
    are too short, are no image or have no code are dropped.
    """
    parts = F.split(F.col(col), "/")
    folder, file = F.split(F.get(parts, F.lit(1)), "-"), F.get(parts, F.lit(2))
    d = df.withColumn("orig_label", F.get(folder, F.lit(3))).withColumn("code", F.get(folder, F.lit(1)).try_cast("int"))
    d = d.withColumn("writer_id", F.regexp_extract(file, r"(P-\d+)", 1))
    image = F.lower(col).rlike(r"\.(?:jpe?g|png)$")
    return d.where(image & (F.size(parts) >= 3) & (F.size(folder) >= 4) & F.col("code").isNotNull())


def family_of(name: Column) -> Column:
    """Family of a source name: extension and ``[...]`` removed, then the text before ``-`` or ``_``."""
    stem = F.regexp_replace(name, r"(?<=.)\.[^./]*$", "")
    stem = F.regexp_replace(stem, r"\[.*?\]", "")
    return F.coalesce(F.get(F.split(stem, r"[-_]"), F.lit(0)), F.lit(""))


def writer_key(name: Column) -> Column:
    """Source name without its trailing ``_<number>.jpg``."""
    return F.regexp_replace(name, r"(?i)_\d+\.jpe?g$", "")


def drop_derived(df: DataFrame, name: str, prefix: str = "aug_") -> DataFrame:
    """Rows that are not pre-made variants of another item."""
    return df.where(~F.col(name).startswith(prefix))


def universe_partition(df: DataFrame, cls: str, classes: Classes) -> DataFrame:
    """Adds ``in_universe`` and a dense ``label``: classes outside follow after the last known label."""
    known = classes.side.select(F.col("class").alias(cls), F.col("label").alias("_known"))
    # one row per unknown class, ranked after the known ones
    strange = df.select(cls).where(F.col(cls).isNotNull()).distinct().join(known, cls, "left_anti")
    base = classes.df.agg(F.coalesce(F.max("label") + 1, F.lit(0)).alias("_base"))
    ranked = attach_row(dense_labels(strange, cls), base).select(cls, (F.col("label") + F.col("_base")).alias("_new"))
    # settled: the planner then knows how few classes these are
    out = df.join(known, cls, "left").join(settle(ranked, "new-classes"), cls, "left")
    return out.withColumn("in_universe", F.col("_known").isNotNull()).withColumn(
        "label", F.coalesce("_known", "_new")
    ).drop("_known", "_new")


def parse_pair(df: DataFrame, col: str, classes: Classes) -> DataFrame:
    """"a>b" as (a, b) with ``valid``: both sides are classes of the universe."""
    halves = F.split(F.col(col), ">", 2)
    d = df.withColumn("a", F.trim(F.get(halves, F.lit(0)))).withColumn("b", F.trim(F.get(halves, F.lit(1))))
    known = classes.side.select("class")
    a = known.select(F.col("class").alias("a"), F.lit(True).alias("_a"))
    b = known.select(F.col("class").alias("b"), F.lit(True).alias("_b"))
    d = d.join(small(a, classes.rows), "a", "left").join(small(b, classes.rows), "b", "left")
    return d.withColumn("valid", F.coalesce(F.col("_a") & F.col("_b"), F.lit(False))).drop("_a", "_b")


def geometry_features(w: Column, h: Column, ink: Column) -> Column:
    """[ln w, ln h, ln(w / h), ink]."""
    return F.array(F.log(w), F.log(h), F.log(w / h), ink)
