"""Jobs over grey images held as pixel arrays (row-major, ``pixels``, ``w``, ``h``). All row-local."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.hashing import hash_hex
from tallyforge.functions.ranking import take_in_hash_order
from tallyforge.functions.vectors import let

# Grey levels of ink and of mid grey, and the accepted ink share.
INK_BELOW = 128
MID_GREY = (32, 224)
INK_SHARE = (0.01, 0.90)
WHITE = 255


def _share(pixels: Column | str, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(pixels, test)) / F.size(pixels)


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("int")


def _ring(pixels: Column, corners_twice: bool) -> Column:
    """Mean of the one-pixel border."""
    w, h = F.col("w"), F.col("h")

    def add(acc: Column, cell: Column) -> Column:
        p, i = cell["p"], cell["i"]
        r, c = _div(i, w), i % w
        edges = (r == 0).cast("int") + (r == h - 1).cast("int") + (c == 0).cast("int") + (c == w - 1).cast("int")
        weight = edges if corners_twice else (edges > 0).cast("int")
        return F.struct((acc["s"] + weight * p).alias("s"), (acc["n"] + weight).alias("n"))

    cells = F.transform(pixels, lambda p, i: F.struct(p.cast("bigint").alias("p"), i.alias("i")))
    start = F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(0).alias("n"))
    return F.aggregate(cells, start, add, lambda a: a["s"] / a["n"])


def pixel_profile(df: DataFrame) -> DataFrame:
    """Per image: ink share, mid-grey share, border mean, number of grey levels."""
    return df.withColumns(
        {
            "ink_frac": _share("pixels", lambda p: p < INK_BELOW),
            "mid_grey_frac": _share("pixels", lambda p: (p >= MID_GREY[0]) & (p < MID_GREY[1])),
            "border_mean": _ring(F.col("pixels"), corners_twice=False),
            "n_levels": F.size(F.array_distinct("pixels")),
        }
    )


def class_pixels(profile: DataFrame, cls: str) -> DataFrame:
    """Per class: images and the means of their profiles."""
    return profile.groupBy(cls).agg(
        F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("ink_frac", "mid_grey_frac", "border_mean", "n_levels")]
    )


def intensity_hist(df: DataFrame, key: str, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Counts per grey level, over all images or a seeded sample of them."""
    if sample is not None:
        df = take_in_hash_order(df, None, key, lambda _: F.lit(sample), seed).where("taken")
    return df.select(F.explode("pixels").alias("level")).groupBy("level").agg(F.count("*").alias("n"))


def otsu_of(pixels: Column) -> Column:
    """The level that maximises the between-class variance (lowest on ties; 0 if there is one
    level only): one sort of the pixels and one fold over them."""
    zero = F.lit(0).cast("bigint")
    start = F.struct(
        zero.alias("n0"), zero.alias("s0"), F.lit(-1).alias("last"), F.lit(0.0).alias("best"), F.lit(0).alias("t")
    )

    def step(acc: Column, p: Column, n: Column, s: Column) -> Column:
        gap = (acc["s0"] * n - s * acc["n0"]).cast("double")
        spread = gap * gap / (acc["n0"] * (n - acc["n0"])).cast("double")
        better = (acc["n0"] > 0) & (p > acc["last"]) & (spread > acc["best"])
        return F.struct(
            (acc["n0"] + 1).alias("n0"), (acc["s0"] + p).alias("s0"), p.cast("int").alias("last"),
            F.when(better, spread).otherwise(acc["best"]).alias("best"), F.when(better, acc["last"]).otherwise(acc["t"]).alias("t"),
        )

    def fold(v: Column, s: Column) -> Column:
        n = F.size(v).cast("bigint")
        return F.aggregate(v, start, lambda acc, p: step(acc, p, n, s), lambda acc: acc["t"])

    total = lambda v: F.aggregate(v, zero, lambda a, p: a + p)
    return let(F.array_sort(pixels), lambda v: let(total(v), lambda s: fold(v, s)))


def with_otsu(df: DataFrame, out: str = "threshold") -> DataFrame:
    """Adds the Otsu threshold of each image."""
    return df.withColumn(out, otsu_of(F.col("pixels")))


def _is_inverted(thr: Column, polarity: str) -> Column:
    """Is the paper dark? Judged by the border, by the whole image, or never."""
    if polarity == "border":
        return _ring(thr, corners_twice=True) < 127.5
    if polarity == "image":
        return F.aggregate(thr, F.lit(0).cast("bigint"), lambda a, p: a + p) / F.size(thr) < 127.5
    if polarity == "none":
        return F.lit(False)
    raise ValueError(f"polarity is 'border', 'image' or 'none', got {polarity!r}")


def normalise_rasters(df: DataFrame, margin: float = 0.1, polarity: str = "border", mean: float = 0.0, std: float = 1.0) -> DataFrame:
    """Threshold, make ink dark, crop to the ink, judge the ink share, centre in a padded square.

    Adds inverted, crop_h, crop_w, ink_frac, side, canvas (values (v - mean) / std with ink 0 and
    paper 1) and ``reject`` (empty, ink_share or NULL). ``polarity``: border, image or none.
    """
    w = F.col("w")
    binary = lambda t: F.transform("pixels", lambda p: F.when(p > t, WHITE).otherwise(0))
    thr = let(otsu_of(F.col("pixels")), binary)

    def shape(ink: Column) -> Column:
        """Bounding box of the ink cells (row-major positions)."""
        rows = F.transform(ink, lambda i: _div(i, w))
        cols = F.transform(ink, lambda i: (i % w).cast("int"))
        box = lambda r, c: F.struct(
            F.size(ink).alias("n"), F.array_min(r).alias("r0"), F.array_max(r).alias("r1"), F.array_min(c).alias("c0"), F.array_max(c).alias("c1")
        )
        return let(rows, lambda r: let(cols, lambda c: box(r, c)))

    def measured(t: Column) -> Column:
        """Polarity, then the positions of the ink and their box."""
        positions = lambda dark: F.filter(
            F.transform(t, lambda p, i: F.when((p == 0) != dark, i)), lambda i: i.isNotNull()
        )
        return let(_is_inverted(t, polarity), lambda dark: F.struct(t.alias("thr"), dark.alias("inverted"), let(positions(dark), shape).alias("b")))

    d = df.withColumn("_m", let(thr, measured))
    d = d.withColumns(
        {
            "inverted": F.col("_m.inverted"),
            "crop_h": F.col("_m.b.r1") - F.col("_m.b.r0") + 1,
            "crop_w": F.col("_m.b.c1") - F.col("_m.b.c0") + 1,
            "_n": F.col("_m.b.n"),
        }
    )
    d = d.withColumns(
        {
            "ink_frac": F.when(F.col("_n") > 0, F.col("_n") / (F.col("crop_h") * F.col("crop_w"))),
            "side": F.ceil(F.greatest("crop_h", "crop_w") * F.lit(1 + 2 * margin)).cast("int"),
        }
    )
    outside = (F.col("ink_frac") < INK_SHARE[0]) | (F.col("ink_frac") > INK_SHARE[1])
    d = d.withColumn("reject", F.when(F.col("_n") == 0, "empty").when(outside, "ink_share"))

    def canvas(g: Column) -> Column:
        """Every cell of the square looks its source pixel up; outside the crop it is paper."""
        paint = lambda v: (F.lit(v) - F.lit(float(mean))) / F.lit(float(std))

        def cell(j: Column) -> Column:
            r, c = _div(j, g["side"]) - g["y"], j % g["side"] - g["x"]
            inside = r.between(0, g["h"] - 1) & c.between(0, g["w"] - 1)
            source = F.get(g["thr"], ((r + g["r0"]) * w + c + g["c0"]).cast("int"))
            return F.when(inside & ((source == 0) != g["dark"]), paint(0.0)).otherwise(paint(1.0))

        return F.transform(F.sequence(F.lit(0), g["side"] * g["side"] - 1), cell)

    place = F.struct(
        F.col("_m.thr").alias("thr"), F.col("inverted").alias("dark"), F.col("crop_h").alias("h"), F.col("crop_w").alias("w"), F.col("_m.b.r0").alias("r0"), F.col("_m.b.c0").alias("c0"), F.col("side").alias("side"),
        _div(F.col("side") - F.col("crop_h"), F.lit(2)).alias("y"), _div(F.col("side") - F.col("crop_w"), F.lit(2)).alias("x"),
    )
    return d.withColumn("canvas", F.when(F.col("reject").isNull(), let(place, canvas))).drop("_m", "_n")


def reject_ledger(normalised: DataFrame) -> DataFrame:
    """Images per outcome."""
    return normalised.groupBy(F.coalesce("reject", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def _pick(test_index: Callable[[Column, Column], tuple[Column, Column]]) -> Callable[[Column], Column]:
    """Index permutation: output cell (r, c) takes input cell test_index(r, c)."""

    def op(_: Column) -> Column:
        w = F.col("w")
        n = F.sequence(F.lit(0), F.size("pixels") - 1)

        def at(j: Column) -> Column:
            r, c = test_index(_div(j, w), (j % w).cast("int"))
            return F.get("pixels", (r * w + c).cast("int"))

        return F.transform(n, at)

    return op


def _rot90(_: Column) -> Column:
    # quarter turn counter-clockwise: the output is h wide and w high
    w, h = F.col("w"), F.col("h")
    return F.transform(
        F.sequence(F.lit(0), F.size("pixels") - 1),
        lambda j: F.get("pixels", ((j % h) * w + (w - 1 - _div(j, h))).cast("int")),
    )


def _contrast(v: float) -> Callable[[Column], Column]:
    return lambda _: F.transform("pixels", lambda p: F.bround(F.lit(v) + p / 255.0 * (255.0 - 2.0 * v)).cast("int"))


def _translate(frac: float) -> Callable[[Column], Column]:
    def op(_: Column) -> Column:
        w = F.col("w")
        dx = F.bround(w * F.lit(frac)).cast("int")
        return F.transform("pixels", lambda p, i: F.when(i % w < dx, WHITE).otherwise(F.get("pixels", i - dx)))

    return op


def _block_mean(k: int) -> Callable[[Column], Column]:
    """k x k block means, put back to 0 / 255: a low-resolution copy."""

    def op(_: Column) -> Column:
        w, h = F.col("w"), F.col("h")

        def at(p: Column, i: Column) -> Column:
            r0, c0 = _div(_div(i, w), F.lit(k)) * k, _div(i % w, F.lit(k)) * k
            cells = [F.when((r0 + a < h) & (c0 + b < w), F.get("pixels", ((r0 + a) * w + c0 + b).cast("int"))) for a in range(k) for b in range(k)]
            known = F.array_compact(F.array(*cells))
            return F.when(F.aggregate(known, F.lit(0), lambda x, y: x + y) / F.size(known) > 127, WHITE).otherwise(0)

        return F.transform("pixels", at)

    return op


def _salt_pepper(hexdigits: int) -> Callable[[Column], Column]:
    """About hexdigits / 256 of the pixels become 0 or 255, chosen by the variant's hash."""

    def op(h: Column) -> Column:
        def at(p: Column, i: Column) -> Column:
            x = F.conv(F.substring(F.md5(F.concat(h, i.cast("string"))), 1, 3), 16, 10).cast("int")
            return F.when(x < hexdigits * 16, F.when(x % 2 == 0, 0).otherwise(WHITE)).otherwise(p)

        return F.transform("pixels", at)

    return op


def _occlude(frac: float) -> Callable[[Column], Column]:
    """A white box at a place chosen by the variant's hash."""

    def op(hx: Column) -> Column:
        w, h = F.col("w"), F.col("h")
        bh, bw = F.greatest(F.lit(1), F.bround(h * F.lit(frac))).cast("int"), F.greatest(F.lit(1), F.bround(w * F.lit(frac))).cast("int")
        y0 = (F.conv(F.substring(hx, 9, 4), 16, 10).cast("int") % (h - bh + 1)).cast("int")
        x0 = (F.conv(F.substring(hx, 13, 4), 16, 10).cast("int") % (w - bw + 1)).cast("int")
        hit = lambda i: _div(i, w).between(y0, y0 + bh - 1) & (i % w).between(x0, x0 + bw - 1)
        return F.transform("pixels", lambda p, i: F.when(hit(i), WHITE).otherwise(p))

    return op


# name -> (variant hash) -> pixels; the hash drives whatever is random in an operation
VARIANTS: dict[str, Callable[[Column], Column]] = {
    "contrast": _contrast(60.0),
    "translate": _translate(0.25),
    "downscale": _block_mean(2),
    "salt_pepper": _salt_pepper(16),
    "occlusion": _occlude(0.4),
    "mirror_h": _pick(lambda r, c: (r, F.col("w") - 1 - c)),
    "mirror_v": _pick(lambda r, c: (F.col("h") - 1 - r, c)),
    "rot90": _rot90,
    "rot180": _pick(lambda r, c: (F.col("h") - 1 - r, F.col("w") - 1 - c)),
    "half": lambda _: F.transform("pixels", lambda p, i: F.when(_div(i, F.col("w")) < _div(F.col("h"), F.lit(2)), p).otherwise(WHITE)),
    "rebinarise": lambda _: F.transform("pixels", lambda p: F.when(p > 128, WHITE).otherwise(0)),
}


def expand_variants(df: DataFrame, key: str, n: int, seed: int = 42, registry: Mapping[str, Callable[[Column], Column]] = VARIANTS) -> DataFrame:
    """n variants per image, each by an operation the hash picks.

    A variant with less than 1 % ink, or less than 35 % of the image's own ink share, is
    rejected: it keeps the original pixels and is marked.
    """
    names = list(registry)
    d = df.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(n))))
    d = d.withColumn("_h", hash_hex(seed, key, "variant"))
    pick = (F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") % len(names)).cast("int")
    d = d.withColumn("op", F.get(F.array(*[F.lit(x) for x in names]), pick))
    made = None
    for name, fn in registry.items():
        px = F.transform(fn(F.col("_h")), lambda p: p.cast("int"))
        made = F.when(F.col("op") == name, px) if made is None else made.when(F.col("op") == name, px)
    d = d.withColumn("_made", made)
    before = _share("pixels", lambda p: p < INK_BELOW)
    after = _share("_made", lambda p: p < INK_BELOW)
    d = d.withColumn("rejected", (after < 0.01) | (after < 0.35 * before))
    turned = (F.col("op") == "rot90") & ~F.col("rejected")
    d = d.withColumn("pixels", F.when(F.col("rejected"), F.col("pixels")).otherwise(F.col("_made")))
    d = d.withColumn("_w", F.when(turned, F.col("h")).otherwise(F.col("w"))).withColumn("h", F.when(turned, F.col("w")).otherwise(F.col("h")))
    return d.withColumn("w", F.col("_w")).drop("_h", "_made", "_w")


def sharpness(pixels: str = "pixels") -> Column:
    """Variance of the 4-neighbour Laplacian with mirrored borders, in whole units."""
    w, h = F.col("w"), F.col("h")

    def lap(p: Column, i: Column) -> Column:
        r, c = _div(i, w), (i % w).cast("int")
        up, down = F.abs(r - 1), h - 1 - F.abs(h - 2 - r)
        left, right = F.abs(c - 1), w - 1 - F.abs(w - 2 - c)
        at = lambda y, x: F.get(pixels, (y * w + x).cast("int"))
        return (at(up, c) + at(down, c) + at(r, left) + at(r, right) - 4 * p).cast("bigint")

    n = F.size(pixels).cast("bigint")
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("s"), zero.alias("q"))
    add = lambda a, x: F.struct((a["s"] + x).alias("s"), (a["q"] + x * x).alias("q"))
    return F.aggregate(
        F.transform(pixels, lap), start, add, lambda a: F.floor((a["q"] * n - a["s"] * a["s"]) / (n * n)).cast("bigint")
    )
