import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import raster, triage


def frame(spark, arrays):
    rows = [(i, [int(v) for v in np.asarray(a).ravel()], np.asarray(a).shape[1], np.asarray(a).shape[0]) for i, a in enumerate(arrays)]
    return spark.createDataFrame(rows, "key int, pixels array<int>, w int, h int")


def brute_otsu(px):
    best, t = 0.0, 0
    n, s = len(px), sum(px)
    for level in range(255):
        low = [p for p in px if p <= level]
        if low and len(low) < n:
            v = (sum(low) * n - s * len(low)) ** 2 / (len(low) * (n - len(low)))
            if v > best:
                best, t = v, level
    return t


def test_otsu(spark):
    rnd = random.Random(1)
    imgs = [np.array([[rnd.randint(0, 255) for _ in range(5)] for _ in range(4)]) for _ in range(20)] + [np.full((3, 3), 200)]
    got = [r.threshold for r in raster.with_otsu(frame(spark, imgs)).orderBy("key").collect()]
    assert got == [brute_otsu(list(a.ravel())) for a in imgs]


GLYPH = np.full((6, 7), 250)
GLYPH[2:4, 3:6] = 10
GLYPH[2, 4] = 240


def test_glyph_is_cropped_and_centred(spark):
    r = raster.normalise_rasters(frame(spark, [GLYPH])).first()
    assert (r.inverted, r.crop_h, r.crop_w, r.reject) == (False, 2, 3, None) and r.ink_frac == pytest.approx(5 / 6)
    assert r.side == 4  # ceil(3 * 1.2)
    want = np.ones((4, 4))
    want[1, 0:3], want[2, 0:3], want[1, 1] = 0, 0, 1
    assert np.array_equal(np.array(r.canvas).reshape(4, 4), want)


def test_inverse_image_gives_the_same_glyph(spark):
    a, b = raster.normalise_rasters(frame(spark, [GLYPH, 260 - GLYPH])).orderBy("key").collect()
    assert b.inverted and a.canvas == b.canvas
    scaled = raster.normalise_rasters(frame(spark, [GLYPH]), mean=0.5, std=0.5).first()
    assert set(scaled.canvas) == {-1.0, 1.0}


def test_rejects(spark):
    solid = np.full((5, 5), 255)
    solid[1:4, 1:4] = 0
    got = raster.normalise_rasters(frame(spark, [np.full((4, 4), 255), solid]), polarity="none").orderBy("key").collect()
    assert [r.reject for r in got] == ["empty", "ink_share"] and got[0].canvas is None
    assert {r.outcome: r.n for r in raster.reject_ledger(raster.normalise_rasters(frame(spark, [GLYPH, solid]))).collect()} == {"kept": 1, "ink_share": 1}
    with pytest.raises(ValueError):
        raster.normalise_rasters(frame(spark, [GLYPH]), polarity="colour")


@pytest.mark.parametrize("op, fn", [
    ("mirror_h", lambda a: a[:, ::-1]), ("mirror_v", lambda a: a[::-1]), ("rot180", lambda a: np.rot90(a, 2)), ("rot90", np.rot90),
    ("rebinarise", lambda a: np.where(a > 128, 255, 0)),
])
def test_index_operations_on_a_wide_image(spark, op, fn):
    a = np.arange(12).reshape(3, 4) * 20
    r = raster.expand_variants(frame(spark, [a]), "key", 1, registry={op: raster.VARIANTS[op]}).first()
    want = fn(a)
    assert (r.h, r.w) == want.shape and r.pixels == [int(v) for v in want.ravel()] and not r.rejected


def test_every_variant_keeps_shape_and_ink(spark):
    rnd = np.random.default_rng(0)
    imgs = [np.where(rnd.random((8, 8)) < 0.4, 0, 255) for _ in range(40)]
    d = raster.expand_variants(frame(spark, imgs), "key", 6)
    share = F.size(F.filter("pixels", lambda p: p < 128)) / F.size("pixels")
    bad = d.where((F.size("pixels") != F.col("w") * F.col("h")) | (share < 0.01) | F.exists("pixels", lambda p: p.isNull() | (p < 0) | (p > 255)))
    assert d.count() == 240 and bad.count() == 0
    assert {r.op for r in d.select("op").distinct().collect()} == set(raster.VARIANTS)


def test_variant_without_ink_is_rejected(spark):
    a = np.full((4, 4), 255)
    a[3, 3] = 0  # below the half that is kept
    r = raster.expand_variants(frame(spark, [a]), "key", 1, registry={"half": raster.VARIANTS["half"]}).first()
    assert r.rejected and r.pixels == [int(v) for v in a.ravel()]


def test_profile_border_counts_corners_once(spark):
    r = raster.pixel_profile(frame(spark, [np.array([[0, 255, 255], [255, 0, 255], [255, 255, 100]])])).first()
    assert r.border_mean == pytest.approx((0 + 100 + 6 * 255) / 8) and r.n_levels == 3
    assert r.ink_frac == pytest.approx(3 / 9) and r.mid_grey_frac == pytest.approx(1 / 9)


def test_sharpness_mirrors_the_border(spark):
    a = np.array([[0, 10, 50], [20, 200, 30], [5, 60, 90]])
    p = np.pad(a, 1, mode="reflect")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a
    d = frame(spark, [a])
    assert d.select(raster.sharpness().alias("s")).first().s == int(lap.var())
    assert triage.describe_batch(d).first().median_height == 3.0
