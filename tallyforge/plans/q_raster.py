"""Raster and triage queries: each embedding read as an 8 x 8 grey image."""

from pyspark.sql import functions as F

from tallyforge.functions.bounds import scratch_path
from tallyforge.operators import raster, triage
from tallyforge.plans import scoring as S
from tallyforge.plans.base import query, table, with_blocks
from tallyforge.plans.q_metrics import VIEWS, big, r6


def rasters(spark, sf):
    level = lambda x: F.least(F.greatest(F.round(F.lit(128.0) + F.lit(512.0) * x.cast("double")), F.lit(0.0)), F.lit(255.0)).cast("int")
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", level).alias("pixels"), F.lit(8).alias("w"), F.lit(8).alias("h"))


PX = """
px AS MATERIALIZED (SELECT vec_id, label, i AS i, i // 8 AS r, i % 8 AS c, least(greatest(round(128.0::DOUBLE + 512.0::DOUBLE * embedding[i + 1]::DOUBLE), 0), 255)::INT AS p
       FROM embeddings CROSS JOIN (SELECT unnest(range(64)) AS i))
"""
PROFILE = PX.strip() + """,
pf AS (SELECT vec_id, any_value(label) AS label, avg((p < 128)::INT) AS ink_frac, avg((p >= 32 AND p < 224)::INT) AS mid_grey_frac,
              avg(p) FILTER (r IN (0, 7) OR c IN (0, 7)) AS border_mean, count(DISTINCT p) AS n_levels FROM px GROUP BY vec_id)"""
OTSU = PX.strip() + """,
hg AS (SELECT vec_id, p, sum(count(*)) OVER w AS n0, sum(sum(p)) OVER w AS s0, sum(sum(p)) OVER (PARTITION BY vec_id) AS s FROM px GROUP BY vec_id, p WINDOW w AS (PARTITION BY vec_id ORDER BY p)),
ot AS (SELECT v.vec_id, coalesce(t, 0) AS t FROM (SELECT DISTINCT vec_id FROM px) v LEFT JOIN (
         SELECT vec_id, p AS t FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY pow((s0 * 64 - s * n0)::DOUBLE, 2) / (n0 * (64 - n0))::DOUBLE DESC, p) AS k FROM hg WHERE n0 < 64) WHERE k = 1) o USING (vec_id))"""


@query(
    "pixel_profile",
    with_blocks("SELECT vec_id, round(ink_frac, 6) AS ink_frac, round(mid_grey_frac, 6) AS mid_grey_frac, round(border_mean, 4) AS border_mean, n_levels FROM pf", PROFILE),
)
def pixel_profile(spark, sf):
    d = raster.pixel_profile(rasters(spark, sf))
    return d.select("vec_id", *r6("ink_frac", "mid_grey_frac"), F.round("border_mean", 4).alias("border_mean"), *big("n_levels"))


@query(
    "pixel_profile_by_class",
    with_blocks("SELECT label::BIGINT AS label, count(*) AS n, round(avg(ink_frac), 6) AS ink_frac, round(avg(mid_grey_frac), 6) AS mid_grey_frac, round(avg(border_mean), 4) AS border_mean, round(avg(n_levels), 4) AS n_levels FROM pf GROUP BY label", PROFILE),
)
def pixel_profile_by_class(spark, sf):
    d = raster.class_pixels(raster.pixel_profile(rasters(spark, sf)), "label")
    return d.select(*big("label"), "n", *r6("ink_frac", "mid_grey_frac"), F.round("border_mean", 4).alias("border_mean"), F.round("n_levels", 4).alias("n_levels"))


@query("intensity_hist", with_blocks("SELECT p::BIGINT AS level, count(*) AS n FROM px GROUP BY p", PX))
def intensity_hist(spark, sf):
    return raster.intensity_hist(rasters(spark, sf), "vec_id").select(*big("level"), "n")


@query(
    "intensity_hist_sample",
    with_blocks("SELECT p::BIGINT AS level, count(*) AS n FROM px WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY md5('0:' || vec_id), vec_id LIMIT 200) GROUP BY p", PX),
)
def intensity_hist_sample(spark, sf):
    return raster.intensity_hist(rasters(spark, sf), "vec_id", sample=200).select(*big("level"), "n")


@query("otsu_threshold", with_blocks("SELECT vec_id, t::BIGINT AS threshold FROM ot", OTSU))
def otsu_threshold(spark, sf):
    return raster.with_otsu(rasters(spark, sf)).select("vec_id", *big("threshold"))


def _norm_sql(polarity: str) -> str:
    level = {
        "border": "sum(v * ((r = 0)::INT + (r = 7)::INT + (c = 0)::INT + (c = 7)::INT)) / 32.0::DOUBLE",
        "image": "avg(v)",
        "none": "255.0::DOUBLE",
    }[polarity]
    return OTSU + f""",
bw AS (SELECT vec_id, r, c, CASE WHEN p > t THEN 255 ELSE 0 END AS v FROM px JOIN ot USING (vec_id)),
po AS (SELECT vec_id, {level} < 127.5 AS inverted FROM bw GROUP BY vec_id),
ik AS (SELECT vec_id, r, c FROM bw JOIN po USING (vec_id) WHERE v = CASE WHEN inverted THEN 255 ELSE 0 END),
bb AS (SELECT vec_id, min(r) AS r0, max(r) - min(r) + 1 AS ch, min(c) AS c0, max(c) - min(c) + 1 AS cw, count(*) AS n FROM ik GROUP BY vec_id),
nr AS (SELECT vec_id, inverted, ch, cw, r0, c0, n / (ch * cw)::DOUBLE AS ink_frac, ceil(greatest(ch, cw) * 1.2::DOUBLE)::BIGINT AS side,
              CASE WHEN n IS NULL THEN 'empty' WHEN n / (ch * cw)::DOUBLE < 0.01 OR n / (ch * cw)::DOUBLE > 0.9 THEN 'ink_share' END AS reject FROM po LEFT JOIN bb USING (vec_id)),
cv AS (SELECT nr.vec_id, string_agg(CASE WHEN ik.vec_id IS NULL THEN '1' ELSE '0' END, '' ORDER BY j) AS canvas
       FROM (SELECT *, unnest(range(side * side)) AS j FROM nr WHERE reject IS NULL) nr LEFT JOIN ik ON ik.vec_id = nr.vec_id
         AND ik.r - nr.r0 = j // side - (side - ch) // 2 AND ik.c - nr.c0 = j % side - (side - cw) // 2 GROUP BY nr.vec_id)"""


def _norm_query(name, polarity):
    @query(
        name,
        with_blocks("SELECT vec_id, inverted, round(ink_frac, 6) AS ink_frac, side, coalesce(reject, 'kept') AS outcome, coalesce(canvas, '') AS canvas FROM nr LEFT JOIN cv USING (vec_id)", _norm_sql(polarity)),
    )
    def run(spark, sf):
        d = raster.normalise_rasters(rasters(spark, sf), polarity=polarity)
        bits = F.array_join(F.transform("canvas", lambda v: v.cast("int").cast("string")), "")
        return d.select("vec_id", "inverted", *r6("ink_frac"), *big("side"), F.coalesce("reject", F.lit("kept")).alias("outcome"), F.coalesce(bits, F.lit("")).alias("canvas"))

    return run


_norm_query("normalise_rasters", "border")
_norm_query("normalise_rasters_external", "image")


@query("reject_ledger", with_blocks("SELECT coalesce(reject, 'kept') AS outcome, count(*) AS n FROM nr GROUP BY ALL", _norm_sql("image")))
def reject_ledger(spark, sf):
    return raster.reject_ledger(raster.normalise_rasters(rasters(spark, sf), polarity="image"))


_OPS = list(raster.VARIANTS)
EXPAND = PX.strip() + f""",
vh AS (SELECT vec_id, variant, md5('42:' || vec_id || ':' || variant) AS h FROM embeddings CROSS JOIN (SELECT unnest(range(1, 4)) AS variant)),
vo AS (SELECT *, {_OPS}[1 + ('0x' || substr(h, 1, 8))::BIGINT % {len(_OPS)}] AS op, ('0x' || substr(h, 9, 4))::BIGINT % 6 AS y0, ('0x' || substr(h, 13, 4))::BIGINT % 6 AS x0 FROM vh),
vp AS (SELECT vo.*, px.i, px.r, px.c, px.p, CASE op WHEN 'translate' THEN r * 8 + c - 2 WHEN 'mirror_h' THEN r * 8 + 7 - c WHEN 'mirror_v' THEN (7 - r) * 8 + c
         WHEN 'rot90' THEN c * 8 + 7 - r WHEN 'rot180' THEN (7 - r) * 8 + 7 - c ELSE px.i END AS src, avg(p) OVER (PARTITION BY vo.vec_id, variant, r // 2, c // 2) AS block,
         ('0x' || substr(md5(h || px.i), 1, 3))::BIGINT AS z FROM vo JOIN px USING (vec_id)),
vm AS (SELECT a.vec_id, a.variant, a.op, a.i, a.p AS p_in, CASE a.op WHEN 'contrast' THEN round_even(60.0::DOUBLE + a.p / 255.0::DOUBLE * 135.0::DOUBLE, 0)::INT
         WHEN 'translate' THEN CASE WHEN a.c < 2 THEN 255 ELSE b.p END WHEN 'downscale' THEN CASE WHEN a.block > 127 THEN 255 ELSE 0 END
         WHEN 'salt_pepper' THEN CASE WHEN a.z < 256 THEN CASE WHEN a.z % 2 = 0 THEN 0 ELSE 255 END ELSE a.p END
         WHEN 'occlusion' THEN CASE WHEN a.r BETWEEN y0 AND y0 + 2 AND a.c BETWEEN x0 AND x0 + 2 THEN 255 ELSE a.p END
         WHEN 'half' THEN CASE WHEN a.r < 4 THEN a.p ELSE 255 END WHEN 'rebinarise' THEN CASE WHEN a.p > 128 THEN 255 ELSE 0 END ELSE b.p END AS p_out
       FROM vp a LEFT JOIN px b ON b.vec_id = a.vec_id AND b.i = a.src),
ve AS (SELECT vec_id, variant, op, avg((p_out < 128)::INT) < 0.01 OR avg((p_out < 128)::INT) < 0.35 * avg((p_in < 128)::INT) AS rejected,
              string_agg(p_out, ',' ORDER BY i) AS px_out, string_agg(p_in, ',' ORDER BY i) AS px_in FROM vm GROUP BY ALL)"""


@query("expand_variants", with_blocks("SELECT vec_id, variant, op, rejected, CASE WHEN rejected THEN px_in ELSE px_out END AS pixels FROM ve", EXPAND))
def expand_variants(spark, sf):
    d = raster.expand_variants(rasters(spark, sf), "vec_id", 3)
    return d.select("vec_id", *big("variant"), "op", "rejected", F.array_join(F.transform("pixels", lambda p: p.cast("string")), ",").alias("pixels"))


DESCRIBE = _norm_sql("none") + """,
lp AS (SELECT a.vec_id, u.p + d.p + l.p + g.p - 4 * a.p AS v FROM px a
       JOIN px u ON u.vec_id = a.vec_id AND u.c = a.c AND u.r = abs(a.r - 1) JOIN px d ON d.vec_id = a.vec_id AND d.c = a.c AND d.r = 7 - abs(6 - a.r)
       JOIN px l ON l.vec_id = a.vec_id AND l.r = a.r AND l.c = abs(a.c - 1) JOIN px g ON g.vec_id = a.vec_id AND g.r = a.r AND g.c = 7 - abs(6 - a.c)),
sh AS (SELECT vec_id, floor((sum(v * v) * 64 - sum(v) * sum(v))::DOUBLE / 4096)::BIGINT AS s FROM lp GROUP BY vec_id),
dk AS (SELECT vec_id, sum(p * ((r = 0)::INT + (r = 7)::INT + (c = 0)::INT + (c = 7)::INT)) / 32.0::DOUBLE < 127.5 AS dark, count(DISTINCT p) AS lv FROM px GROUP BY vec_id),
db AS (SELECT count(*) AS n_images, 8.0::DOUBLE AS median_height, 8.0::DOUBLE AS median_width, quantile_cont(round(ink_frac, 4), 0.5) AS median_ink_frac, quantile_cont(lv, 0.5) AS median_levels,
              avg(dark::INT) AS share_dark_border, quantile_cont(s, 0.5) AS median_sharpness FROM nr JOIN dk USING (vec_id) JOIN sh USING (vec_id))"""


@query("describe_batch", with_blocks("SELECT n_images, median_height, median_width, round(median_ink_frac, 6) AS median_ink_frac, median_levels, round(share_dark_border, 6) AS share_dark_border, median_sharpness FROM db", DESCRIBE))
def describe_batch(spark, sf):
    d = triage.describe_batch(rasters(spark, sf))
    return d.select("n_images", "median_height", "median_width", *r6("median_ink_frac"), "median_levels", *r6("share_dark_border"), "median_sharpness")


PROBE = VIEWS + """,
vi1 AS (SELECT model, item_id, max(p1) FILTER (angle = 0) AS up, max(p1) AS best, max(angle) FILTER (k = 1) AS v
        FROM (SELECT *, row_number() OVER (PARTITION BY model, item_id ORDER BY p1 DESC, angle) AS k FROM vw) GROUP BY ALL),
vmod AS (SELECT model, v AS modal FROM (SELECT model, v, row_number() OVER (PARTITION BY model ORDER BY n DESC, v) AS k FROM (SELECT model, v, count(*) AS n FROM vi1 WHERE v <> 0 GROUP BY ALL)) WHERE k = 1),
vpr AS (SELECT model, count(*) AS n, avg(up) AS mean_conf_upright, avg(best) AS mean_conf_best, avg(best) - avg(up) AS lift, avg((up < 0.85)::INT) AS share_unsure, coalesce(any_value(modal), 0) AS modal_view,
               avg((v <> 0 AND abs(v - modal) <= 15)::INT) AS modal_share, avg((up >= best - 0.05)::INT) AS share_upright_ok FROM vi1 LEFT JOIN vmod USING (model) GROUP BY model)"""
_PV = ("mean_conf_upright", "mean_conf_best", "lift", "share_unsure", "modal_share", "share_upright_ok")


def _probe(spark, sf):
    return triage.view_probe(S.views_pred(spark, sf), ["item_id"], ["model"], "angle")


@query("view_probe", with_blocks("SELECT model, n, modal_view, " + ", ".join(f"round({c}, 6) AS {c}" for c in _PV) + " FROM vpr", PROBE))
def view_probe(spark, sf):
    return _probe(spark, sf).select("model", "n", *big("modal_view"), *r6(*_PV))


@query(
    "verdict",
    with_blocks(
        """SELECT model, row_number() OVER (PARTITION BY model ORDER BY k) - 1 AS step, finding FROM (
             SELECT model, 1 AS k, CASE WHEN modal_share >= 0.6 AND lift >= 0.08 THEN 'rotated' WHEN lift >= 0.08 THEN 'degraded' ELSE 'upright' END AS finding FROM vpr
             UNION ALL SELECT model, 2, CASE WHEN median_height < 12 THEN 'very_low_resolution' WHEN median_height < 18 THEN 'low_resolution' WHEN median_height > 120 THEN 'high_resolution' END FROM vpr, db
             UNION ALL SELECT model, 3, CASE WHEN share_dark_border > 0.3 THEN 'dark_border' END FROM vpr, db
             UNION ALL SELECT model, 4, CASE WHEN median_levels > 32 THEN 'greyscale' END FROM vpr, db
             UNION ALL SELECT model, 5, CASE WHEN median_ink_frac < 0.32 THEN 'thin_strokes' WHEN median_ink_frac > 0.56 THEN 'thick_strokes' END FROM vpr, db
             UNION ALL SELECT model, 6, CASE WHEN share_unsure > 0.5 THEN 'unconfident' END FROM vpr) WHERE finding IS NOT NULL""",
        PROBE, DESCRIBE.replace("po AS (", "pol AS (").replace("JOIN po USING", "JOIN pol USING").replace("FROM po LEFT", "FROM pol LEFT"),
    ),
)
def verdict(spark, sf):
    return triage.verdict(triage.describe_batch(rasters(spark, sf)), _probe(spark, sf)).select("model", *big("step"), "finding")


@query("write_ragged", with_blocks("SELECT label::BIGINT AS label, count(*) AS n, sum(p)::BIGINT AS total FROM px GROUP BY label", PX).replace("count(*) AS n", "count(DISTINCT vec_id) AS n"))
def write_ragged(spark, sf):
    from tallyforge.sources.sinks import glyph_rows, write_glyphs

    path = scratch_path(spark, "glyphs")
    write_glyphs(rasters(spark, sf), path, ["vec_id", "label"])
    total = F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, p: a + p)
    return glyph_rows(spark, path).groupBy(*big("label")).agg(F.count("*").alias("n"), F.sum(total).alias("total"))


@query("read_ragged_by_key", with_blocks("SELECT vec_id, sum(p)::BIGINT AS total FROM px WHERE vec_id IN (SELECT doc_id FROM labels) GROUP BY vec_id", PX))
def read_ragged_by_key(spark, sf):
    from tallyforge.sources.sinks import read_glyphs, write_glyphs

    path = scratch_path(spark, "glyphs")
    write_glyphs(rasters(spark, sf), path, ["vec_id", "label"])
    keys = table(spark, sf, "labels").select(F.col("doc_id").alias("vec_id"))
    return read_glyphs(spark, path, keys, "vec_id").select("vec_id", F.aggregate("pixels", F.lit(0).cast("bigint"), lambda a, p: a + p).alias("total"))
