"""Name, code, label and version queries."""

from pyspark.sql import functions as F

from tallyforge.functions.bounds import Classes
from tallyforge.functions.hashing import hash_hex
from tallyforge.operators import clean, codec, overlay
from tallyforge.plans import corpus as C
from tallyforge.plans.base import query, table, with_blocks

_LANGS = {"de": "de", "en": "en", "es": "es", "fr": "fr"}


@query(
    "class_codec",
    """WITH c AS (SELECT 161 + substr(source, 4)::BIGINT AS code, count(*) AS n FROM documents GROUP BY 1)
       SELECT code, chr((3584 + code - 160)::INT) AS char, code - 160 + 160 AS back, dense_rank() OVER (ORDER BY code) - 1 AS label, n FROM c""",
)
def class_codec(spark, sf):
    d = C.documents(spark, sf).select((F.substring("source", 4, 9).cast("int") + 161).alias("code"))
    dim = codec.class_dim(d)
    n = d.groupBy("code").agg(F.count("*").alias("n"))
    return dim.join(n, "code").select(
        F.col("code").cast("bigint").alias("code"), "char", codec.code_of(F.col("char")).cast("bigint").alias("back"),
        F.col("label").cast("bigint").alias("label"), "n",
    )


_RANGES = (("lower", 97, 122), ("upper", 65, 90), ("digit", 48, 57), ("ascii_other", 0, 127), ("latin", 128, 591), ("beyond", 592, 1114111))


@query(
    "categorise",
    """SELECT CASE WHEN p BETWEEN 97 AND 122 THEN 'lower' WHEN p BETWEEN 65 AND 90 THEN 'upper' WHEN p BETWEEN 48 AND 57 THEN 'digit'
              WHEN p BETWEEN 0 AND 127 THEN 'ascii_other' WHEN p BETWEEN 128 AND 591 THEN 'latin' ELSE 'beyond' END AS category, count(*) AS n
       FROM (SELECT unicode(unnest(string_split(text, ''))) AS p FROM documents) WHERE p >= 0 GROUP BY 1""",
)
def categorise(spark, sf):
    chars = C.documents(spark, sf).select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    # count characters first, then name the few distinct ones
    counts = chars.groupBy("c").agg(F.count("*").alias("n"))
    named = counts.withColumn("category", codec.categorise(F.ascii("c").cast("bigint"), _RANGES))
    return named.groupBy("category").agg(F.sum("n").alias("n"))


@query(
    "parse_name",
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^(https?)://(?:www\.|m\.|blog\.)?([^/]+)/([a-z]{2})/(\d+)', ['scheme', 'host', 'lang', 'num']) AS g, url FROM pages)
        SELECT page_id, nullif(g.scheme, '') AS prefix, try_cast(nullif(g.num, '') AS INTEGER) AS doc_no, nullif(g.lang, '') AS subset,
               CASE WHEN g.scheme <> '' THEN g.scheme || '_' || g.num END AS grp, g.scheme <> '' AS parsed FROM u""",
)
def parse_name(spark, sf):
    # the operator's parts by place: prefix, number (seen ahead), subset, and no line or index
    pattern = r"^(https?)://(?=[^/]+/[a-z]{2}/(\d+))(?:www\.|m\.|blog\.)?[^/]+/([a-z]{2})/\d+()()"
    parts = table(spark, sf, "pages").select("page_id", *codec.parse_name(F.col("url"), pattern))
    return parts.select("page_id", "prefix", F.col("doc_id").alias("doc_no"), "subset", F.col("group").alias("grp"), "parsed")


@query(
    "parse_corpus_name",
    r"""WITH n AS (SELECT doc_id, (CASE WHEN left(md5('name:' || doc_id), 1) = '0' THEN 'Copy of ' ELSE '' END) || 'be_' || lpad((doc_id % 1000)::VARCHAR, 3, '0')
                    || (CASE WHEN lang = 'en' THEN 'sg' WHEN lang = 'fr' THEN 'tg' ELSE 'xx' END) || '_' || n_chars || '_' || doc_id || '.jpg' AS name, lang, n_chars FROM documents)
        SELECT doc_id, CASE WHEN ok THEN 'be' END AS prefix, CASE WHEN ok THEN doc_id % 1000 ELSE -1 END AS number, CASE WHEN ok THEN CASE lang WHEN 'en' THEN 'sg' ELSE 'tg' END END AS subset,
               CASE WHEN ok THEN n_chars ELSE -1 END AS line, CASE WHEN ok THEN doc_id ELSE -1 END AS idx, left(md5('name:' || doc_id), 1) = '0' AS is_copy,
               CASE WHEN ok THEN 'be_' || lpad((doc_id % 1000)::VARCHAR, 3, '0') END AS grp, ok AS parsed
        FROM (SELECT *, lang IN ('en', 'fr') AS ok FROM n)""",
)
def parse_corpus_name(spark, sf):
    d = C.documents(spark, sf)
    name = F.concat(
        F.when(F.substring(hash_hex("name", "doc_id"), 1, 1) == "0", "Copy of ").otherwise(""), F.lit("be_"),
        F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"),
        F.when(F.col("lang") == "en", "sg").when(F.col("lang") == "fr", "tg").otherwise("xx"),
        F.lit("_"), F.col("n_chars"), F.lit("_"), F.col("doc_id"), F.lit(".jpg"),
    )
    out = d.select("doc_id", name.alias("name")).select("doc_id", *codec.parse_name(F.col("name")))
    big = [F.coalesce(F.col(c).cast("bigint"), F.lit(-1).cast("bigint")).alias(a) for c, a in (("doc_id_1", "number"), ("line", "line"), ("idx", "idx"))]
    out = out.toDF("doc_id", "prefix", "doc_id_1", "subset", "line", "idx", "is_copy", "grp", "parsed")
    return out.select("doc_id", "prefix", big[0], "subset", big[1], big[2], "is_copy", "grp", "parsed")


@query(
    "label_from_path",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/(\d+)', ['lang', 'num']) AS g FROM pages),
         q AS (SELECT page_id, g.lang AS lang, regexp_extract(g.num, '(\d{2,3})', 1) AS num FROM p)
        SELECT page_id, CASE WHEN try_cast(nullif(num, '') AS BIGINT) BETWEEN 100 AND 400 THEN try_cast(num AS BIGINT)::VARCHAR
                             WHEN lang IN ('de', 'en', 'es', 'fr') THEN lang END AS label FROM q""",
)
def label_from_path(spark, sf):
    # folders host/en/431: the number is the innermost name, the language folder is one out
    path = F.concat(F.regexp_replace("url", r"[#?].*$", ""), F.lit("/-.html"))
    number = codec.label_from_path(path, range(100, 401), {})
    lang = F.regexp_extract("url", r"^https?://[^/]+/([a-z]{2})/", 1)
    return table(spark, sf, "pages").select("page_id", F.coalesce(number, F.when(lang.isin(*_LANGS), lang)).alias("label"))


@query(
    "label_from_path_characters",
    r"""SELECT doc_id, CASE lang WHEN 'de' THEN 'sharp' WHEN 'es' THEN 'tilde' WHEN 'fr' THEN 'cedilla'
              ELSE CASE WHEN try_cast(nullif(regexp_extract(doc_id::VARCHAR, '(\d{2,3})', 1), '') AS BIGINT) BETWEEN 10 AND 400 THEN try_cast(regexp_extract(doc_id::VARCHAR, '(\d{2,3})', 1) AS BIGINT)::VARCHAR END END AS label
       FROM documents""",
)
def label_from_path_characters(spark, sf):
    """Folders named by a class character, as in scans/mañana/17.png; without one the file's number decides."""
    folder = F.create_map(*[F.lit(x) for kv in {"de": "groß", "es": "mañana", "fr": "façade", "en": "plain"}.items() for x in kv])
    path = F.concat_ws("/", F.lit("scans"), F.element_at(folder, F.col("lang")), F.concat(F.col("doc_id"), F.lit(".png")))
    label = codec.label_from_path(path, range(10, 401), {"ß": "sharp", "ñ": "tilde", "ç": "cedilla"})
    return C.documents(spark, sf).select("doc_id", label.alias("label"))


@query(
    "parse_external_folders",
    """SELECT doc_id, lang AS orig_label, n_chars % 300 AS code, CASE WHEN n_chars % 7 = 0 THEN '' ELSE 'P-' || lpad(doc_id::VARCHAR, 6, '0') END AS writer_id
       FROM documents WHERE lang <> 'en' OR n_chars % 2 = 0""",
)
def parse_external_folders(spark, sf):
    """Archive paths of the second scheme; every other English one is damaged (no code, no image or too short)."""
    code, even = (F.col("n_chars") % 300).cast("string"), F.col("n_chars") % 2 == 0
    folder = F.concat_ws("-", F.lit("set2"), code, F.lit("x"), "lang", F.lit("more"))
    writer = F.when(F.col("n_chars") % 7 == 0, F.lit("none")).otherwise(F.concat(F.lit("P-"), F.lpad(F.col("doc_id").cast("string"), 6, "0")))
    good = F.concat(F.lit("all/"), folder, F.lit("/Set2_F1_"), writer, F.lit("_23.JPG"))
    damage = F.col("n_chars") % 3
    bad = F.when(damage == 0, F.regexp_replace(good, "set2-[0-9]+", "set2-z")).when(damage == 1, F.concat(good, F.lit(".txt"))).otherwise(F.concat(folder, F.lit(".jpg")))
    d = C.documents(spark, sf).select("doc_id", F.when((F.col("lang") == "en") & ~even, bad).otherwise(good).alias("path"))
    return codec.parse_external_folders(d, "path").select("doc_id", "orig_label", F.col("code").cast("bigint").alias("code"), "writer_id")


@query(
    "label_from_manifest",
    """SELECT d.doc_id, 'docs/' || d.lang || '/' || d.doc_id || '.txt' AS path, l.quality::VARCHAR AS label FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def label_from_manifest(spark, sf):
    d = C.documents(spark, sf).select("doc_id", F.concat_ws("/", F.lit("docs"), "lang", F.concat(F.col("doc_id"), F.lit(".txt"))).alias("path"))
    side = table(spark, sf, "labels").select(F.concat(F.lit("any/"), F.col("doc_id"), F.lit(".txt")).alias("file"), F.col("quality").alias("label"))
    return codec.label_from_manifest(d, side, "path", "file")


@query(
    "normalise_name",
    """SELECT p_partkey, lower(p_type) || ' ' || (p_size % 3) AS norm_name,
              CASE WHEN p_size % 3 = 2 THEN NULL WHEN p_type IN ('PROMO', 'LARGE', 'SMALL') THEN left(p_type, 1) || '-' || (p_size % 3) END AS class FROM part""",
)
def normalise_name(spark, sf):
    part = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("  Thai  Character "), F.col("p_type"), F.lit("_-"), (F.col("p_size") % 3)).alias("raw")
    )
    aliases = [(f"{t.lower()}-{i}", f"{t[0]}-{i}") for t in ("PROMO", "LARGE", "SMALL") for i in (0, 1)]
    side = spark.createDataFrame(aliases, "alias string, class string")
    return codec.normalise_name(part, "raw", side, alias_rows=len(aliases)).select("p_partkey", "norm_name", "class")


@query(
    "parse_external_names",
    """SELECT doc_id, lang AS orig_label, n_chars % 300 AS code, doc_id::VARCHAR AS writer_id FROM documents WHERE lang IN ('en', 'fr')
       UNION ALL SELECT doc_id, lang, n_chars % 300, 'P-' || lpad(doc_id::VARCHAR, 6, '0') FROM documents WHERE lang = 'de'""",
)
def parse_external_names(spark, sf):
    code = (F.col("n_chars") % 300).cast("string")
    name = (
        F.when(F.col("lang").isin("en", "fr"), F.concat_ws("-", "lang", code, "source", F.concat(F.col("doc_id"), F.lit(".png"))))
        .when(F.col("lang") == "de", F.concat_ws("-", "lang", code, F.lit("Set2_P"), F.concat(F.lpad(F.col("doc_id").cast("string"), 6, "0"), F.lit("_1.jpg"))))
        .otherwise(F.concat_ws("-", "lang", F.lit("x"), F.col("doc_id")))
    )
    d = C.documents(spark, sf).select("doc_id", name.alias("name"))
    return codec.parse_external_names(d, "name").select("doc_id", "orig_label", F.col("code").cast("bigint").alias("code"), "writer_id")


@query(
    "family_of",
    """SELECT source, lang, 'Set2_' || source AS writer, source AS family, count(*) AS n FROM documents GROUP BY source, lang""",
)
def family_of(spark, sf):
    d = C.documents(spark, sf)
    font = F.concat(F.col("source"), F.lit("-"), F.col("lang"), F.lit("[wght].ttf"))
    hand = F.concat(F.lit("Set2_"), F.col("source"), F.lit("_17.JPG"))
    d = d.select("source", "lang", codec.family_of(font).alias("family"), codec.writer_key(hand).alias("writer"))
    return d.groupBy("source", "lang", "writer", "family").agg(F.count("*").alias("n"))


@query("writer_key", "SELECT DISTINCT 'Set2_' || source AS writer, 'Set2_' || source || '_17.JPG' AS name FROM documents")
def writer_key(spark, sf):
    name = F.concat(F.lit("Set2_"), F.col("source"), F.lit("_17.JPG"))
    d = C.documents(spark, sf).select(name.alias("name")).distinct()
    return d.select(codec.writer_key(F.col("name")).alias("writer"), "name")


@query("drop_derived", with_blocks("SELECT doc_id, name FROM named WHERE name NOT LIKE 'aug\\_%' ESCAPE '\\'", C.NAMED))
def drop_derived(spark, sf):
    return codec.drop_derived(C.documents(spark, sf).select("doc_id", C.item_name().alias("name")), "name")


@query(
    "universe_partition",
    """SELECT doc_id, lang, lang IN ('en', 'fr') AS in_universe, CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1
              ELSE 1 + dense_rank() OVER (PARTITION BY lang IN ('en', 'fr') ORDER BY lang) END::BIGINT AS label FROM documents""",
)
def universe_partition(spark, sf):
    out = codec.universe_partition(C.documents(spark, sf).select("doc_id", "lang"), "lang", Classes.of(spark, ["en", "fr"]))
    return out.withColumn("label", F.col("label").cast("bigint"))


@query(
    "parse_pair",
    with_blocks(
        """SELECT pair, a, b, a IN (SELECT lang FROM documents) AND b IN (SELECT lang FROM documents) AS valid, n FROM (
             SELECT d.lang || ' > ' || coalesce(r.lang, 'none') AS pair, d.lang AS a, coalesce(r.lang, 'none') AS b, count(*) AS n
             FROM documents d LEFT JOIN relabelled r USING (doc_id) GROUP BY ALL)""",
        C.RELABELLED,
    ),
)
def parse_pair(spark, sf):
    a = C.documents(spark, sf).select("doc_id", "lang")
    b = C.relabelled(spark, sf).select("doc_id", F.col("lang").alias("new"))
    pairs = a.join(b, "doc_id", "left").groupBy(F.concat_ws(" > ", "lang", F.coalesce("new", F.lit("none"))).alias("pair")).agg(F.count("*").alias("n"))
    return codec.parse_pair(pairs, "pair", C.langs(spark, sf)).select("pair", "a", "b", "valid", "n")


@query(
    "geometry_features",
    """SELECT vec_id, round(ln(len(embedding)), 6) AS ln_w, round(ln(n::DOUBLE), 6) AS ln_h, round(ln(len(embedding) / n::DOUBLE), 6) AS ln_aspect, round(n / 64.0::DOUBLE, 6) AS ink
       FROM (SELECT vec_id, embedding, 1 + len(list_filter(embedding, lambda x: x < 0)) AS n FROM embeddings)""",
)
def geometry_features(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.size("embedding").alias("w"), (F.lit(1) + F.size(F.filter("embedding", lambda x: x < 0))).alias("h")
    )
    g = e.select("vec_id", codec.geometry_features(F.col("w"), F.col("h"), F.col("h") / F.lit(64.0)).alias("g"))
    return g.select("vec_id", *[F.round(F.get("g", F.lit(i)), 6).alias(n) for i, n in enumerate(("ln_w", "ln_h", "ln_aspect", "ink"))])


@query("join_class_dim", "SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::BIGINT AS label FROM documents")
def join_class_dim(spark, sf):
    out = codec.join_class_dim(C.documents(spark, sf).select("doc_id", "lang"), "lang", C.langs(spark, sf))
    return out.withColumn("label", F.col("label").cast("bigint"))


@query(
    "attach_source",
    """SELECT d.doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'w' || l.quality || '-' || l.toxic || '.png' END, '') AS source_name,
              coalesce('w' || l.quality, '') AS family FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def attach_source(spark, sf):
    d = C.documents(spark, sf).select("doc_id", F.concat(F.lit("a\\"), F.col("doc_id")).alias("path"))
    shipped = table(spark, sf, "labels").select(
        F.concat(F.lit("a/"), F.col("doc_id")).alias("path"),
        F.concat(F.lit("w"), F.col("quality"), F.lit("-"), F.col("toxic"), F.lit(".png")).alias("source_name"),
    )
    return overlay.attach_source(d, shipped, "path", "source_name").select("doc_id", "source_name", "family")


@query(
    "anti_conflicts",
    "SELECT doc_id, source FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1)",
)
def anti_conflicts(spark, sf):
    d = C.documents(spark, sf).select("doc_id", "source", F.md5("text").alias("h"))
    per = d.groupBy("h").agg(F.count("*").alias("n"), F.min("source").alias("a"), F.max("source").alias("b"))
    bad = per.where("a <> b").select("h", "n")
    return overlay.drop_groups(d, bad, "h", "doc_id").select("doc_id", "source")


@query(
    "semi_cache",
    """SELECT 'docs::' || doc_id AS doc_id, lang, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_dropped
       FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def semi_cache(spark, sf):
    kept, counts = overlay.semi_cache_counted(C.documents(spark, sf).select("doc_id", "lang"), table(spark, sf, "labels"), "doc_id", "doc_id", "docs")
    return kept.withColumn("n_dropped", F.lit(counts["n_dropped"]).cast("bigint"))


@query(
    "merge_sources",
    """SELECT 'docs::' || doc_id AS key, 'docs' AS origin, lang, NULL::VARCHAR AS role FROM documents
       UNION ALL SELECT 'talk::' || conv_id || '/' || turn, 'talk', NULL, role FROM conversations""",
)
def merge_sources(spark, sf):
    a = C.documents(spark, sf).select(F.col("doc_id").alias("key"), "lang")
    b = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("key"), "role")
    return overlay.merge_sources([a, b], ["docs", "talk"], "key")


@query(
    "existence_filter",
    """SELECT lang, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS n_present, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS n_absent
       FROM documents GROUP BY lang""",
)
def existence_filter(spark, sf):
    idx = C.documents(spark, sf).select("doc_id", "lang")
    marked = clean.existence_marks(idx, table(spark, sf, "labels"), "doc_id", "doc_id")
    return marked.groupBy("lang").agg(F.count_if("present").alias("n_present"), F.count_if(~F.col("present")).alias("n_absent"))


@query(
    "reconcile_manifest",
    """WITH m AS (SELECT doc_id AS key, source || '-' || lang AS name, md5(text) AS md5 FROM documents),
         c AS (SELECT 'b/' || lpad(doc_id::VARCHAR, 12, '0') AS path, source || '-' || lang AS name, md5(text) AS md5 FROM documents JOIN labels USING (doc_id)),
         r AS (SELECT m.key, m.name, m.md5, c.path, c.md5 = m.md5 AS hit, row_number() OVER (PARTITION BY m.key ORDER BY coalesce(c.md5 = m.md5, false) DESC, c.path) AS r,
                      count(c.path) OVER (PARTITION BY m.key) AS n FROM m LEFT JOIN c USING (name))
       SELECT key, name, n AS n_candidates, path, coalesce(hit, false) AS verified,
              CASE WHEN path IS NULL THEN 'missing' WHEN hit THEN 'verified' ELSE 'mismatch' END AS status FROM r WHERE r = 1""",
)
def reconcile_manifest(spark, sf):
    d = C.documents(spark, sf)
    name = F.concat_ws("-", "source", "lang")
    m = d.select(F.col("doc_id").alias("key"), name.alias("name"), F.md5("text").alias("md5"))
    files = d.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(
        F.concat(F.lit("b/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), name.alias("name"), F.md5("text").alias("md5")
    )
    return clean.reconcile_manifest(m, files)


_DIFF = """
a AS (SELECT doc_id AS key, left(md5(text), 8) AS name, lang FROM documents),
b AS (SELECT left(md5(text), 8) AS name, lang FROM relabelled),
df AS (SELECT a.name, n_a, key, old_class, coalesce(n_b, 0) AS n_b, new_class,
         CASE WHEN n_a > 1 THEN 'ambiguous' WHEN n_b IS NULL THEN 'drop' WHEN n_b > 1 THEN 'ambiguous' WHEN old_class <> new_class THEN 'move' ELSE 'same' END AS action
       FROM (SELECT name, count(*) AS n_a, min(key) AS key, min(lang) AS old_class FROM a GROUP BY 1) a
       LEFT JOIN (SELECT name, count(*) AS n_b, min(lang) AS new_class FROM b GROUP BY 1) b ON a.name = b.name)
"""


def _diff(spark, sf):
    name = F.substring(F.md5("text"), 1, 8).alias("name")
    a = C.documents(spark, sf).select("doc_id", name, "lang")
    b = C.relabelled(spark, sf).select(name, "lang")
    return overlay.diff_labels(a, b, "doc_id", "name", "lang")


@query("diff_labels", with_blocks("SELECT * FROM df", C.RELABELLED, _DIFF))
def diff_labels(spark, sf):
    return _diff(spark, sf)


@query(
    "overlay_changes",
    with_blocks(
        """SELECT doc_id, CASE WHEN df.action = 'move' THEN df.new_class ELSE d.lang END AS lang,
             (SELECT count(DISTINCT lang) FROM documents x WHERE x.lang < CASE WHEN df.action = 'move' THEN df.new_class ELSE d.lang END) AS label
           FROM documents d LEFT JOIN df ON df.key = d.doc_id AND df.action IN ('move', 'drop') WHERE coalesce(df.action, '') <> 'drop'""",
        C.RELABELLED, _DIFF,
    ),
)
def overlay_changes(spark, sf):
    changes = overlay.change_list(_diff(spark, sf))
    out = overlay.overlay_changes(C.documents(spark, sf).select("doc_id", "lang"), changes, "doc_id", "lang", C.langs(spark, sf))
    return out.withColumn("label", F.col("label").cast("bigint"))


@query(
    "resolve_labels",
    """WITH pc AS (SELECT quality, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
       SELECT count(*) AS n_items, count(l.doc_id) AS n_resolved, count(*) - count(l.doc_id) AS n_unresolved,
              (SELECT count(DISTINCT quality) FROM labels JOIN documents USING (doc_id)) AS n_classes_present,
              3 - (SELECT count(DISTINCT quality) FROM labels JOIN documents USING (doc_id)) AS n_classes_absent,
              (SELECT min(n) FROM pc) AS min_per_class, (SELECT quantile_cont(n, 0.5) FROM pc) AS median_per_class, (SELECT max(n) FROM pc) AS max_per_class
       FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def resolve_labels(spark, sf):
    from tallyforge.operators.triage import resolve_labels as op

    d = C.documents(spark, sf).select("doc_id").join(
        table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label")), "doc_id", "left"
    )
    return op(d, "label", Classes.of(spark, ["0", "1", "2"]))
