"""Personal data replaced by keyed surrogates, with SQL functions only.

Detected: e-mail addresses, telephone numbers, payment cards (Luhn), IBANs (mod 97), social security
numbers, IP addresses, secrets (access keys, and values after words such as ``password=``) and names
after a title. A payment card or IBAN that fails its check, or an IP octet above 255, is left alone.

The steps:

1. *Detect* by one pattern with alternatives; each match gets a kind and a canonical value (digits of
   a number, an address in lower case), so all spellings of one entity are one entity.
2. *Draw.* The distinct entities of the corpus get surrogates from ``sha2(key:kind:value:round)``: digits
   stay digits, letters stay letters of their case and script, punctuation and the country code
   stay, cards and IBANs keep a valid check, a private address stays private, names keep the gender
   of the title. An e-mail domain and each part of a name are entities of their own, so that they
   are replaced alike wherever they occur.
3. *Check.* Surrogates that equal an entity of the corpus or another surrogate of their kind are drawn
   again (the smallest value keeps its surrogate) until none is left. Distinct entities stay
   distinct.
4. *Replace.* Only rows with an entity are joined with the surrogates; their texts are cut at the matches
   and put together again.
5. *Bare mentions.* Between the matches of a text, the words of its titled names (as written there, with a capital or in
   capitals) get the same surrogates, so "Mr. John Smith ... Smith said" names one made-up person throughout.

``n_entities`` counts the matches; a name without any titled mention in its text is not found.

Defined results: NULL stays NULL and an empty text stays empty, both with no entity; rows with a
NULL id and repeated rows are treated like any other and get the same surrogates; of two matches that could begin at one place (ties) the
first kind in the list counts; a very long text is one row like any other; an empty table gives
an empty result. Columns other than the text pass through; ``n_entities`` replaces one of its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.bounds import settle
from tallyforge.functions.vectors import let

ROUNDS = 40

# Patterns of what is detected, in the order in which they are tried.
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
PATTERNS = {
    "email": r"[\p{L}\p{N}_%+-](?:[\p{L}\p{N}._%+-]{0,62}[\p{L}\p{N}_%+-])?@[\p{L}\p{N}](?:[\p{L}\p{N}.-]{0,250}[\p{L}\p{N}])?\.\p{L}{2,24}",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "key": r"(?<![\p{L}\p{N}])(?:AKIA|ASIA|ghp_|gho_|sk_live_|xoxb-|xoxp-)[0-9A-Za-z_-]{12,}",
    "secret": r"(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?[0-9A-Za-z+/_.~-]{8,}",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}.-])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{L}}\p{{N}}.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[\p{{L}}\p{{N}}])",
    "name": r"(?<![\p{L}\p{N}])(?:Mr|Mister|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|Dr|Prof|Г-н|Г-жа|Господин|Госпожа)\.? \p{Lu}[\p{L}'-]{1,30}(?: \p{Lu}[\p{L}'-]{1,30})?",
}
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Г-жа|Госпожа"
MALE = "Mr|Mister|Herr|Monsieur|Señor|Г-н|Господин"
# A text without any of these holds no entity.
SIGNS = ["Mr", "Mister", "Mme", "Mrs", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Sra", "Dr", "Prof", "Г-", "Госп"]
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Sounds of made-up names.
LATIN = ["ba", "de", "fi", "go", "lu", "ma", "ne", "pi", "ro", "su", "ta", "ve", "wi", "ko", "da", "le"]
CYRILLIC = ["ба", "де", "фи", "го", "лу", "ма", "не", "пи", "ро", "су", "та", "ве", "ви", "ко", "да", "ле"]


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _mod(hexed: Column, i: Column, n: int | Column) -> Column:
    """Draw number i of a hash of 64 bytes: two hex digits, turned by the place, modulo n."""
    at = F.pmod(i, F.lit(60)) * 2 + 1
    return F.pmod(F.conv(F.substring(hexed, at, F.lit(6)), 16, 10).cast("bigint") + i, n if isinstance(n, Column) else F.lit(n)).cast("int")


def _pick(text: str, k: Column) -> Column:
    return F.substring(F.lit(text), k + 1, F.lit(1))


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn check, modulo 10."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    d = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 1, doubled(F.ascii(c) - 48)).otherwise(F.ascii(c) - 48))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10


def mod97(iban: Column) -> Column:
    """Remainder of an IBAN (without spaces) modulo 97: 1 if it is valid."""
    turned = _chars(F.concat(F.substring(iban, F.lit(5), F.lit(40)), F.substring(iban, 1, 4)))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, v: F.when(v > 9, a * 100 + v).otherwise(a * 10 + v) % 97
    return F.aggregate(F.transform(turned, value), F.lit(0), step)


def alike(value: Column, hexed: Column) -> Column:
    """A value with the same length, punctuation, kinds of characters and script."""
    hex_only = value.rlike("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{8,}$")

    def draw(c: Column, i: Column) -> Column:
        return (
            F.when(hex_only, _pick("0123456789abcdef", _mod(hexed, i, 16)))
            .when(c.rlike("[0-9]"), _pick("0123456789", _mod(hexed, i, 10)))
            .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", _mod(hexed, i, 26)))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _mod(hexed, i, 26)))
            .when(c.rlike("[а-я]"), _pick("абвгдежзиклмнопрстуфхцчшщэюя", _mod(hexed, i, 28)))
            .when(c.rlike("[А-Я]"), _pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ", _mod(hexed, i, 28)))
            .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _mod(hexed, i, 26)))
            .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", _mod(hexed, i, 26)))
            .otherwise(c)
        )

    return F.concat_ws("", F.transform(_chars(value), draw))


def kind_of(raw: Column) -> Column:
    """Kind of a match; NULL if its check fails."""
    whole = lambda k: raw.rlike(f"^(?:{PATTERNS[k]})$")
    squeezed = F.regexp_replace(raw, " ", "")
    return (
        F.when(raw.contains("@"), "email")
        .when(raw.rlike("^[A-Z]{2}[0-9]{2}") & whole("iban"), F.when(mod97(squeezed) == 1, "iban"))
        .when(raw.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk_live_|xoxb-|xoxp-)"), "key")
        .when(whole("secret"), "secret")
        .when(whole("phone"), F.when(F.length(digits_of(raw)).between(8, 15), "phone"))
        .when(whole("ssn"), "ssn")
        .when(whole("card"), F.when(luhn_sum(digits_of(raw)) == 0, "card"))
        .when(whole("ip"), "ip")
        .when(whole("name"), "name")
    )


def _secret_value(raw: Column) -> Column:
    return F.regexp_extract(raw, "([0-9A-Za-z+/_.~-]{8,})$", 1)


def _name_words(raw: Column) -> Column:
    return F.slice(F.split(raw, " "), F.lit(2), F.lit(2))


def gender(raw: Column) -> Column:
    """f, m or n from the title of a name."""
    return F.when(raw.rlike(f"^(?:{FEMALE})\\b"), "f").when(raw.rlike(f"^(?:{MALE})\\b"), "m").otherwise("n")


def parts_of(raw: Column) -> Column:
    """The entities in a match: array of (kind, value). A name of two words is a given name (with the
    title's gender) and a surname; of one word, a surname.
    """
    part = lambda k, v: F.struct(k.alias("kind"), v.alias("value"))
    kind = kind_of(raw)
    low = F.lower(raw)
    domain, local = F.regexp_extract(low, "@(.*)$", 1), F.regexp_extract(low, "^(.*)@", 1)
    words = _name_words(raw)
    given = part(F.concat(F.lit("given_"), gender(raw)), F.initcap(F.get(words, F.lit(0))))
    surname = part(F.lit("surname"), F.initcap(F.element_at(words, -1)))
    one = lambda v: F.array(part(kind, v))
    return (
        F.when(kind == "email", F.array(part(F.lit("mailbox"), F.concat(local, F.lit("@"), domain)), part(F.lit("domain"), domain)))
        .when(kind == "secret", F.array(part(F.lit("secret"), _secret_value(raw))))
        .when(kind.isin("phone", "card", "ssn"), one(digits_of(raw)))
        .when(kind == "iban", one(F.regexp_replace(raw, " ", "")))
        .when(kind.isin("key", "ip"), one(raw))
        .when(kind == "name", F.when(F.size(words) == 2, F.array(given, surname)).otherwise(F.array(surname)))
    )


def _name(hexed: Column, kind: Column, value: Column, rnd: Column) -> Column:
    """A made-up name of the script and gender; later rounds add sounds, so names never run out."""
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    sound = lambda i: F.when(cyrillic, F.element_at(F.array(*map(F.lit, CYRILLIC)), _mod(hexed, i, 16) + 1)).otherwise(F.element_at(F.array(*map(F.lit, LATIN)), _mod(hexed, i, 16) + 1))
    body = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(3) + F.floor(rnd / 2).cast("int")), sound))
    female = (kind == "given_f") | ((kind == "surname") & value.rlike("(?:ова|ева|ина|ская)$"))
    end = F.when(female, F.when(cyrillic, "на").otherwise("na")).when(kind == "given_n", F.when(cyrillic, "ль").otherwise("l")).otherwise(F.when(cyrillic, "нов").otherwise("n"))
    made = F.concat(body, end)
    return F.initcap(made)


def surrogate(kind: Column, value: Column, rnd: Column, key: str) -> Column:
    """Surrogate of a canonical value in canonical form."""
    seed = F.concat_ws(":", F.lit(key), kind, value, rnd.cast("string"))
    return let(F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256)), lambda h: _draw(kind, value, rnd, h))


def _draw(kind: Column, value: Column, rnd: Column, h: Column) -> Column:
    like = alike(value, h)
    body = F.concat(F.substring(value, 1, 1), F.substring(like, F.lit(2), F.length(value) - 2))
    check = F.pmod(-luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    account = F.substring(like, F.lit(5), F.length(value))
    country = F.substring(value, 1, 2)
    two = F.lpad((98 - mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    octets = F.split(value, "\\.")
    private = value.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.")
    fixed = F.when((rnd >= 4) & private, 0).when(value.rlike(r"^10\."), 1).when(value.rlike(r"^(?:192\.168|172\.(?:1[6-9]|2\d|3[01])|127\.0|169\.254)\."), 2).otherwise(0)
    # where the narrow ranges are used up, private addresses go to 10/8 and then all to the reserved 240/4
    first = F.when(rnd >= 8, F.lit(240) + _mod(h, F.lit(0), 15)).when(private, 10).otherwise(F.lit(11) + _mod(h, F.lit(0), 89))
    # short names of few letters grow when their space is used up
    more = F.concat_ws("", F.transform(F.slice(F.sequence(F.lit(0), F.lit(ROUNDS)), F.lit(1), (rnd / 4).cast("int")), lambda i: _pick("abcdefghijklmnopqrstuvwxyz", _mod(h, i + 30, 26))))
    octet = lambda x, i: F.when(i < fixed, x).when(i == 0, first.cast("string")).otherwise(_mod(h, i * 4, 254).cast("string"))
    mailbox = F.regexp_extract(value, "^(.*)@", 1)
    # what the reader takes a number for stays: the first digit is never a new zero
    lead = (F.lit(1) + _mod(h, F.lit(0), 9)).cast("string")
    number = F.when(value.startswith("0"), like).otherwise(F.concat(lead, F.substring(like, F.lit(2), F.length(value))))
    prefix = F.regexp_extract(value, "^(AKIA|ASIA|ghp_|gho_|sk_live_|xoxb-|xoxp-)", 1)
    end = F.regexp_extract(value, r"\.([^.]*)$", 1)
    return (
        F.when(kind == "card", F.concat(body, check))
        .when(kind == "iban", F.concat(country, two, account))
        .when(kind == "ip", F.concat_ws(".", F.transform(octets, octet)))
        .when(kind == "mailbox", F.concat(alike(mailbox, h), more, F.lit("@"), F.regexp_extract(value, "@(.*)$", 1)))
        .when(kind == "domain", F.concat(more, alike(F.substring(value, F.lit(1), F.length(value) - F.length(end)), h), end))
        .when(kind == "key", F.concat(prefix, F.substring(like, F.length(prefix) + 1, F.length(value))))
        .when(kind.startswith("given_") | (kind == "surname"), _name(h, kind, value, rnd))
        .when(kind == "ssn", number)
        .otherwise(like)
    )


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of every distinct (kind, value); no surrogate is an entity or another's surrogate.

    Each round draws for what is open, checks against the entities and against the surrogates given so
    far, and keeps the smallest value of those that drew alike. Names are compared over all kinds of
    names. A phone's first three digits may be a country code, which ``fit`` keeps.
    """
    family = F.when(F.col("kind").startswith("given_") | (F.col("kind") == "surname"), "name").otherwise(F.col("kind"))
    known = settle(entities.select("kind", "value").distinct().withColumn("family", family), "entities")
    taken = known.select("family", F.lower("value").alias("s")).distinct()
    given, open_ = None, known
    for rnd in range(ROUNDS):
        drawn = open_.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.lit(rnd), key)).withColumn("s", F.lower("surrogate"))
        first = Window.partitionBy("family", "s").orderBy("value", "kind")
        drawn = drawn.withColumn("place", F.row_number().over(first))
        busy = taken if given is None else taken.unionByName(given.select("family", "s"))
        drawn = settle(drawn.join(busy.distinct().withColumn("busy", F.lit(True)), ["family", "s"], "left"), "drawn")
        good = drawn.where("busy IS NULL AND place = 1").select("kind", "value", "family", "surrogate", "s")
        given = good if given is None else given.unionByName(good)
        open_ = drawn.where("busy OR place > 1").select("kind", "value", "family")
        if open_.isEmpty():
            return given.select("kind", "value", "surrogate")
    raise RuntimeError("surrogates still collide; use another key")


def fit(raw: Column, kind: Column, values: Column) -> Column:
    """The match with its surrogates in place; ``values`` are those of ``parts_of`` in order."""
    one = F.get(values, F.lit(0))
    # digits one after the other into the spelling of the match
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["s"], F.substring(one, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k")))
    spelled = F.aggregate(_chars(raw), start, step, lambda a: a["s"])
    spaced = F.aggregate(_chars(raw), start, lambda a, c: F.when(c == " ", F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))).otherwise(F.struct(F.concat(a["s"], F.substring(one, a["k"], F.lit(1))).alias("s"), (a["k"] + 1).alias("k"))), lambda a: a["s"])
    box = F.regexp_extract(one, "^(.*)@", 1)
    mail = F.concat(box, F.lit("@"), F.get(values, F.lit(1)))
    title = F.get(F.split(raw, " "), F.lit(0))
    cased = lambda v, w: F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(v)).otherwise(v)
    return (
        F.when(kind == "email", F.when(raw == F.upper(raw), F.upper(mail)).otherwise(mail))
        .when(kind.isin("phone", "card", "ssn"), spelled)
        .when(kind == "iban", spaced)
        .when(kind == "secret", F.concat(F.substring(raw, F.lit(1), F.length(raw) - F.length(_secret_value(raw))), one))
        .when(kind == "name", F.concat_ws(" ", title, F.array_join(F.zip_with(values, _name_words(raw), cased), " ")))
        .otherwise(one)
    )


def bare_names(parts: DataFrame) -> DataFrame:
    """(_n, _bare: array of (word, new)) from the parts of a text's matches with their surrogates: how its names read without a title.

    Of a word that is a given name and a surname the surname counts.
    """
    names = parts.where("match = 'name'")
    word = F.regexp_replace(F.element_at(_name_words(F.col("raw")), F.col("at") + 1), "'s?$", "")
    value = F.regexp_replace("value", "'s?$", "")
    form = lambda w, new: F.struct(w.alias("word"), new.alias("new"))
    upper = F.upper("surrogate")
    as_written = F.when((word == F.upper(word)) & (F.length(word) > 1), upper).otherwise(F.col("surrogate"))
    forms = F.array(form(word, as_written), form(value, F.col("surrogate")), form(F.upper(value), upper))
    spelled = names.select("_n", "kind", F.inline(forms)).where("length(word) > 1")
    one = spelled.groupBy("_n", "word").agg(F.min_by("new", F.struct(F.col("kind") != "surname", "kind", "new")).alias("new"))
    return one.groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("word", "new"))).alias("_bare"))


def _renamed(piece: Column, names: Column) -> Column:
    """The text with each of the words, standing alone, replaced. Surrogates are no entities, so no word is replaced twice."""
    alone = lambda w: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), w, F.lit(r"(?![\p{L}\p{N}])"))
    done = F.aggregate(names, piece, lambda text, n: F.regexp_replace(text, alone(n["word"]), n["new"]))
    return F.when(names.isNull(), piece).otherwise(done)


def may_hold(text: Column) -> Column:
    """A cheap test that no text with an entity fails."""
    found = text.rlike("[0-9@]") | text.rlike("(?i)(?:pass|pwd|secret|token|key)")
    for s in SIGNS:
        found = found | text.contains(s)
    return F.coalesce(found, F.lit(False))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text's entities replaced and their number in ``n_entities``."""
    columns = [c for c in docs.columns if c != "n_entities"]
    zero = F.lit(0).cast("bigint")
    text = F.col(text_col)
    found = F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    kept = lambda found: F.filter(F.transform(found, lambda r: F.struct(r.alias("raw"), kind_of(r).alias("kind"))), lambda x: x["kind"].isNotNull())
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    has = F.size(kept(found)) > 0
    clean = docs.where(~F.coalesce(has, F.lit(False))).select(*columns, zero.alias("n_entities"))
    marked = settle(docs.where(has).select(row, text.alias("_text"), kept(found).alias("_found"), F.monotonically_increasing_id().alias("_n")), "with-entities")

    matches = marked.select("_n", F.explode(F.array_distinct("_found")).alias("m")).select("_n", "m.raw", "m.kind")
    parts = matches.select("_n", "raw", F.col("kind").alias("match"), F.posexplode(parts_of(F.col("raw"))).alias("at", "p")).select("_n", "raw", "match", "at", "p.kind", "p.value")
    drawn = draw_surrogates(_canonical(parts), key)
    # the country code of a telephone number stays as it is
    joined = _canonical(parts).join(drawn, ["kind", "value"])
    code = F.regexp_extract("raw", r"^\+(\d{1,3})[ .(-]", 1)
    own = F.when(F.col("match") == "phone", F.concat(code, "surrogate")).otherwise(F.col("surrogate"))
    filled = joined.groupBy("_n", "raw", "match").agg(F.array_sort(F.collect_list(F.struct("at", own.alias("s")))).alias("ps"))
    filled = filled.select("_n", "raw", fit(F.col("raw"), F.col("match"), F.transform("ps", lambda p: p["s"])).alias("new"))
    maps = filled.groupBy("_n").agg(F.map_from_entries(F.collect_list(F.struct("raw", "new"))).alias("_new"))

    maps = maps.join(bare_names(joined), "_n", "left")

    pieces, every = F.split("_text", ANY, -1), F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))
    new = lambda m: F.coalesce(F.element_at(F.col("_new"), m), m)
    between = let(pieces, lambda ps: let(F.transform(every, new), lambda ms: F.concat_ws("", F.transform(ps, lambda p, i: F.concat(_renamed(p, F.col("_bare")), F.coalesce(F.get(ms, i), F.lit("")))))))
    done = marked.join(maps, "_n").withColumn("_done", between)
    out = [F.col("_done").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in columns]
    return done.select(*out, F.size("_found").cast("bigint").alias("n_entities")).unionByName(clean)


def _canonical(parts: DataFrame) -> DataFrame:
    """Telephone numbers without their country code, which stays."""
    code = F.length(F.regexp_extract("raw", r"^\+(\d{1,3})[ .(-]", 1))
    return parts.withColumn("value", F.when(F.col("kind") == "phone", F.substring("value", code + 1, F.length("value"))).otherwise(F.col("value")))
