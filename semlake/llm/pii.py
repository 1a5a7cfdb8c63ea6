"""Personal data: detection and keyed surrogates, with DataFrame functions only.

Entities are found by one pattern.  Each is reduced to a canonical form (an email in lower case, a phone number's
digits, the parts of a name), so that one entity written in several ways stays one.  A canonical form gets a keyed
surrogate of its type: digits for digits, cards and bank accounts with right check digits, names of the same gender and
script, addresses that parse.  Surrogates that
meet another surrogate or a real entity of the type are drawn again until none do, over the whole corpus.  The
surrogate is then put into the format of each mention, and the texts that hold any are rewritten; other texts pass
through without a shuffle.

Names are found by titles, given names and phrases that introduce a name.  The words of a name that a text holds once are
then found wherever they stand alone in it, and get the same surrogates; a title gives the gender of the given name that
follows it, for the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semlake.llm.common import discard, materialise, respread

#: Session setting that holds the secret key; without it the key is the public one below, for tests and demonstrations.
KEY_SETTING = "spark.semlake.pii.key"
PUBLIC_KEY = "public-demonstration-key"
#: Draws before giving up with an error; each one widens names, and a clash is rare in the other types.
DRAWS = 40
#: Given names by gender, Latin and Cyrillic.
FEMALE = "Mary Anna Maria Elizabeth Sarah Emma Laura Julia Sophie Marie Claire Camille Isabel Carmen Lucia Elena Katharina Ursula Monika Jane Susan Linda Karen Nancy Lisa Helen Alice Grace Rachel Laure Hélène Nathalie Pilar Rosa Teresa Sabine Petra Анна Мария Елена Ольга Наталья Татьяна".split()
MALE = "John James Robert Michael William David Thomas Peter Paul Pierre Jean Luc Carlos Juan Pedro Miguel Hans Klaus Jürgen Stefan Richard Charles Joseph George Henry Edward Daniel Andrew Martin Simon François Antoine Javier Antonio Manuel Wolfgang Dieter Uwe Иван Дмитрий Сергей Алексей Николай Михаил".split()
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr")
OTHER_TITLES = ("Dr", "Prof", "Doctor", "Professor")
#: What introduces a name.
CUES = ("my name is ", "My name is ", "Name: ", "Signed, ")
SYLLABLES = "ba be bi bo da de di do fa fe ka ke la le li lo ma me mi mo na ne no ra re ri ro sa se ta".split()
CYRILLIC = "ба бе би бо да де ди до ва ве ка ке ла ле ли ло ма ме ми мо на не но ра ре ри ро са се та".split()

#: Each alternative begins with a look at the next character, so that most places cost one test.  A group under a
#: repetition is possessive or counted: the JVM's matcher recurses over any other, and long texts would end its stack.
_NAME = r"\p{Lu}[\p{L}'’-]+"
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?=[\p{N}.-]*+\p{L})[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
_SECRET = r"(?=[0-9a-fA-Fgs])(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,})(?![\p{L}\p{N}])"
_IBAN = r"(?=[A-Z]{2}\d)(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\p{N}])"
_IP6 = r"(?=[0-9A-Fa-f])(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
_IP = r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
_CARD = r"(?=\d)(?<![\d+.])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)"
_SSN = r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?=[+(\d])(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
_CAPITAL = r"(?=[A-ZЀ-Я])(?<!\p{L})"
_TITLES = "|".join(FEMALE_TITLES + MALE_TITLES + OTHER_TITLES)
_TITLED = rf"{_CAPITAL}(?:{_TITLES})\.? (?:(?:{_TITLES})\.? )?{_NAME}(?: {_NAME})?"
_GIVEN = rf"{_CAPITAL}(?:{'|'.join(FEMALE + MALE)}) {_NAME}(?: {_NAME})?"
_CUED = "|".join(rf"(?<={c}){_NAME}(?: {_NAME})?" for c in CUES)
PATTERN = "|".join((_EMAIL, _SECRET, _IBAN, _IP6, _IP, _CARD, _SSN, _PHONE, _TITLED, _GIVEN, _CUED))
#: Every text with an entity meets this; it is cheap, so the pattern runs on the few texts that do.
TRIGGER = rf"[@0-9]|[a-fA-F]{{32}}|[a-fA-F]:[a-fA-F]|sk-|gh[pousr]_|AKIA|{_CAPITAL}(?:{'|'.join([_TITLES, *FEMALE, *MALE])})[. ]|{'|'.join(CUES)}"
_TITLE = rf"^(?:{_TITLES})\.?$"
#: Begins the mention of a name's word that stands alone, with its role in the text: f, m or n for given names, else s.
_ALONE = "\u0001"


def mentions(text: Column) -> Column:
    """Every entity of a text that the pattern finds, in order, as it is written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def _titled(words: Column) -> tuple[Column, Column]:
    """Titles before the words of a name, and the gender that these give: f, m or null."""
    is_title = lambda w: F.coalesce(w.rlike(_TITLE), F.lit(False))
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    n = F.when(is_title(first) & is_title(second), 2).when(is_title(first), 1).otherwise(0)
    of = lambda titles: F.exists(F.slice(words, F.lit(1), n), lambda w: w.rlike(rf"^(?:{'|'.join(titles)})\.?$"))
    return n, F.when(of(FEMALE_TITLES), "f").when(of(MALE_TITLES), "m")


def name_words(found: Column) -> Column:
    """The words of the names among a text's mentions, as structs of word and role."""

    def roles(raw: Column) -> Column:
        words = F.split(raw, " ")
        n, gender = _titled(words)
        role = lambda w, i: (
            F.when((i == n) & w.isin(FEMALE), "f").when((i == n) & w.isin(MALE), "m").when((i == n) & (F.size(words) > n + 1), F.coalesce(gender, F.lit("n"))).otherwise("s")
        )
        return F.filter(F.transform(words, lambda w, i: F.struct(F.when(i >= n, w).alias("word"), role(w, i).alias("role"))), lambda x: F.length(x["word"]) > 1)

    names = F.filter(found, lambda r: r.rlike(r"^\p{Lu}[\p{L}'’. -]*$"))
    return F.array_distinct(F.flatten(F.transform(names, roles)))


def pattern_of(words: Column) -> Column:
    """The pattern of one text: the general one, then the words of its names wherever they stand alone."""
    each = F.array_sort(F.array_distinct(F.flatten(F.transform(words, lambda x: F.array(x["word"], F.upper(x["word"]))))), lambda a, b: F.length(b) - F.length(a))
    return F.when(F.size(words) > 0, F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}'’-])(?:"), F.array_join(each, "|"), F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(PATTERN))


def marked(found: Column, words: Column) -> Column:
    """Mentions with those that are a name's word alone marked with its role in the text (given names first)."""
    role = lambda r: F.array_min(F.transform(F.filter(words, lambda x: (x["word"] == r) | (F.upper(x["word"]) == r)), lambda x: x["role"]))
    return F.transform(found, lambda r: F.coalesce(F.concat(F.lit(_ALONE), role(r), r), r))


def entity_type(raw: Column) -> Column:
    whole = lambda p: raw.rlike(f"^(?:{p})$")
    return (
        F.when(raw.contains("@"), "email")
        .when(whole(_SECRET), "secret")
        .when(whole(_IBAN), "iban")
        .when(whole(_IP6), "ip6")
        .when(whole(_IP), "ip")
        .when(whole(_CARD), "card")
        .when(whole(_SSN), "ssn")
        .when(whole(_PHONE), "phone")
        .otherwise("name")
    )


def parts(raws: DataFrame) -> DataFrame:
    """``raws(raw)`` -> ``(raw, at, type, piece, canon)``: names by word, the others whole; titles stay (null canon)."""
    alone = F.col("raw").startswith(_ALONE)
    kind = F.when(alone, "name").otherwise(entity_type(F.col("raw")))
    cut = F.when(alone, F.array(F.substr("raw", F.lit(3)))).when(F.col("type") == "name", F.split("raw", " ")).otherwise(F.array("raw"))
    out = raws.withColumn("type", kind).withColumn("cut", cut)
    titles, gender = _titled(F.col("cut"))
    own = F.when(alone, F.substr("raw", F.lit(2), F.lit(1)))
    out = out.withColumns({"titles": F.when(alone, 0).otherwise(titles), "gender": gender, "own": own, "words": F.size("cut")})
    out = out.select("raw", "type", "titles", "gender", "own", "words", F.posexplode("cut").alias("at", "piece"))
    title = F.col("at") < F.col("titles")
    given = F.col("at") == F.col("titles")
    listed = F.when(F.col("piece").isin(FEMALE), "f").when(F.col("piece").isin(MALE), "m")
    # the first of several words is a given name: gendered by the list, else by the title
    role = F.coalesce("own", F.when(given, F.coalesce(listed, F.when(F.col("words") > F.col("titles") + 1, F.coalesce("gender", F.lit("n"))))), F.lit("s"))
    role = F.when(role == "s", "surname").otherwise(F.concat(F.lit("given-"), role))
    script = F.when(F.col("piece").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    full = F.when(F.col("type") == "name", F.concat_ws("/", F.lit("name"), role, script)).otherwise(F.col("type"))
    canon = (
        F.when((F.col("type") == "name") & title, None)
        .when(F.col("type").isin("name", "email", "ip6"), F.lower("piece"))
        .when(F.col("type").isin("phone", "card", "ssn"), F.regexp_replace("piece", r"\D", ""))
        .when(F.col("type") == "iban", F.regexp_replace("piece", " ", ""))
        .when((F.col("type") == "secret") & F.col("piece").rlike("^[0-9a-fA-F]+$"), F.lower("piece"))
        .otherwise(F.col("piece"))
    )
    return out.select("raw", "at", full.alias("type"), "piece", canon.alias("canon"))


def _stream(key: str, *more: Column) -> Column:
    """128 keyed hex digits of an entity at its present draw."""
    seed = F.concat_ws("|", F.lit(key), "type", "canon", F.col("draw").cast("string"), *more)
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(F.lit("+"), seed), 256))


def _substitute(keep: int) -> Column:
    """``canon`` with each digit and letter replaced by a keyed one of its class, after the first ``keep`` characters."""
    digits, lower, upper = "0123456789012345", "abcdefghijkmnpqr", "ABCDEFGHIJKMNPQR"
    at = lambda i: F.substr(F.col("hex"), F.pmod(i, F.lit(128)).cast("int") + 1, F.lit(1))
    swap = lambda c, i: (
        F.when(i < keep, c)
        .when(c.rlike("^[0-9]$"), F.translate(at(i), "0123456789abcdef", digits))
        .when(c.rlike(r"^\p{Lu}$"), F.translate(at(i), "0123456789abcdef", upper))
        .when(c.rlike(r"^\p{L}$"), F.translate(at(i), "0123456789abcdef", lower))
        .otherwise(c)
    )
    return F.array_join(F.transform(F.split("canon", ""), swap), "")


def _hex_substitute() -> Column:
    at = lambda i: F.substr(F.col("hex"), F.pmod(i, F.lit(128)).cast("int") + 1, F.lit(1))
    return F.array_join(F.transform(F.split("canon", ""), lambda c, i: F.when(c == ":", c).otherwise(at(i))), "")


def _filled(digits: Column) -> Column:
    """Card digits with the last one replaced by the Luhn check digit of the others."""
    body = F.substr(digits, F.lit(1), F.length(digits) - 1)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.filter(F.split(F.reverse(body), ""), lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, twice(c.cast("int"))).otherwise(c.cast("int")))
    total = F.aggregate(each, F.lit(0), lambda acc, d: acc + d)
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


def _checked_iban(canon: Column) -> Column:
    """An IBAN of the same country with right check digits (the remainder by 97 of the rearranged number is 1)."""
    country, rest = F.substr(canon, F.lit(1), F.lit(2)), F.substr(canon, F.lit(5), F.lit(40))
    chars = F.filter(F.split(F.concat(rest, country, F.lit("00")), ""), lambda c: c != "")
    left = F.aggregate(chars, F.lit(0), lambda acc, c: F.when(c.rlike("^[0-9]$"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))
    return F.concat(country, F.lpad((98 - left).cast("string"), 2, "0"), rest)


def _byte(i: int) -> Column:
    return F.conv(F.substring("hex", 2 * i + 1, 2), 16, 10).cast("int")


def _made_name() -> Column:
    """A pronounceable word, longer with each draw: gendered endings for given names, the entity's script."""
    syllables = lambda table: F.transform(F.sequence(F.lit(0), F.least(F.col("draw") + 2, F.lit(20))), lambda i: F.get(F.array(*map(F.lit, table)), F.pmod(F.conv(F.substr(F.col("hex"), (i * 3 + 1).cast("int"), F.lit(3)), 16, 10).cast("int"), F.lit(len(table)))))
    latin = F.concat(F.array_join(syllables(SYLLABLES), ""), F.when(F.col("type").contains("given-f"), "a").when(F.col("type").contains("given-m"), "n").when(F.col("type").contains("given-n"), "l").otherwise("s"))
    cyrillic = F.concat(F.array_join(syllables(CYRILLIC), ""), F.when(F.col("type").contains("given-f"), "на").when(F.col("type").contains("given-m"), "н").when(F.col("type").contains("given-n"), "л").otherwise("в"))
    return F.when(F.col("type").endswith("cyrillic"), cyrillic).otherwise(latin)


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, PUBLIC_KEY)


def draw_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities(type, canon)``, distinct -> ``(type, canon, surrogate)``: distinct within a type and no real entity of it."""
    hexed = entities.withColumn("draw", F.lit(0))

    def make(df: DataFrame) -> DataFrame:
        df = df.withColumn("hex", _stream(key))
        canon = F.col("canon")
        plus = F.greatest(F.length(canon) - 10, F.lit(0))  # a phone's country code stays
        email = F.concat(F.substring_index(_substitute(0), "@", 1), F.lit("@m"), F.substring("hex", 100, 8), F.lit(".example.net"))
        ip = F.concat_ws(".", *[(F.pmod(_byte(i), F.lit(254)) + 1).cast("string") for i in range(4)])
        phone = F.concat(F.substr(canon, F.lit(1), plus), F.substr(_substitute(0), plus + 1, F.lit(40)))
        new = (
            F.when(F.col("type") == "email", email)
            .when(F.col("type") == "ip", ip)
            .when(F.col("type") == "ip6", _hex_substitute())
            .when((F.col("type") == "secret") & canon.rlike("^[0-9a-f]+$"), _hex_substitute())
            .when(F.col("type") == "secret", _substitute(4))
            .when(F.col("type") == "iban", _checked_iban(_substitute(2)))
            .when(F.col("type") == "card", _filled(_substitute(1)))
            .when(F.col("type") == "phone", phone)
            .when(F.col("type") == "ssn", _substitute(0))
            .otherwise(_made_name())
        )
        return df.withColumn("surrogate", new).drop("hex")

    now = materialise(make(hexed), "surrogates")
    for _ in range(DRAWS):
        twice = now.groupBy("type", "surrogate").agg(F.count("*").alias("n"), F.min("canon").alias("first")).filter("n > 1").select("type", "surrogate", "first")
        again = now.join(respread(twice), ["type", "surrogate"]).filter("canon <> first").select("type", "canon")
        real = now.join(now.select("type", F.col("canon").alias("surrogate")), ["type", "surrogate"], "left_semi").select("type", "canon")
        clash = materialise(again.unionByName(real).distinct(), "clashes")
        if clash.isEmpty():
            return now.select("type", "canon", "surrogate")
        redrawn = now.join(clash.withColumn("clash", F.lit(1)), ["type", "canon"], "left").withColumn("draw", F.col("draw") + F.coalesce("clash", F.lit(0))).select("type", "canon", "draw")
        nxt = materialise(make(redrawn), "surrogates")
        discard(now)
        now = nxt
    raise RuntimeError(f"surrogates still clash after {DRAWS} draws")


def _formatted() -> Column:
    """``surrogate`` in the format of ``piece``: its separators and its case."""
    chars = F.split("piece", "")
    fill = F.aggregate(
        chars,
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda acc, c: F.when(c.rlike(r"[\p{L}\p{N}]"), F.struct(F.concat(acc["out"], F.substr(F.col("surrogate"), acc["k"], F.lit(1))).alias("out"), (acc["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(acc["out"], c).alias("out"), acc["k"].alias("k"))
        ),
        lambda acc: acc["out"],
    )
    upper = F.col("piece") == F.upper("piece")
    name = F.when(upper & (F.length("piece") > 1), F.upper("surrogate")).otherwise(F.initcap("surrogate"))
    return (
        F.when(F.col("canon").isNull(), F.col("piece"))
        .when(F.col("type").isin("phone", "card", "ssn", "iban"), fill)
        .when(F.col("type").startswith("name"), name)
        .when(upper & F.col("type").isin("email", "secret", "ip6"), F.upper("surrogate"))
        .otherwise(F.col("surrogate"))
    )


def replacements(raws: DataFrame, key: str) -> DataFrame:
    """Distinct mentions ``raws(raw)`` -> ``(raw, type, replacement)``."""
    cut = materialise(parts(raws), "parts")
    entities = cut.filter("canon is not null").select("type", "canon").distinct()
    drawn = draw_surrogates(entities, key)
    named = cut.join(drawn, ["type", "canon"], "left").select("raw", "type", "at", _formatted().alias("new"))
    return named.groupBy("raw").agg(F.min("type").alias("type"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]), " ").alias("replacement"))


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text rewritten, and ``n_entities``.

    Null and empty texts pass unchanged with no entity; repeated rows are rewritten alike; null ids pass; an empty
    table gives an empty table; an input column named ``n_entities`` is replaced.  Without a key, that of the session
    setting ``spark.semlake.pii.key`` is taken.
    """
    key = key or key_of(docs.sparkSession)
    base = docs.drop("n_entities")
    cols = base.columns
    full = F.coalesce(F.col(text), F.lit(""))
    has = full.rlike(TRIGGER) & full.rlike(PATTERN)
    dirty = base.filter(has).select(F.struct(*cols).alias("_in"), F.col(text).alias("_text"), mentions(F.col(text)).alias("_known"))
    dirty = dirty.withColumn("_words", name_words(F.col("_known"))).withColumn("_pattern", pattern_of(F.col("_words")))
    found = F.when(F.size("_words") > 0, marked(F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0)), F.col("_words"))).otherwise(F.col("_known"))
    dirty = materialise(dirty.select("_in", "_text", "_pattern", F.xxhash64("_text").alias("_row"), found.alias("_found")), "dirty")
    held = dirty.select(F.col("_row").alias("row"), F.explode(F.array_distinct("_found")).alias("raw")).distinct()
    held = materialise(held, "mentions")
    made = materialise(replacements(held.select("raw").distinct(), key), "replacements")
    # rows equal by hash share their map; a replacement belongs to the mention whatever the text
    maps = held.join(respread(made.select("raw", "replacement")), "raw").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("raw", "replacement"))).alias("_new"))
    maps = materialise(maps, "maps")
    pieces = F.split(F.col("_text"), F.col("_pattern"), -1)
    rebuilt = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.element_at("_new", F.get("_found", i)), F.lit("")))), "")
    hit = dirty.join(maps, F.col("_row") == F.col("row"))
    changed = hit.select(*[rebuilt.alias(c) if c == text else F.col("_in")[c].alias(c) for c in cols], F.size("_found").alias("n_entities"))
    return base.filter(~has).withColumn("n_entities", F.lit(0)).unionByName(changed)
