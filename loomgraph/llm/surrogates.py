"""Personal data replaced by keyed surrogates, in Spark's own functions only.

Detected entities (mail addresses, phone and card numbers, network addresses, account
and social security numbers, secrets, names after a title) are replaced by invented
ones of the same type: digits stay digits and letters letters in the same layout, cards
keep their issuer's prefix and, like account numbers, valid check digits, private
addresses stay private and public ones become reserved ones, a key keeps its prefix, a
name keeps title, gender and script. A surrogate is a keyed digest (HMAC) of the
entity's plain form, so an entity is replaced alike wherever it stands; given and family
names are entities of their own, so a family name alone and within a full name have one
stand-in. A check over all entities of the corpus makes two entities never share a
surrogate, and no surrogate equal a real entity.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, join_often, scratch_path, text_or_empty

#: Session setting that holds the key; without it the key is the word given here.
KEY_SETTING, DEFAULT_KEY = "spark.loomgraph.surrogates.key", "loomgraph"
#: Tries after which surrogates get longer, by one sign more with each try: of names (whose space
#: is small), and of other types (which then leave their layout). So every entity finds a free one.
WIDER_NAME, WIDER = 1, 12

_TITLES = {
    "m": ("Mr", "Herrn", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "Господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа", "Госпожа"),
    "n": ("Dr", "Prof"),
}
_ALL_TITLES = "|".join(sorted({t for ts in _TITLES.values() for t in ts}, key=lambda t: (-len(t), t)))
#: Types in the order in which a match is tried, each with its pattern.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?\.){1,40}[A-Za-z]{2,63}(?![A-Za-z0-9])"),
    ("cloud_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("secret", r"\b(?:(?i:password|passwd|pwd|token|secret|api[_\-]?key|access[_\-]?key))\s?[=:]\s?[\"']?(?=[_\-+/.]*[A-Za-z0-9])[A-Za-z0-9_\-+/.]{8,}"),
    ("ip", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("phone", r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])"),
    ("phone", r"(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[.\-])[0-9]{3}[.\-][0-9]{4}(?![0-9])"),
    ("ssn", r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{4}[ \-]?){3}[0-9]{4}(?![0-9A-Za-z])"),
    ("card", r"(?<![0-9A-Za-z])3[47][0-9]{2}[ \-]?[0-9]{6}[ \-]?[0-9]{5}(?![0-9A-Za-z])"),
    ("name", rf"(?<!\p{{L}})(?:{_ALL_TITLES})\.? \p{{Lu}}\p{{L}}+(?:[ \-]\p{{Lu}}\p{{L}}+)?"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
_FIRST = "".join(sorted({t[0] for t in _ALL_TITLES.split("|")}))
#: What every match of a pattern contains: a digit, @, = or :, a key's prefix and letters, or a
#: title before a capital. Texts without it need no search.
GATE = rf"[0-9@=:]|A[KS]IA[A-Z]{{16}}|(?=[{_FIRST}])(?:{_ALL_TITLES})\.? \p{{Lu}}"

#: Given names for surrogates by gender and script, and the syllables of family names.
_GIVEN = {
    ("m", "latin"): "Adrian Albert Boris Carl Daniel Edgar Felix Georg Hugo Ivan Jonas Kasper Leon Martin Nils Oscar".split(),
    ("f", "latin"): "Adele Beata Clara Diana Elena Frida Greta Hanna Irene Julia Karin Lena Maria Nora Olga Petra".split(),
    ("n", "latin"): "Alex Andrea Kim Robin Sascha Toni Jo Dominique Charlie Sam Nico Luca Noa Jean Rene Kai".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Григорий Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён".split(),
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Кира Лидия Мария Нина Ольга Полина Раиса".split(),
    ("n", "cyrillic"): "Саша Женя Валя Шура Паша Слава Вася Тоня Мика Лёня Ника Тася Рома Юля Ася Яся".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke la le".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ха хе ка ке ла ле".split(),
}


def type_of(m: Column) -> Column:
    """The type whose pattern a whole match has; the first of `PATTERNS`."""
    out = F.lit("name")
    for name, pattern in reversed(PATTERNS[:-1]):
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


_SECRET_LEAD = r"^([A-Za-z_\-]+\s?[=:]\s?[\"']?)"
_NAME_LEAD = rf"^((?:{_ALL_TITLES})\.? )"


def plain_form(kind: Column, m: Column) -> Column:
    """What is the same for all spellings of an entity: digits of numbers, lower case of addresses and names."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "secret", F.regexp_replace(m, _SECRET_LEAD, ""))
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .when(kind == "name", F.lower(F.regexp_replace(m, _NAME_LEAD, "")))
        .when(kind.isin("cloud_key", "ip"), m)
        .otherwise(digits)
    )


def gender_of(kind: Column, m: Column) -> Column:
    title = F.regexp_extract(m, rf"^({_ALL_TITLES})\b", 1)
    return F.when(kind != "name", F.lit("n")).when(title.isin(*_TITLES["m"]), F.lit("m")).when(title.isin(*_TITLES["f"]), F.lit("f")).otherwise(F.lit("n"))


def tokens_of(kind: Column, m: Column) -> Column:
    """The entities of a match as an array of (lead, kind, m): a name's given name and family names
    each for itself, with what stands before it in the match; any other match is one."""
    plain = F.regexp_replace(m, _NAME_LEAD, "")
    words = F.split(plain, "[ -]")
    two, spaced = F.size(words) == 2, F.contains(plain, F.lit(" "))
    title = F.regexp_extract(m, _NAME_LEAD, 1)
    first = F.struct(title.alias("lead"), F.when(two & spaced, F.lit("given")).otherwise(F.lit("family")).alias("kind"), words[0].alias("m"))
    second = F.struct(F.when(spaced, F.lit(" ")).otherwise(F.lit("-")).alias("lead"), F.lit("family").alias("kind"), F.get(words, F.lit(1)).alias("m"))
    one = F.struct(F.lit("").alias("lead"), kind.alias("kind"), m.alias("m"))
    return F.when(kind != "name", F.array(one)).when(two, F.array(first, second)).otherwise(F.array(first))


def keyed_digest(message: Column, key: str) -> Column:
    """HMAC-SHA-256 of a text, as hex digits."""
    import hashlib

    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def _digits(digest: Column, n: int = 36) -> Column:
    """Decimal digits from a hex digest: 18 from each 15 hex digits."""
    parts = [F.lpad(F.conv(F.substring(digest, at, 15), 16, 10), 18, "0") for at in (1, 16, 31)]
    return F.substring(F.concat(*[F.reverse(p) for p in parts]), 1, n)


def _pick(names: list[str], digest: Column, at: int | Column) -> Column:
    hexes = "0123456789abcdef"
    place = F.instr(F.lit(hexes), F.substring(digest, at if isinstance(at, Column) else F.lit(at), F.lit(1)))
    return F.element_at(F.array(*[F.lit(x) for x in names]), place)


def _luhn(body: Column) -> Column:
    """The check digit that follows `body`."""
    spots = F.transform(F.split(F.reverse(body), ""), lambda d, i: F.when(i % 2 == 0, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)).otherwise(d.cast("int")).cast("int"))
    total = F.aggregate(spots, F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def _iban_check(country: Column, body: Column) -> Column:
    """The two check digits between country and body: 98 less the rest by 97, letters counting 10 to 35."""
    signs = F.split(F.concat(body, country, F.lit("00")), "")
    rest = F.aggregate(signs, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).when(c == "", a).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"))
    return F.lpad((98 - rest).cast("string"), 2, "0")


def _letters_like(plain: Column, digest: Column) -> Column:
    """Characters of the same classes (upper, lower, digit, hex text as hex) in the same places."""
    hexes = "0123456789abcdef"
    long = F.substring(F.repeat(digest, F.ceil(F.length(plain) / 60).cast("int") + 1), F.lit(1), F.length(plain))
    is_hex = plain.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$")

    def one(c, h):
        return (
            F.when(c.rlike("[A-Z]"), F.translate(h, hexes, "BCDFGHJKLMNPQRST"))
            .when(c.rlike("[a-z]"), F.translate(h, hexes, "bcdfghjklmnpqrst"))
            .when(c.rlike("[0-9]"), F.translate(h, "abcdef", "135790"))
            .otherwise(c)
        )

    return F.when(is_hex, long).otherwise(F.array_join(F.zip_with(F.split(plain, ""), F.split(long, ""), one), ""))


def surrogate(kind: Column, plain: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The plain form of an entity's stand-in at its `attempt`."""
    extra = F.greatest(attempt - WIDER, F.lit(0))
    more = F.greatest(attempt - WIDER_NAME + 1, F.lit(0))
    digest = keyed_digest(F.concat_ws("\x1f", kind, plain, attempt.cast("string")), key)
    host = keyed_digest(F.concat_ws("\x1f", F.lit("host"), F.substring_index(plain, "@", -1)), key)
    word = F.translate(digest, "0123456789abcdef", "bcdfghjklmnpqrst")
    host_word = F.translate(host, "0123456789abcdef", "bcdfghjklmnpqrst")
    mail = F.concat(_letters_like(F.substring_index(plain, "@", 1), digest), F.substring(word, F.lit(9), extra), F.lit("@"), F.substring(host_word, 1, 8), F.lit(".example.org"))
    digits = _digits(digest, 54)
    size = F.length(plain)
    tail = F.substring(digits, size + 1, extra)
    issuer = F.when(plain.startswith("60"), F.lit(4)).otherwise(F.lit(2))
    card_body = F.concat(F.substring(plain, F.lit(1), issuer), F.substring(digits, F.lit(1), size - 1 - issuer + extra))
    number = F.substring(digits, F.lit(1), size + extra)
    # numbers keep a leading country code of 1 and never start an area with 0 or 1
    phone = F.concat(F.when(size > 10, F.substring(plain, F.lit(1), size - 10)).otherwise(F.lit("")), F.translate(F.substring(digits, 1, 1), "01", "24"), F.substring(digits, F.lit(2), F.least(size, F.lit(10)) - 1), tail)
    octets = [F.conv(F.substring(digest, i, 4), 16, 10).cast("int") % 254 + 1 for i in (1, 5, 9, 13)]
    # private addresses stay within 10/8, loop-back ones within 127/8; others become reserved ones (240/4)
    network = F.when(plain.rlike(r"^(?:10|192\.168|172\.(?:1[6-9]|2[0-9]|3[01]))\."), F.lit(10)).when(plain.startswith("127."), F.lit(127)).otherwise(octets[0] % 15 + 240)
    ip = F.concat(F.concat_ws(".", network.cast("string"), *octets[1:]), F.when(extra > 0, F.concat(F.lit("."), F.substring(digits, F.lit(1), extra))).otherwise(F.lit("")))
    cloud = F.concat(F.substring(plain, 1, 4), F.substring(F.translate(digest, "0123456789abcdef", "2345ABCDEFGHIJKL"), F.lit(1), extra + 16))
    country, body = F.substring(plain, 1, 2), _letters_like(F.concat(F.substring(plain, F.lit(5), size), F.repeat(F.lit("0"), extra)), digest)
    iban = F.concat(country, _iban_check(country, body), body)
    cyrillic = plain.rlike(r"\p{IsCyrillic}")
    families, givens = [], []
    for script in ("cyrillic", "latin"):
        given = F.when(gender == "m", _pick(_GIVEN["m", script], digest, 1)).when(gender == "f", _pick(_GIVEN["f", script], digest, 1)).otherwise(_pick(_GIVEN["n", script], digest, 1))
        added = F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: _pick(_SYLLABLES[script], digest, i + 7))  # noqa: B023
        added = F.when(more > 0, F.array_join(added, "")).otherwise(F.lit(""))
        families.append(F.concat(*[_pick(_SYLLABLES[script], digest, at) for at in (2, 3, 4, 5, 6)], added))
        givens.append(F.concat(F.lower(given), added))
    return (
        F.when(kind == "email", mail)
        .when(kind == "card", F.concat(card_body, _luhn(card_body)))
        .when(kind == "phone", phone)
        .when(kind == "ip", ip)
        .when(kind == "cloud_key", cloud)
        .when(kind == "secret", _letters_like(F.concat(plain, F.repeat(F.lit("a"), extra)), digest))
        .when(kind == "iban", iban)
        .when(kind == "family", F.when(cyrillic, families[0]).otherwise(families[1]))
        .when(kind == "given", F.when(cyrillic, givens[0]).otherwise(givens[1]))
        .otherwise(number)
    )


def rendered(kind: Column, m: Column, stand_in: Column) -> Column:
    """A stand-in in the layout of the match `m`."""
    poured = F.array_join(
        F.transform(
            F.split(m, ""),
            lambda c, i: F.when(c.rlike("[0-9]"), F.substring(stand_in, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))).otherwise(c),
        ), "",
    )
    poured = F.concat(poured, F.substring(stand_in, F.length(F.regexp_replace(m, "[^0-9]", "")) + 1, F.length(stand_in)))
    grouped = F.when(F.contains(m, F.lit(" ")), F.trim(F.regexp_replace(stand_in, "(.{4})", "$1 "))).otherwise(stand_in)
    return (
        F.when(kind == "secret", F.concat(F.regexp_extract(m, _SECRET_LEAD, 1), stand_in))
        .when(kind.isin("given", "family"), F.initcap(stand_in))
        .when(kind == "iban", grouped)
        .when(kind.isin("email", "ip", "cloud_key"), stand_in)
        .otherwise(poured)
    )


def matches(text: Column) -> Column:
    """All entities of a text in their order; the search runs only where the gate is met."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.when(text.rlike(GATE), found).otherwise(F.array().cast("array<string>"))


def assign(entities: DataFrame, key: str) -> DataFrame:
    """kind, plain, stand_in of distinct (kind, plain, gender): no two stand-ins of a kind are
    equal and none is itself an entity (but a given name, which only stands before a family name
    that is none). Whoever loses a clash takes its next digest; these get longer (`surrogate`), so
    none is left over however full a type is."""
    spark = entities.sparkSession
    waiting = entities.withColumn("attempt", F.lit(0))
    done: DataFrame | None = None
    for _ in count():
        tried = waiting.withColumn("stand_in", surrogate(F.col("kind"), F.col("plain"), F.col("gender"), F.col("attempt"), key))
        first = F.row_number().over(Window.partitionBy("kind", "stand_in").orderBy("plain"))
        real = entities.where("kind != 'given'").select("kind", F.col("plain").alias("stand_in"), F.lit(True).alias("real"))
        tried = tried.withColumn("first", first).join(real, ["kind", "stand_in"], "left")
        if done is not None:
            tried = tried.join(done.select("kind", "stand_in", F.lit(True).alias("used")), ["kind", "stand_in"], "left")
        else:
            tried = tried.withColumn("used", F.lit(None).cast("boolean"))
        tried = tried.withColumn("free", (F.col("first") == 1) & F.col("real").isNull() & F.col("used").isNull())
        path = scratch_path(spark, "stand-ins")
        settled = cut(tried.select("kind", "plain", "gender", "attempt", "stand_in", "free"), "stand-ins", path)
        free = settled.where("free").select("kind", "plain", "stand_in")
        done = free if done is None else done.unionByName(free)
        lost = settled.where("not free")
        if lost.isEmpty():
            return done
        waiting = lost.select("kind", "plain", "gender", (F.col("attempt") + 1).alias("attempt"))


def key_of(spark: SparkSession) -> str:
    """The key that the session is set up with."""
    return spark.conf.get(KEY_SETTING, DEFAULT_KEY)


def _free(name: str, taken: list[str]) -> str:
    """`name`, or as many underscores more as it takes to be none of `taken`, in any case."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def replace(docs: DataFrame, key: str | None = None, text: str = "text", counted: str | None = "n_entities") -> DataFrame:
    """`docs` with every detected entity of `text` replaced, and their number in a new column
    (long) named `counted`, with underscores added where `docs` has that name already.

    All columns and rows stay, and so does a null or empty text; rows without entities are passed
    through untouched. Repeated rows are replaced alike. An empty table gives an empty result. Very
    long texts are searched whole: the patterns take a time in proportion to the text. Only rows with
    entities are shuffled, and only distinct entities are compared with each other. `key` is
    `key_of` the session unless it is given.
    """
    key = key_of(docs.sparkSession) if key is None else key
    names = list(docs.columns)
    number = _free(counted or "n_entities", names)
    found, digest, shown, new = (_free(c, [*names, number]) for c in ("__found", "__digest", "__shown", "__new"))
    marked = docs.withColumn(found, matches(text_or_empty(text)))
    with_any = marked.where(F.size(found) > 0).withColumn(digest, F.sha2(F.col(f"`{text}`").cast("binary"), 256))
    plain_rows = marked.where(F.size(found) == 0).withColumn(number, F.lit(0).cast("long"))

    once = with_any.groupBy(F.col(digest).alias("digest")).agg(F.first(found).alias("found"))
    seen = once.select("digest", F.posexplode("found").alias("at", "m")).withColumn("of", type_of(F.col("m")))
    seen = seen.withColumn("gender", gender_of(F.col("of"), F.col("m"))).select("digest", "at", "gender", F.posexplode(tokens_of(F.col("of"), F.col("m"))).alias("part", "token"))
    seen = seen.select("digest", "at", "part", "gender", "token.*")
    seen = seen.withColumn("plain", F.when(F.col("kind").isin("given", "family"), F.lower("m")).otherwise(plain_form(F.col("kind"), F.col("m"))))
    occurrences = cut(seen.withColumn("entity", F.concat_ws("\x1f", "kind", "plain")), "entities")
    gender = F.when(F.col("kind") == "given", F.coalesce(F.max(F.when(F.col("gender") != "n", F.col("gender"))), F.lit("n"))).otherwise(F.lit("n"))
    known = cut(occurrences.groupBy("kind", "plain", "entity").agg(gender.alias("gender"), F.count(F.lit(1)).alias("rows")), "known")
    table = assign(known.select("kind", "plain", "gender"), key).join(known, ["kind", "plain"]).select("entity", "rows", "stand_in")
    joined = join_often(occurrences, cut(table, "stand-ins"), "entity")
    pieces = joined.select("digest", "at", "part", F.concat("lead", rendered(F.col("kind"), F.col("m"), F.col("stand_in"))).alias("piece"))
    whole = pieces.groupBy("digest", "at").agg(F.sort_array(F.collect_list(F.struct("part", "piece"))).alias("pieces"))
    whole = whole.select("digest", "at", F.array_join("pieces.piece", "").alias("shown"))
    lists = whole.groupBy(F.col("digest").alias(digest)).agg(F.sort_array(F.collect_list(F.struct("at", "shown"))).alias(shown))
    back = with_any.join(lists, digest)
    between = F.split(F.col(f"`{text}`"), ANY, -1)
    put = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(F.col(shown), i)["shown"], F.lit("")))), "")
    replaced = back.withColumn(number, F.size(found).cast("long")).withColumn(new, put)
    more = [number] if counted else []
    columns = [F.col(new).alias(c) if c == text else F.col(f"`{c}`") for c in names]
    return plain_rows.select(*[f"`{c}`" for c in names], *more).unionByName(replaced.select(*columns, *more))
