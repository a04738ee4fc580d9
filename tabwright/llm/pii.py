"""Surrogates for personal data: keyed, of the same kind and format, one for each entity and never shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import name, saved, text_or_empty, unfold, whole_rows

MALE = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Господин", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Госпожа", "г-жа"]
NEUTRAL = ["Dr", "Prof"]
#: Given names by script and gender; surnames are built from syllables, so that there are enough of them.
GIVEN = {
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul"],
    ("latin", "f"): ["Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("latin", "n"): ["Alex", "Robin", "Kim", "Sascha", "Charlie", "Jamie", "Casey", "Andrea"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Максим", "Олег"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("cyrillic", "n"): ["Саша", "Женя", "Валя", "Шура"],
}
SYLLABLES = {"latin": ["ba", "do", "fe", "gi", "ku", "la", "mo", "ne", "pi", "ru", "sa", "to", "ve", "wi", "za", "lo"],
             "cyrillic": ["ба", "до", "фе", "ги", "ку", "ла", "мо", "не", "пи", "ру", "са", "то", "ве", "ви", "за", "ло"]}
LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"

#: kind, pattern. Every run of letters is entered only at its start, so that long runs cost no more than their length.
KINDS = [
    ("secret", r"(?<!\p{L})(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.=-]{8,}"),
    ("secret", r"(?<![A-Za-z0-9])(?=[A-Za-z_]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"),
    ("phone", r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"),
    ("phone", r"(?<![\p{L}\p{N}])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("name", r"(?<!\p{L})(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"),
]
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
#: What every mention has: a digit, an @, a value after a label, or a form of address. Most texts have none of them, and
#: this is told much faster than by the patterns themselves.
HINTS = [r"[0-9@]", r"[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.=-]{8}",
         "[" + "".join(sorted({w[0] for w in MALE + FEMALE + NEUTRAL})) + "](?:" + "|".join(w[1:] for w in MALE + FEMALE + NEUTRAL)
         + r")\.? \p{Lu}"]
#: Country codes of phone numbers: no code begins another, so the digits alone tell where one ends.
COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
#: What stands before the part that is replaced, by kind.
LABELS = {"secret": r"^(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?", "phone": rf"^\+(?:{COUNTRY})",
          "name": r"^(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.? "}
#: Attempts in the shape of the mention; each one after them makes the surrogate longer, so that a full shape has a way out.
SAME_SHAPE = 40


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once per row, however often ``then`` uses it."""
    return F.transform(F.array(value), then)[0]


def _kind(found: Column) -> Column:
    made = F.lit("name")
    for kind, pattern in reversed(KINDS[:-1]):
        made = F.when(found.rlike(f"^(?:{pattern})$"), kind).otherwise(made)
    return made


def _label(found: Column, kind: Column) -> Column:
    made = F.lit("")
    for k, pattern in LABELS.items():
        made = F.when(kind == k, F.regexp_extract(found, pattern, 0)).otherwise(made)
    return made


def _gender(label: Column) -> Column:
    word = F.regexp_replace(label, r"\.? $", "")
    return F.when(word.isin(MALE), "m").when(word.isin(FEMALE), "f").otherwise("n")


def parsed(found: Column) -> Column:
    """A mention as struct: ``kind``, ``label`` (kept), ``value``, ``canon`` (equal for mentions of one entity)."""
    def canon(kind, label, value):
        low = F.lower(value)
        return (F.when(kind.isin("phone", "ssn", "card"), F.regexp_replace(value, r"\D+", ""))
                .when(kind == "iban", F.regexp_replace(value, " ", "")).when(kind == "name", F.concat_ws("/", _gender(label), low))
                .when(kind == "email", low).otherwise(value))

    def whole(kind, label, value):
        return F.struct(kind.alias("kind"), label.alias("label"), value.alias("value"), canon(kind, label, value).alias("canon"))

    return _let(_kind(found), lambda kind: _let(_label(found, kind), lambda label: _let(
        F.substr(found, F.length(label) + 1), lambda value: whole(kind, label, value))))


def _number(key: str, kind: Column, canon: Column, attempt: Column, place: Column) -> Column:
    """A keyed number from 0 to 2^28 - 1 for one place of an entity's surrogate."""
    text = F.concat_ws("\0", F.lit(key), kind, canon, attempt.cast("string"), place.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 7), 16, 10).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), n % len(values) + 1)


def _letter(alphabet: str, n: Column) -> Column:
    return F.substr(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of an entity: as long as ``canon``, character class by character class, but for names and IPs.

    From attempt ``SAME_SHAPE`` on it grows, by one character each time: a digit at the end, a letter before an address's
    top-level domain, a syllable of a family name, a digit of a fifth number of an IP address.
    """
    extra = F.greatest(F.lit(0), attempt - (SAME_SHAPE - 1))
    end = F.regexp_extract(canon, r"\.[^.]*$", 0)
    longer = F.when(kind == "email", F.concat(F.substring(canon, F.lit(1), F.length(canon) - F.length(end)), F.repeat(F.lit("a"), extra), end)
                    ).otherwise(F.concat(canon, F.repeat(F.lit("0"), extra)))

    def n(place):
        return _number(key, kind, canon, attempt, place)

    hexed = canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & (kind == "secret")
    chars = F.regexp_extract_all(F.when(extra > 0, longer).otherwise(canon), F.lit("(?s)(.)"), 1)

    def char(c, i):
        return (F.when(c.rlike(r"\d"), (n(i) % 10).cast("string")).when(hexed & c.rlike("[a-f]"), _letter("abcdef", n(i)))
                .when(hexed & c.rlike("[A-F]"), _letter("ABCDEF", n(i))).when(c.rlike("[A-Z]"), _letter(LATIN.upper(), n(i)))
                .when(c.rlike(r"\p{IsCyrillic}"), _letter(CYRILLIC, n(i))).when(c.rlike(r"\p{L}"), _letter(LATIN, n(i))).otherwise(c))

    return _let(F.array_join(F.transform(chars, char), ""), lambda mapped: _of_kind(kind, canon, mapped, n, extra))


def _of_kind(kind: Column, canon: Column, mapped: Column, n, extra: Column) -> Column:
    """The surrogate by kind, from the characters that were mapped one by one and the entity's keyed numbers."""
    end = F.regexp_extract(canon, r"\.[^.]*$", 0)                               # the top-level domain stays
    email = F.concat(F.substring(mapped, F.lit(1), F.length(mapped) - F.length(end)), end)
    iban = F.concat(F.substring(canon, 1, 2), F.substr(mapped, F.lit(3)))       # the country stays
    ip = F.concat_ws(".", *[(1 + n(F.lit(i)) % 254).cast("string") for i in range(4)])
    ip = F.when(extra > 0, F.concat(ip, F.lit("."), F.substring(mapped, F.length(mapped) - extra + 1, extra))).otherwise(ip)
    # a number that passes the Luhn test keeps passing it
    body = F.substring(mapped, F.lit(1), F.length(mapped) - 1)
    card = F.when(_luhn(canon) % 10 == 0, F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))).otherwise(mapped)
    gender, cyrillic = F.substring(canon, 1, 1), canon.rlike(r"\p{IsCyrillic}")
    given, family = F.lit(None).cast("string"), F.lit(None).cast("string")
    for (script, g), names in GIVEN.items():
        given = F.when((gender == g) & (cyrillic == (script == "cyrillic")), _pick(names, n(F.lit(0)))).otherwise(given)
    for script, parts in SYLLABLES.items():
        family = F.when(cyrillic == (script == "cyrillic"), F.initcap(F.concat(*[_pick(parts, n(F.lit(i))) for i in range(1, 7)], F.when(
            extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda i: _pick(parts, n(i + 6))), "")
        ).otherwise("")))).otherwise(family)
    person = F.when(canon.contains(" "), F.concat_ws(" ", given, family)).otherwise(family)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", iban)
            .when(kind == "name", F.lower(F.concat_ws("/", gender, person))).otherwise(mapped))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    places = F.reverse(F.regexp_extract_all(digits, F.lit(r"(\d)"), 1))
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def rendered(mention: Column, made: Column) -> Column:
    """A surrogate in the format of one mention: its separators, and its capitals."""
    return _let(made, lambda made: _shown(mention, made))


def _shown(mention: Column, made: Column) -> Column:
    kind, value = mention["kind"], mention["value"]
    numbered = F.array_join(F.zip_with(
        F.split(value, r"[0-9]" ), F.regexp_extract_all(made, F.lit(r"(\d)"), 1),
        lambda gap, d: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(d, F.lit("")))), "")
    groups = F.regexp_replace(value, r"[^ ]", "")
    spaced = F.when(groups == "", made).otherwise(F.rtrim(F.regexp_replace(made, r"(.{4})", "$1 ")))
    chars = F.zip_with(F.regexp_extract_all(value, F.lit("(?s)(.)"), 1), F.regexp_extract_all(made, F.lit("(?s)(.)"), 1),
                       lambda old, new: F.when(old.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new))
    # the end of a longer address has no old capitals to go by
    address = F.when((value == F.upper(value)) & (F.length(made) > F.length(value)), F.upper(made)).otherwise(F.array_join(chars, ""))
    person = F.substr(made, F.lit(3))
    person = F.when(value == F.upper(value), F.upper(person)).otherwise(F.initcap(person))
    shown = (F.when(kind.isin("phone", "ssn", "card"), numbered).when(kind == "iban", spaced).when(kind == "email", address)
             .when(kind == "name", person).otherwise(made))
    return F.concat(mention["label"], shown)


def _mentions(text: Column) -> Column:
    hint = text.rlike(HINTS[0]) | text.rlike(HINTS[1]) | text.rlike(HINTS[2])
    return F.when(hint, F.regexp_extract_all(text, F.lit(f"({ANY})"), 1)).otherwise(F.array().cast("array<string>"))


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """The entities (``kind``, ``canon``) whose first surrogate would not do, with the ``attempt`` that does.

    A surrogate will not do if it is a real entity of the corpus, or another entity's surrogate (the
    smallest entity keeps it). Only those that lose try again, until none does: surrogates grow once ``SAME_SHAPE`` attempts
    failed, so even a shape whose every value is a real entity comes to an end.
    """
    real = entities.select(F.col("kind").alias("k"), F.col("canon").alias("c"))
    tried = entities.withColumn("attempt", F.lit(0))
    settled = None
    while True:
        made = tried.withColumn("sur", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        pool = made.withColumn("new", F.lit(1))
        if settled is not None:
            pool = pool.unionByName(settled.withColumn("new", F.lit(0)))
        first = pool.groupBy("kind", "sur").agg(F.min(F.struct("new", "canon")).alias("first"), F.count(F.lit(1)).alias("n"))
        shared = first.where("n > 1").select(F.col("kind").alias("k"), F.col("sur").alias("s"), F.col("first.canon").alias("c"))
        bad = made.join(shared, (F.col("kind") == F.col("k")) & (F.col("sur") == F.col("s")) & (F.col("canon") != F.col("c")), "left_semi")
        bad = bad.unionByName(made.join(real, (F.col("kind") == F.col("k")) & (F.col("sur") == F.col("c")), "left_semi"))
        bad = saved(bad.select("kind", "canon", "attempt").distinct(), "pii-collisions")
        good = saved(made.join(bad.select("kind", "canon"), ["kind", "canon"], "left_anti"), "pii-settled")
        settled = good if settled is None else settled.unionByName(good)
        if bad.limit(1).count() == 0:
            return settled.where("attempt > 0").select("kind", "canon", "attempt")
        tried = bad.withColumn("attempt", F.col("attempt") + 1)


def replace_private(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The frame with ``text`` rewritten and ``n_replaced`` (mentions replaced).

    Detected are secrets, e-mail addresses, phone, card, bank and social security numbers, IP addresses, and names
    after a form of address. Mentions of one entity (in other separators or capitals; phones with or without their country code)
    get one surrogate over the whole corpus, and different entities different ones. A name is the whole string after its form of
    address with that word's gender: other forms of it are other entities, and a bare repeat stays. A surrogate keeps the kind, length and format of the mention: digits stay digits, letters
    letters of their script, capitals capitals (a shape with too few free values gives longer ones); card numbers stay valid, country codes stay, and names keep gender and script. The
    first surrogate depends on ``key`` and the entity alone, so rows are rewritten where they are; the few entities that
    collided are met by a join.

    Any run of 13 to 19 digits is replaced as a card number, whether or not it passes the Luhn test, to err on the safe side.

    A null text stays null with 0 replaced; texts without mentions stay as they are. An input column named like a
    result gives way.
    """
    mention = F.explode(F.array_distinct(_mentions(F.col("t"))))
    found = df.select(text_or_empty(text).alias("t")).select(mention.alias("m")).distinct().select(parsed(F.col("m")).alias("p"))
    entities = saved(found.select("p.kind", "p.canon").distinct(), "pii-entities")
    again = saved(attempts(entities, key), "pii-again")
    rows = df.select(whole_rows(df).alias("row"), name(text).cast("string").alias("t"))
    collided = again.limit(1).count() > 0
    if collided:
        texts = df.select(text_or_empty(text).alias("t")).select(F.xxhash64("t").alias("h"), mention.alias("m")).distinct()
        texts = texts.select("h", parsed(F.col("m")).alias("p")).join(again, (F.col("p.kind") == F.col("kind")) & (F.col("p.canon") == F.col("canon")))
        by_text = texts.groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\0", "kind", "canon"), "attempt"))).alias("tries"))
        rows = rows.join(by_text, F.xxhash64(F.coalesce("t", F.lit(""))) == F.col("h"), "left")
    rows = rows.withColumn("mentions", F.transform(_mentions(F.col("t")), parsed)).withColumn(
        "gaps", F.when(F.size("mentions") > 0, F.split("t", ANY)))

    def one(gap, mention):
        entity = F.concat_ws("\0", mention["kind"], mention["canon"])
        attempt = F.coalesce(F.col("tries")[entity], F.lit(0)) if collided else F.lit(0)
        return F.concat(gap, F.coalesce(rendered(mention, surrogate(key, mention["kind"], mention["canon"], attempt)), F.lit("")))

    new = F.when(F.size("mentions") > 0, F.array_join(F.zip_with("gaps", "mentions", one), "")).otherwise(F.col("t"))
    return unfold(rows, "row", df.columns, [new, F.coalesce(F.size("mentions"), F.lit(0))], [text, "n_replaced"])
