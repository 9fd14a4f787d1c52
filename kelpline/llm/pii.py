"""Personal data replaced by surrogates, in DataFrame functions alone.

Detected: e-mail addresses, secrets after a naming word, IPv4 addresses, telephone, card and social security numbers,
IBANs, and names after an honorific.  The words of a name found in a text are replaced wherever they stand in that text
with their capital, too; where one stands alone and begins a sentence it may be a common word, and stays.  Parts of a name
with hyphens or apostrophes are names of their own, single letters of it stay (O'Brien, Smith's).  A surrogate is a keyed function of type, canonical value and attempt, so an entity has one surrogate throughout the corpus,
however its digits are spaced.  It keeps length, punctuation, letter case and kind of sign; octets stay octets, a card
number that passes the Luhn check passes it again, an IBAN keeps its country and has valid check digits, hexadecimal
secrets stay hexadecimal, and names keep gender (from the honorific) and script.  A given name that stands somewhere with
an honorific of one gender only has that gender also after Dr and the like: it is one person's, with one surrogate.

Attempts keep surrogates apart: all distinct entities are given their surrogates, and an entity whose surrogate another
entity has, or which is a real value of the corpus, goes to its next attempt, until no two are equal.  Only entities with
a later attempt or with a gender known from elsewhere, which are few, need a join to reach their texts; all other
replacements are computed in place.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import stored

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){1,127}"  # one start for each run of signs
SECRET = r"(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{16,}"
#: Numbers of versions look like addresses.
IP = r"(?<![\d.])(?<!\b(?i:version|release|build|ver|v)\.?[ :]?)(?:\d{1,3}\.){3}\d{1,3}(?!\d)(?!\.\d)"
PHONE = r"(?<!\d)(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?\d{3}[ .-]?\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
CARD = r"(?<![\d\p{L}])(?:\d{4}[ -]){3}\d{4}(?!\d)|(?<![\d\p{L}])\d{13,19}(?![\d\p{L}])"
IBAN = r"(?<![\p{L}\d])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![\p{L}\d])"
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Г-жа"]
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Г-н"]
#: Capitalised words that follow a name and are none.
CALENDAR = [
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December",
    "Montag", "Dienstag", "Mittwoch", "Donnerstag", "Freitag", "Samstag", "Sonntag",
]
WORD = r"\p{Lu}(?=\p{L}|['’-]\p{L})\p{L}*+(?:['’-]\p{L}++){0,8}+"
NAME = r"(?<![\p{L}\d])(?:" + "|".join([*FEMALE, *MALE, "Dr", "Prof"]) + r")\.? " + WORD + r"(?: (?!(?:" + "|".join(CALENDAR) + r")(?![\p{L}\d]))" + WORD + "){0,2}"
#: What stands before a word that begins a sentence.
START = r"(?:^|[.!?…:]['\"»”)]{0,2}\s{1,3}|[\r\n]\s{0,3}|[¿¡«“\"(])"
ANY = "|".join([EMAIL, SECRET, IP, PHONE, SSN, CARD, IBAN, NAME])
#: What a text must hold to be searched at all: cheap to test, and true of all that ANY finds.
MARKS = [*FEMALE, *MALE, "Dr", "Prof"]
SYLLABLES = ["ba", "del", "fi", "gor", "han", "ka", "lin", "mo", "nar", "pe", "ras", "sil", "ta", "ven", "wo", "zu"]
CYRILLIC = ["ба", "дел", "фи", "гор", "хан", "ка", "лин", "мо", "нар", "пе", "рас", "сил", "та", "вен", "во", "зу"]
GIVEN = {
    "f": ["Anna", "Clara", "Elena", "Julia", "Laura", "Maria", "Nina", "Sara"],
    "m": ["Adam", "David", "Felix", "Jonas", "Leon", "Martin", "Oskar", "Paul"],
    "u": ["Alex", "Andrea", "Kim", "Luca", "Noel", "Robin", "Sasha", "Toni"],
}
GIVEN_CYRILLIC = {
    "f": ["Анна", "Вера", "Елена", "Ирина", "Лидия", "Мария", "Нина", "Ольга"],
    "m": ["Антон", "Борис", "Виктор", "Иван", "Павел", "Олег", "Роман", "Юрий"],
    "u": ["Саша", "Женя", "Валя", "Слава", "Паша", "Шура", "Тоша", "Мика"],
}


def kind_of(m: Column) -> Column:
    """The type of a match of ANY."""
    return (
        F.when(m.rlike("^(?:" + NAME + ")$"), "name")
        .when(m.contains("@"), "email")
        .when(m.rlike(r"^(?i:token|secret|password|passwd|api)"), "secret")
        .when(m.rlike("^" + IP + "$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^(?:\d{13,19}|(?:\d{4}[ -]){3}\d{4})$"), "card")
        .otherwise("phone")
    )


def _value(m: Column, kind: Column) -> Column:
    """The part of a match that is replaced: a secret without its naming word."""
    return F.when(kind == "secret", F.regexp_extract(m, "[A-Za-z0-9+/_-]{16,}$", 0)).otherwise(m)


def canonical(value: Column, kind: Column) -> Column:
    """Equal for all spellings of one entity."""
    signs = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("phone", "card", "ssn", "iban"), F.upper(signs)).when(kind == "secret", value).otherwise(F.lower(value))


def _let(x: Column, made: Callable[[Column], Column]) -> Column:
    """made of x, with x computed once, however often made mentions it."""
    return F.element_at(F.transform(F.array(x), made), 1)


def _hex(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 keyed hexadecimal digits."""
    seed = F.concat_ws("\x01", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(F.lit("0"), seed), 256), F.sha2(F.concat(F.lit("1"), seed), 256))


def _number(hexes: Column, at: Column | int, of: int) -> Column:
    """A number below `of` from four digits."""
    return F.pmod(F.conv(F.substring(hexes, at if isinstance(at, Column) else F.lit(at), F.lit(4)), 16, 10).cast("int"), F.lit(of))


def _masked(value: Column, hexes: Column, letters: str | Column) -> Column:
    """Digits for digits and letters for letters, in their case; the k-th sign depends on k, not on punctuation."""

    def sign(i: Column) -> Column:
        c = F.substring(value, i, F.lit(1))
        k = F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"[^\p{L}\p{N}]", ""))
        h = F.substring(hexes, F.pmod(k, F.lit(124)) + 1, F.lit(1))
        digit = F.translate(h, "abcdef", "246813")
        letter = F.substring(letters if isinstance(letters, Column) else F.lit(letters), F.conv(h, 16, 10).cast("int") + 1, F.lit(1))
        return (
            F.when(c.rlike("^[0-9]$"), F.when((k == 1) & (digit == "0"), F.lit("7")).otherwise(digit))
            .when(c.rlike(r"^\p{Lu}$"), F.upper(letter))
            .when(c.rlike(r"^\p{L}$"), letter)
            .otherwise(c)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), sign), "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a row of digits, 0 modulo 10 if it passes."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _card(value: Column, hexes: Column) -> Column:
    masked = _masked(value, hexes, "abcdefghijklmnop")
    digits = F.regexp_replace(masked, "[^0-9]", "")
    last = F.length(masked) - 1
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))) % 10, F.lit(10))
    valid = luhn_sum(F.regexp_replace(value, "[^0-9]", "")) % 10 == 0
    return F.when(valid, F.concat(F.substring(masked, F.lit(1), last), check.cast("string"))).otherwise(masked)


def mod_97(signs: Column) -> Column:
    """The number that an IBAN's signs stand for (letters are 10 to 35), modulo 97."""

    def add(total: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (total * 10 + c.cast("int")) % 97).otherwise((total * 100 + letter) % 97)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(signs)), lambda i: F.substring(signs, i, F.lit(1))), F.lit(0), add)


def _iban(value: Column, hexes: Column) -> Column:
    """The country, check digits that are right, and signs for the rest."""
    country, body = F.substring(value, F.lit(1), F.lit(2)), F.substring(value, F.lit(5), F.length(value))
    masked = _masked(body, hexes, "ABCDEFGHIJKLMNOP")
    check = F.lit(98) - mod_97(F.concat(F.regexp_replace(masked, "[^A-Z0-9]", ""), country, F.lit("00")))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), masked)


def _ip(hexes: Column) -> Column:
    return F.concat_ws(".", *[(_number(hexes, 1 + 4 * k, 254) + 1).cast("string") for k in range(4)])


def _pick(items: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), n + 1)


def _word(hexes: Column, value: Column, attempt: Column, kind: Column) -> Column:
    """A name of the script of value: a given name of its gender with a syllable, or a surname of syllables.

    Later attempts have more syllables, so there are always names left.
    """
    def made(syllables: list[str], given: dict[str, list[str]]) -> Column:
        more = F.sequence(F.lit(1), attempt + F.when(kind == "surname", 4).otherwise(2))
        tail = F.array_join(F.transform(more, lambda i: _pick(syllables, _number(hexes, 5 + F.pmod(i, F.lit(28)) * 4, 16))), "")
        first = reduce(lambda c, g: c.when(kind == f"given_{g}", _pick(given[g], _number(hexes, 1, 8))), given, F.when(F.lit(False), ""))
        return F.concat(F.when(kind == "surname", F.initcap(tail)).otherwise(F.concat(first, tail)))

    word = F.when(value.rlike(r"\p{IsCyrillic}"), made(CYRILLIC, GIVEN_CYRILLIC)).otherwise(made(SYLLABLES, GIVEN))
    return F.when((value == F.upper(value)) & (F.length(value) > 1), F.upper(word)).otherwise(word)


def surrogate(value: Column, kind: Column, attempt: Column, key: str) -> Column:
    """The replacement of one value (of a name: one word of it)."""
    # An address keeps its top-level domain; from the third attempt on it is longer, as few addresses may be as short.
    head, tail = F.regexp_extract(value, r"^(.*)(\.[^.]*)$", 1), F.regexp_extract(value, r"^(.*)(\.[^.]*)$", 2)

    def made(hexes: Column) -> Column:
        letters = F.when(kind == "email", "abdeghiklmnoprst").when(kind != "secret", "ABCDEFGHIJKLMNOP")
        letters = letters.when(value.rlike("^[0-9a-fA-F]+$"), "abcdefabcdefabcd").otherwise("bcdfghjkmnpqrstv")
        longer = F.concat(F.repeat(F.lit("x"), F.greatest(attempt - 2, F.lit(0))), head)
        masked = F.concat(_masked(F.when(kind == "email", longer).otherwise(value), hexes, letters), F.when(kind == "email", tail).otherwise(""))
        return (
            F.when(kind == "ip", _ip(hexes))
            .when(kind == "card", _card(value, hexes))
            .when(kind == "iban", _iban(value, hexes))
            .when(kind.isin("given_f", "given_m", "given_u", "surname"), _word(hexes, value, attempt, kind))
            .otherwise(masked)
        )

    return _let(_hex(key, kind, canonical(value, kind), attempt), made)


def _pieces(m: Column) -> Column:
    """array<struct<kind, value>>: a name after its honorific in pieces; those that stay have no kind."""
    honorific = F.regexp_extract(m, r"^([\p{L}-]+)", 1)
    gender = F.when(honorific.isin(*FEMALE), "f").when(honorific.isin(*MALE), "m").otherwise("u")
    names = F.slice(F.split(m, " "), 2, 3)
    last = F.size(names) - 1

    def named(word: Column, i: Column) -> Column:
        kind = F.when(i == last, "surname").otherwise(F.concat(F.lit("given_"), gender))
        signs = F.regexp_extract_all(F.when(i == 0, word).otherwise(F.concat(F.lit(" "), word)), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
        return F.transform(signs, lambda x: F.struct(F.when(x.rlike(r"^\p{L}{2,}$"), kind).alias("kind"), x.alias("value")))

    return F.flatten(F.transform(names, named))


def _parts(m: Column) -> Column:
    """array<struct<kind, value>>: the parts of a match that are replaced, in order."""
    kind = kind_of(m)
    one = F.array(F.struct(kind.alias("kind"), _value(m, kind).alias("value")))
    return F.when(kind == "name", F.filter(_pieces(m), lambda p: p["kind"].isNotNull())).otherwise(one)


def _new(p: Column, key: str, known: Column) -> Column:
    """The surrogate of a part; known: map of parts to the kind and attempt that they have besides the plain ones."""
    other = F.try_element_at(known, F.concat_ws("\x01", p["kind"], canonical(p["value"], p["kind"])))
    return surrogate(p["value"], F.coalesce(other["kind"], p["kind"]), F.coalesce(other["attempt"], F.lit(0)), key)


def _replaced(m: Column, new: Column) -> Column:
    """A match with its parts replaced as in the map new; what stands before the first part stays."""
    kind = kind_of(m)
    name = F.transform(_pieces(m), lambda p: F.when(p["kind"].isNull(), p["value"]).otherwise(F.try_element_at(new, p)))
    name = F.concat(F.substring_index(m, " ", 1), F.lit(" "), F.array_join(name, ""))
    value = _value(m, kind)
    plain = F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(value)), F.try_element_at(new, F.struct(kind.alias("kind"), value.alias("value"))))
    return F.when(kind == "name", name).otherwise(plain)


def _searched(text: Column) -> Column:
    marks = [text.contains(x) for x in MARKS] + [F.lower(text).contains(x) for x in ("token", "secret", "passw", "api")]
    return reduce(lambda a, b: a | b, marks, text.rlike("[0-9@]"))


def _matches(text: Column) -> Column:
    return F.when(_searched(text), F.regexp_extract_all(text, F.lit(f"(?:{ANY})"), F.lit(0))).otherwise(F.array().cast("array<string>"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, canon, distinct) with attempt and surrogate, all surrogates of a kind distinct and none real."""
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a surrogate costs far more than its bytes
    made = lambda df: df.repartition(tasks, "kind", "canon").withColumn("surrogate", canonical(surrogate(F.col("canon"), F.col("kind"), F.col("attempt"), key), F.col("kind")))
    now = stored(made(entities.withColumn("attempt", F.lit(0))), "pii-surrogates")
    while True:
        real = entities.select("kind", F.col("canon").alias("surrogate"))
        taken = now.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("owner"), F.count("*").alias("n")).where("n > 1")
        # The owner of a surrogate is its earliest; all others, and whatever equals a real value, try again.
        losers = now.join(taken, ["kind", "surrogate"]).where(F.col("canon") != F.col("owner.canon")).select("kind", "canon")
        losers = stored(losers.union(now.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canon")).distinct(), "pii-collisions")
        if losers.isEmpty():
            return now
        again = now.join(losers.withColumn("again", F.lit(1)), ["kind", "canon"], "left")
        again = again.select("kind", "canon", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"), F.when(F.col("again").isNull(), F.col("surrogate")).alias("kept"))
        # Only those that try again are computed anew.
        new = made(again.where("kept IS NULL").drop("kept"))
        now = stored(again.where("kept IS NOT NULL").withColumnRenamed("kept", "surrogate").unionByName(new), "pii-surrogates")


def _genders(entities: DataFrame) -> DataFrame:
    """kind, canon and as: given names of no known gender that have one elsewhere, and the kind they have there."""
    given = entities.where(F.col("kind").isin("given_f", "given_m")).groupBy("canon").agg(F.min("kind").alias("as"), F.max("kind").alias("other"))
    unknown = entities.where("kind = 'given_u'")
    return unknown.join(given.where(F.col("as") == F.col("other")), "canon").select("kind", "canon", "as")


def pseudonymized(documents: DataFrame, key: str | None = None) -> DataFrame:
    """documents with personal data in text replaced; all other columns, and texts without personal data, as they are.

    key: what surrogates depend on; without one the session's spark.kelpline.pii.key, and where that is unset a public one.
    Null and empty texts stay; repeated rows are replaced alike, rows with one doc_id each for its own text; an empty
    table stays empty.  Columns of documents may have any names.
    """
    key = key or documents.sparkSession.conf.get("spark.kelpline.pii.key", None) or "kelpline"
    taken = set(documents.columns)
    free = next(p for p in (f"_pii{k}_" for k in range(len(taken) + 1)) if not any(c.startswith(p) for c in taken))
    matches, known, text_key, pieces, new, words, near = (free + x for x in ("matches", "known", "text", "pieces", "new", "words", "near"))
    found = documents.select(F.explode(F.array_distinct(_matches(F.col("text")))).alias("m"))
    found = found.select(F.explode(_parts(F.col("m"))).alias("p")).select("p.kind", canonical(F.col("p.value"), F.col("p.kind")).alias("canon"))
    entities = stored(found.distinct(), "pii-entities")
    genders = stored(_genders(entities), "pii-genders")
    own = entities.join(genders.select("kind", "canon"), ["kind", "canon"], "left_anti")
    attempts = surrogates(own, key).where("attempt > 0").select("kind", "canon", "attempt")
    plain = attempts.select(F.concat_ws("\x01", "kind", "canon").alias("name"), F.struct("kind", "attempt").alias("known"))
    there = genders.alias("g").join(attempts.alias("a"), (F.col("g.as") == F.col("a.kind")) & (F.col("g.canon") == F.col("a.canon")), "left")
    there = there.select(F.concat_ws("\x01", "g.kind", "g.canon").alias("name"), F.struct(F.col("g.as").alias("kind"), F.coalesce("a.attempt", F.lit(0)).alias("attempt")).alias("known"))
    later = stored(plain.unionByName(there), "pii-known")
    kind = "map<string,struct<kind:string,attempt:int>>"
    rows = documents.withColumn(matches, _matches(F.col("text")))
    if later.isEmpty():
        rows = rows.withColumn(known, F.create_map().cast(kind))
    else:
        texts = documents.select(F.xxhash64("text").alias(text_key), F.explode(F.array_distinct(_matches(F.col("text")))).alias("m"))
        parts = texts.select(text_key, F.explode(_parts(F.col("m"))).alias("p"))
        parts = parts.select(text_key, F.concat_ws("\x01", "p.kind", canonical(F.col("p.value"), F.col("p.kind"))).alias("name"))
        held = parts.distinct().join(later, "name").groupBy(text_key).agg(F.map_from_entries(F.collect_list(F.struct("name", "known"))).alias(known))
        # Equal hashes of different texts only make a map larger than it need be.
        rows = rows.withColumn(text_key, F.xxhash64("text")).join(stored(held, "pii-held"), text_key, "left").drop(text_key)
        rows = rows.withColumn(known, F.coalesce(known, F.create_map().cast(kind)))
    split = F.split(F.col("text"), f"(?:{ANY})", -1)
    some = F.size(matches) > 0
    rows = rows.withColumn(pieces, F.when(some, split))
    parts = F.array_distinct(F.flatten(F.transform(matches, _parts)))
    made = F.map_from_entries(F.transform(parts, lambda p: F.struct(p.alias("part"), _new(p, key, F.col(known)).alias("new"))))
    rows = rows.withColumn(new, F.when(some, made))
    # The words of names found after an honorific, wherever they stand in between.
    named = F.filter(F.map_entries(new), lambda e: e["key"]["kind"].rlike("^(given_|surname)"))
    rows = rows.withColumn(words, F.when(some, F.transform(named, lambda e: F.struct(e["key"]["value"].alias("word"), e["value"].alias("new")))))

    quoted = lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))
    beside = F.array_join(F.flatten(F.transform(F.col(words), lambda w: F.array(quoted(w["word"]), w["new"]))), "|")

    def renamed(piece: Column) -> Column:
        # Not the first of a sentence, or beside another word of a name.
        def whole(w: Column) -> Column:
            after = F.concat(F.lit(r"(?=[ '’-](?:"), F.col(near), F.lit(r")(?![\p{L}\p{N}]))"))
            inner = F.concat(F.lit(r"(?<!" + START + ")"), quoted(w["word"]), F.lit(r"(?![\p{L}\p{N}])"))
            first = F.concat(quoted(w["word"]), after)
            return F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), inner, F.lit("|"), first, F.lit(")"))

        return F.aggregate(words, piece, lambda text, w: F.when(text.contains(w["word"]), F.regexp_replace(text, whole(w), w["new"])).otherwise(text))

    # Two mentions of a column of words, so that it is computed once for a row and not for each piece.
    rows = rows.withColumn(near, beside).withColumn(pieces, F.when(F.size(words) > 0, F.transform(pieces, renamed)).otherwise(F.col(pieces)))
    joined = F.transform(matches, lambda m, i: F.concat(_replaced(m, F.col(new)), F.element_at(F.col(pieces), i + 2)))
    text = F.when(some, F.concat(F.element_at(pieces, 1), F.array_join(joined, ""))).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*[f"`{c}`" for c in documents.columns])
