"""Surrogates for personal data: keyed, alike in type, script, gender and format, checked for collisions.

People are named word by word: every word of a name has one surrogate, so
that all mentions of a person agree, whole or in part, with or without a title.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .tables import table

# What is detected.  Every shape starts where no letter or digit stands before, so runs are read once.
EMAIL = r"(?<![._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])"
ADDRESS = r"(?<!\.)(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])"
ADDRESS6 = r"(?<!:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![\p{L}\p{N}:])"
ACCOUNT = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SOCIAL = r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])"
PHONE = r"(?<!\+)(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}])"
CARD = r"(?<![.-])(?:[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19})(?![\p{L}\p{N}])"
KINDS = (("email", EMAIL), ("account", ACCOUNT), ("address6", ADDRESS6), ("address", ADDRESS), ("social", SOCIAL), ("phone", PHONE), ("card", CARD))
# Titles, particles inside names, and what stands before an untitled full name.
MEN, WOMEN = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Signor", "господин"), ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mademoiselle", "Señora", "Signora", "госпожа")
NEUTRAL = ("Dr", "Doctor", "Prof", "Professor", "Rev", "Mx", "доктор", "профессор")
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "da", "di", "du", "la", "le", "el", "al", "bin", "ibn", "ter", "zu")
CUES = ("My name is", "my name is", "I am called", "Name:", "name:", "Dear", "From:", "To:", "Signed:", "Author:", "Contact:", "Patient:", "Customer:", "Regards,", "Sincerely,")
# Alphabets that letters stay in.
VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnprstvz"
CYRILLIC_VOWELS, CYRILLIC_CONSONANTS = "аеиоу", "бвгдзклмнпрст"
GREEK_VOWELS, GREEK_CONSONANTS = "αεηιο", "βγδζκλμνπρστ"
SCRIPTS = ((VOWELS, CONSONANTS), (CYRILLIC_VOWELS, CYRILLIC_CONSONANTS), (GREEK_VOWELS, GREEK_CONSONANTS))
#: How surrogates of names end, by what a word is (woman's, man's or other given name, surname) and script (Latin, Cyrillic, Greek).
ENDINGS = {"f": ("na", "на", "να"), "m": ("n", "н", "ς"), "n": ("l", "л", "λ"), "s": ("r", "р", "ρ")}


def _titles(titles: tuple[str, ...]) -> str:
    return "|".join(sorted({*titles, *map(str.upper, titles)}))


ALONE = r"(?<![\p{L}\p{N}])"
#: A word of a name, and a name of several.
WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}{1,30}(?:[-'’]\p{Lu}\p{L}{1,30}){0,3}(?![\p{L}\p{N}])"
REST = rf" (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{WORD}"
TITLE = rf"(?:(?:{_titles(MEN + WOMEN + NEUTRAL)})\.? ){{1,3}}"
TITLED = rf"(?=[{''.join(sorted({t[0] for x in MEN + WOMEN + NEUTRAL for t in (x, x.upper())}))}]){TITLE}(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{WORD}(?:{REST}){{0,3}}"
CUED = rf"(?=\p{{Lu}})(?<=(?:{'|'.join(CUES)})[ \n]){WORD}(?:{REST}){{1,3}}"
PERSON = rf"{ALONE}(?:{TITLED}|{CUED})"
PLAIN = "|".join(shape.replace(r"\1", r"\k<gap>").replace("([ -])", "(?<gap>[ -])") for _, shape in KINDS)
#: Entities of texts that name nobody, and of others, where every capitalised word may name somebody.
ENTITY, NAMED = f"{ALONE}(?:{PLAIN})", f"{ALONE}(?:{PLAIN}|{WORD})"
#: A text without any of these holds no entity but people; this is quicker to tell.
HINT = r"@|[0-9][0-9.) -]{0,2}[0-9]|::|[0-9A-Fa-f]:[0-9A-Fa-f]"
#: Characters of a name's surrogate before its ending.
STEM = 8
#: Rounds of fresh surrogates in the entity's own format; then every round adds a character.
ROUNDS = 8


def people(text: Column) -> Column:
    """The words of all people's names that a text shows by a title or cue: array of (word in small letters, mark).

    Marks are keys of ENDINGS: the last word of a name, or the only one, is the surname.
    """
    def marked(person: Column) -> Column:
        title = F.regexp_extract(person, f"^(?:{TITLE})?", 0)
        gender = F.when(title.rlike(rf"(?:^| )(?:{_titles(WOMEN)})\.? "), "f").when(title.rlike(rf"(?:^| )(?:{_titles(MEN)})\.? "), "m").otherwise("n")
        words = F.regexp_extract_all(F.substring(person, F.length(title) + 1, F.length(person)), F.lit(ALONE + WORD), F.lit(0))
        return F.transform(words, lambda w, i: F.struct(F.lower(w).alias("word"), F.when(i < F.size(words) - 1, gender).otherwise("s").alias("mark")))

    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)), marked))


def shape_of(named: Column) -> Column:
    """The expression whose matches are replaced or looked up, for a text that names somebody or doesn't."""
    return F.when(named, F.lit(NAMED)).otherwise(F.lit(ENTITY))


def kind_of(hit: Column, mark: Column) -> Column:
    """The kind of a match: a name if it has a mark, else the first shape that it fits as a whole; null if it is no entity.

    A bare run of digits that is no card number by length (16) or check digit is none.
    """
    out = F.lit(None).cast("string")
    for kind, shape in reversed(KINDS):
        fits = hit.rlike(f"^(?:{shape})$")
        if kind == "card":
            fits = fits & ((F.length(hit) == 16) | hit.rlike("[ -]") | _luhn(F.regexp_replace(hit, "[^0-9]", "")))
        out = F.when(fits, F.lit(kind)).otherwise(out)
    return F.when(mark.isNotNull(), F.lit("name")).otherwise(out)


def _groups(address: Column) -> Column:
    """The eight groups of an internet address of version 6, four digits each."""
    half = lambda k: F.filter(F.split(F.element_at(F.split(F.lower(address), "::"), k), ":"), lambda g: g != "")
    short = F.concat(half(1), F.array_repeat(F.lit("0"), F.lit(8) - F.size(half(1)) - F.size(half(2))), half(2))
    return F.transform(F.when(address.contains("::"), short).otherwise(half(1)), lambda g: F.lpad(g, 4, "0"))


def normal(kind: Column, hit: Column) -> Column:
    """The entity behind a spelling: digits alone for numbers, small letters for the rest."""
    return (
        F.when(kind.isin("phone", "card", "social"), F.regexp_replace(hit, "[^0-9]", ""))
        .when(kind == "account", F.regexp_replace(hit, " ", ""))
        .when(kind == "address6", F.concat_ws(":", _groups(hit)))
        .otherwise(F.lower(hit))
    )


def _stream(seed: Column, many: Column) -> Column:
    """Numbers below 2^16 of a keyed stream, one for each of ``many`` places: sixteen to a hash."""
    hashes = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.floor(many / 16).cast("int")), lambda k: F.sha2(F.concat_ws("|", seed, k.cast("string")), 256)))
    return F.transform(F.regexp_extract_all(hashes, F.lit("[0-9a-f]{4}"), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def _pick(letters: Column, number: Column) -> Column:
    return F.substring(letters, number % F.length(letters) + 1, F.lit(1))


def _letters(c: Column) -> Column:
    """What a character may become: the alphabet of its class and script; null for anything but letters and digits."""
    small = F.lower(c)
    of = lambda some: F.instr(F.lit(some), small) > 0
    return (
        F.when(c.between("0", "9"), "0123456789").when(of("aeiouyàâäåãáèéêëìíîïòóôöõøùúûüæœ"), VOWELS).when(small.between("a", "z") | small.between("ß", "ɏ"), CONSONANTS)
        .when(of("аеёиоуыэюя"), CYRILLIC_VOWELS).when(small.between("Ѐ", "ӿ"), CYRILLIC_CONSONANTS).when(of("αεηιουωάέήίόύώ"), GREEK_VOWELS).when(small.between("Ͱ", "Ͽ"), GREEK_CONSONANTS)
        .when(c.rlike(r"\p{L}"), "".join(chr(0x4E00 + 41 * k) for k in range(64)))
    )


def _alike(text: Column, seed: Column, fixed: Column, letters: Callable[[Column], Column] = _letters) -> Column:
    """``text`` with every letter and digit beyond the first ``fixed`` characters replaced by one alike."""
    def like(c: Column, i: Column, number: Column) -> Column:
        new = F.transform(F.array(letters(c)), lambda x: F.when(x.isNull() | (i < fixed), c).otherwise(_pick(x, number)))[0]
        return F.when((c != F.lower(c)) & (i >= fixed), F.upper(new)).otherwise(new)

    placed = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.concat_ws("", F.zip_with(placed, F.slice(_stream(seed, F.length(text)), F.lit(1), F.length(text)), lambda p, n: like(p["c"], p["i"], n)))


def _luhn(digits: Column) -> Column:
    """Whether a number ends in the check digit of card numbers."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int"))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    ) % 10 == 0


def _rest97(account: Column) -> Column:
    """An account number modulo 97, its first four characters moved to the end and letters read as 10 to 35; 1 if its check digits are right."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    return F.aggregate(
        F.split(turned, ""), F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def _script(word: Column, latin: Column, cyrillic: Column, greek: Column) -> Column:
    return F.when(word.rlike(r"^[Ѐ-ӿ]"), cyrillic).when(word.rlike(r"^[Ͱ-Ͽ]"), greek).otherwise(latin)


def _widened(letters: Column, numbers: Column, more: Column) -> Column:
    """As many more characters as ``more`` says."""
    return F.concat_ws("", F.transform(F.slice(numbers, F.lit(1), F.greatest(more, F.lit(0))), lambda n: _pick(letters, n)))


def with_surrogates(found: DataFrame, secret: str) -> DataFrame:
    """Rows (kind, norm, attempt) with ``fake``: the keyed surrogate of a normal form, in normal form; of a name only its beginning.

    Numbers keep their length (cards and phones also their first digit, accounts their country, and
    cards and accounts right check digits if theirs were right), internet addresses stay valid (those of
    version 6 keep their zeros), mail addresses keep their ending, names their script.  Attempts beyond
    ROUNDS, for formats that are full, add characters to mailboxes, names and numbers, and draw zeros of
    addresses, too.
    """
    kind, norm, seed = F.col("kind"), F.col("norm"), F.concat_ws("|", F.lit(secret), "kind", "norm", F.col("attempt").cast("string"))
    more = F.col("attempt") - F.lit(ROUNDS)
    hexadecimal = lambda c: F.when(c.between("1", "9") | c.between("a", "f"), "123456789abcdef").when((c == "0") & (F.col("attempt") > ROUNDS), "0123456789abcdef")
    rows = found.select(
        "*", seed.alias("__seed"),
        F.when(kind == "email", F.regexp_extract(norm, "^(.*)@", 1)).otherwise(norm).alias("__own"),
        F.when(kind.isin("card", "phone"), 1).when(kind == "account", 2).otherwise(0).alias("__fixed"),
        F.when(kind == "email", F.regexp_extract(norm, r"@(.*)\.[^.]*$", 1)).otherwise("").alias("__host"),
        F.when(kind.isin("email", "name"), _script(norm, *(F.lit(v + c) for v, c in SCRIPTS))).otherwise("0123456789").alias("__letters"),
        _stream(F.concat("norm", seed), F.greatest(F.lit(STEM), more)).alias("__numbers"),
    )
    turns = F.sequence(F.lit(0), F.lit(STEM - 1))
    stem = F.concat_ws("", F.zip_with(turns, F.slice("__numbers", 1, STEM), lambda k, n: _pick(F.when(k % 2 == 0, _script(norm, *(F.lit(c) for _, c in SCRIPTS))).otherwise(_script(norm, *(F.lit(v) for v, _ in SCRIPTS))), n)))
    octets = F.concat_ws(".", F.transform(F.slice("__numbers", 1, 4), lambda n: (n % 254 + 1).cast("string")))
    drawn = rows.select(
        "*",
        F.when(kind == "name", stem).when(kind == "address", octets).when(kind == "address6", _alike(norm, F.col("__seed"), F.lit(0), hexadecimal)).otherwise(_alike(F.col("__own"), F.col("__seed"), F.col("__fixed"))).alias("__new"),
        # a host is one surrogate for all its mailboxes
        _alike(F.col("__host"), F.concat_ws("|", F.lit(secret), F.lit("zone"), "__host"), F.lit(0)).alias("__zone"),
    )
    longer = drawn.withColumn("__new", F.when(kind.isin("address", "address6"), F.col("__new")).otherwise(F.concat("__new", _widened(F.col("__letters"), F.reverse("__numbers"), more))))
    new = F.col("__new")
    # of ten last digits exactly one passes the check
    checked = F.filter(F.transform(F.split(F.lit("0123456789"), ""), lambda d: F.concat(F.substring(new, F.lit(1), F.length(new) - 1), d)), _luhn)[0]
    # the check digits are what is missing to 98 with zeros in their place
    rest = F.substring(new, F.lit(5), F.length(new))
    right = F.concat(F.substring(new, 1, 2), F.lpad((F.lit(98) - _rest97(F.concat(F.substring(new, 1, 2), F.lit("00"), rest))).cast("string"), 2, "0"), rest)
    fake = (
        F.when(kind == "email", F.concat(new, F.lit("@"), F.col("__zone"), F.regexp_extract(norm, r"(\.[^.]*)$", 1)))
        .when((kind == "card") & _luhn(norm), checked).when((kind == "account") & (_rest97(norm) == 1), right).otherwise(new)
    )
    return longer.select(*found.columns, fake.alias("fake"))


def spell(kind: Column, hit: Column, mark: Column, fake: Column) -> Column:
    """A surrogate's normal form written in the format of ``hit``; names get the ending of their mark."""
    def fill(shape: str) -> Column:
        gaps, marks = F.split(hit, shape, -1), F.concat(F.split(fake, ""), F.array(F.lit("")))
        return F.concat_ws("", F.zip_with(gaps, marks, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))))

    shouted = (hit == F.upper(hit)) & (hit != F.lower(hit))
    ending = F.lit("")
    for m, by_script in ENDINGS.items():
        ending = F.when(mark == m, _script(fake, *map(F.lit, by_script))).otherwise(ending)
    name = F.concat(fake, ending)
    # where the hit leaves out zeros, so does its surrogate, as far as it still has them
    groups = F.transform(F.split(fake, ":"), lambda g: F.when(g.rlike("^0+$"), "0").otherwise(F.ltrim(g, F.lit("0"))))
    side = lambda k: F.size(F.filter(F.split(F.element_at(F.split(hit, "::"), k), ":"), lambda g: g != ""))
    inside = F.slice(groups, side(1) + 1, F.lit(8) - side(1) - side(2))
    short = F.concat(F.concat_ws(":", F.slice(groups, F.lit(1), side(1))), F.lit("::"), F.concat_ws(":", F.slice(groups, F.lit(9) - side(2), side(2))))
    six = F.when(hit.contains("::") & F.forall(inside, lambda g: g == "0"), short).otherwise(F.concat_ws(":", groups))
    return (
        F.when(kind.isin("phone", "card", "social"), fill("[0-9]"))
        .when(kind == "account", fill("[A-Z0-9]"))
        .when(kind == "name", F.when(shouted, F.upper(name)).otherwise(F.initcap(name)))
        .when(kind == "address6", F.when(shouted, F.upper(six)).otherwise(six))
        .when((kind == "email") & shouted, F.upper(fake))
        .otherwise(fake)
    )


def _told(kind: Column, norm: Column) -> Column:
    """What a surrogate must differ in from real entities: of names the beginning, whatever the ending."""
    return F.when(kind == "name", F.substring(norm, 1, STEM)).otherwise(norm)


def resolve(found: DataFrame, secret: str) -> DataFrame:
    """``found`` (kind, norm; distinct) with ``fake``: no two entities of a kind share one, and none is a real entity.

    Entities whose surrogate is taken (all but the least that ask for it) or is
    some entity's own form get a fresh one, round by round, until none is left:
    the space of surrogates grows with every round beyond ROUNDS.  A count a round
    reaches the driver.
    """
    now = cut(with_surrogates(found.withColumn("attempt", F.lit(0)), secret))
    real = cut(found.select("kind", _told(F.col("kind"), F.col("norm")).alias("told")).distinct().withColumn("real", F.lit(True)))
    while True:
        place = F.row_number().over(Window.partitionBy("kind", "fake").orderBy("attempt", "norm"))
        met = now.withColumn("place", place).withColumn("told", _told(F.col("kind"), F.col("fake"))).join(real, ["kind", "told"], "left")
        judged = cut(met.withColumn("taken", (F.col("place") > 1) | F.coalesce("real", F.lit(False))).drop("place", "real", "told"))
        if judged.where("taken").isEmpty():
            return judged.select("kind", "norm", "fake")
        again = with_surrogates(judged.where("taken").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), secret)
        now = cut(judged.where("NOT taken").select("kind", "norm", "attempt", "fake").unionAll(again))


def replace_entities(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """``docs`` with every entity of ``text`` replaced, and ``n_entities``.

    The same entity gets the same surrogate in every document and spelling, and
    different entities different ones, by a hash keyed with ``secret``: whoever
    has the key can tell surrogates of guessed entities, so keep it.  People are
    found by titles and cues; from there on every capitalised word of the
    document that is one of their names is replaced, too, so mentions without a
    title or of a part of the name agree.  A word is one name in all documents:
    namesakes share its surrogate.  Given names take the gender of a title
    they follow in the document (a woman's, if of both), else a neutral ending.

    Rows without an entity pass through untouched and unshuffled; the others are
    written to the checkpoint folder once, so no text is searched more than twice.
    Null texts stay null with 0 entities.  Other columns, whatever their names,
    stay; a column ``n_entities`` is replaced.  An empty table gives no rows.
    """
    if not secret:
        raise ValueError("surrogates need a key")
    kept = [c for c in docs.columns if c != "n_entities"]
    body = F.col(text)
    holds = F.coalesce(body.rlike(PERSON) | (body.rlike(HINT) & body.rlike(ENTITY)), F.lit(False))
    plain = docs.where(~holds).select(*kept, F.lit(0).alias("n_entities"))
    rows = docs.where(holds).select(F.struct(*kept).alias("row"), body.alias("body")).withColumn("people", people(F.col("body"))).withColumn("named", F.size("people") > 0)
    some = cut(rows.select("row", "people", "named", F.regexp_extract_all("body", shape_of(F.col("named")), F.lit(0)).alias("hits"), F.sha2("body", 256).alias("name")))
    # only what people are called and what matches travels, once for all copies of a text
    names = some.where("named").select("name", F.explode("people").alias("p")).groupBy("name", F.col("p.word").alias("word")).agg(F.min("p.mark").alias("mark"))
    places = some.select("name", F.posexplode("hits").alias("at", "hit")).distinct().withColumn("word", F.lower("hit"))
    known = places.join(names, ["name", "word"], "left").withColumn("kind", kind_of(F.col("hit"), F.col("mark")))
    known = cut(known.select("name", "at", "hit", "mark", "kind", normal(F.col("kind"), F.col("hit")).alias("norm")))
    resolved = resolve(known.where("kind IS NOT NULL").select("kind", "norm").distinct(), secret)
    news = known.join(resolved, ["kind", "norm"], "left").select(
        "name", "at", F.when(F.col("kind").isNull(), F.col("hit")).otherwise(spell(F.col("kind"), F.col("hit"), F.col("mark"), F.col("fake"))).alias("new"), F.col("kind").isNotNull().alias("found")
    )
    by_text = news.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias("news"), F.count_if("found").cast("int").alias("n"))
    gaps = F.split(F.col("row")[text], shape_of(F.col("named")), -1)
    written = F.concat_ws("", F.zip_with(gaps, F.col("news.new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))))
    changed = some.drop("people", "hits").join(by_text, "name").select("row", written.alias("written"), "n")
    columns = [F.col("written").alias(c) if c == text else F.col("row")[c].alias(c) for c in kept]
    return plain.unionAll(changed.select(*columns, F.col("n").alias("n_entities")))


#: The key of the query, which is public: its results hide nothing from those who know it.
QUERY_KEY = "op5_surrogates"


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return replace_entities(table(spark, sf_dir, "documents"), QUERY_KEY)


QUERIES = {"op5_surrogates": op5_surrogates}
ORACLES: dict[str, str] = {}
