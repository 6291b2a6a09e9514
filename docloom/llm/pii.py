"""Personal data replaced by keyed surrogates of the same type.

Entities are found by expressions. Each distinct entity, in a normal form that
its spellings share, gets one surrogate from a keyed hash: digits for digits,
letters for letters, octets for octets, a valid check digit where there was
one, a given name of the same gender and script for a given name. Surrogates
that meet an entity of the corpus or another's surrogate are drawn again until
none does, so distinct entities stay distinct; equal ones stay equal wherever
they occur. A spelling's case and punctuation are kept. Where draws keep
meeting others, an e-mail address gets a longer name and an address of octets
may have more digits. People are found by title, by a given name of the lists,
or by what is written around two names; a name without any of these stays.

All of it is DataFrame functions. Only rows that hold an entity are shuffled.

Defined cases: null text stays null and empty text empty; rows equal in id and
text are handled alike and each is returned; of matches that start at one place
the type first in ``TYPES`` counts; other columns pass through whatever their
names; an empty table gives an empty result. If the values of a form of digits
are so nearly used up that ``ROUNDS`` draws leave two alike, an error is raised.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.common import small_side, write_shared

#: Draws before giving up, and distinct spellings up to which their table is
#: broadcast.
ROUNDS, BROADCAST_ROWS = 64, 100_000
#: Draws after which addresses may get longer.
SAME_LENGTH = 6

#: Titles by gender, and given names by gender and script.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "г-н", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "г-жа", "Κυρία"),
    "n": ("Dr", "Prof", "Professor", "Doctor", "доктор", "профессор"),
}
#: What stands before or after two names of a person.
BEFORE = ("Dear", "named", "name is", "contact", "Contact", "signed by", "written by", "wrote to", "on behalf of")
AFTER = ("wrote", "said", "asked", "replied", "answered", "signed", "called")
GIVEN = {
    ("m", "latin"): ("James", "John", "Robert", "Michael", "David", "Thomas", "Pierre", "Hans", "Carlos", "Peter", "Daniel", "Martin", "Paul", "Andrew", "Stefan", "Luis"),
    ("f", "latin"): ("Mary", "Anna", "Linda", "Sarah", "Julia", "Emma", "Claire", "Greta", "Carmen", "Laura", "Susan", "Helen", "Maria", "Alice", "Sophie", "Lucia"),
    ("m", "cyrillic"): ("Иван", "Пётр", "Сергей", "Андрей", "Николай", "Дмитрий", "Олег", "Павел"),
    ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Наталья", "Ирина", "Татьяна", "Светлана"),
    ("m", "greek"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Παύλος", "Ανδρέας", "Στέφανος", "Πέτρος"),
    ("f", "greek"): ("Μαρία", "Ελένη", "Άννα", "Σοφία", "Κατερίνα", "Ιωάννα", "Δήμητρα", "Χριστίνα"),
}
SURNAMES = {
    "latin": ("Walker", "Turner", "Fischer", "Moreau", "Delgado", "Bennett", "Keller", "Lambert", "Navarro", "Hughes", "Weber", "Garnier", "Romero", "Parker", "Vogel", "Marchand"),
    "cyrillic": ("Коваленко", "Шевченко", "Бондаренко", "Ткаченко", "Черных", "Белых", "Долгих", "Кравчук"),
    "greek": ("Νικολάου", "Γεωργίου", "Δημητρίου", "Ιωάννου", "Βασιλείου", "Αντωνίου", "Παύλου", "Χρήστου"),
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
_both_cases = lambda words: "(?:" + "|".join(dict.fromkeys(x for w in words for x in (w, w.upper()))) + ")"
_TITLE = _both_cases(t for ts in TITLES.values() for t in ts)
_KNOWN = _both_cases(n for ns in GIVEN.values() for n in ns)
_CONTEXT = rf"(?<=(?:{'|'.join(BEFORE)}) ){_NAME} {_NAME}|{_NAME} {_NAME}(?= (?:{'|'.join(AFTER)})\b)"
#: Expressions of the types, in order of preference. Groups repeat within bounds
#: (a name has 127 labels at most), as Java matches them by recursion.
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?){0,126}\.[A-Za-z]{2,}",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\dA-Za-z+])\d(?:[ -]?\d){12,18}(?![\dA-Za-z])",
    "ssn": r"(?<![\dA-Za-z-])\d{3}-\d{2}-\d{4}(?![\dA-Za-z-])",
    "phone": r"(?<![\dA-Za-z])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\+(?=\d(?:[ .-]?\d){6})\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\dA-Za-z.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    "person": rf"(?=\p{{Lu}}|[гдп])(?<![\p{{L}}\d])(?:{_TITLE}\.? {_NAME}(?: {_NAME})?|{_KNOWN} {_NAME}|{_CONTEXT})",
}
_DIGITS = "|".join(f"(?:{TYPES[t]})" for t in ("ip", "iban", "card", "ssn", "phone"))
#: Any entity. The lookahead only spares attempts that can't match.
ANY = rf"(?:{TYPES['email']})|(?=[\d+(]|[A-Z]{{2}}\d)(?:{_DIGITS})|(?:{TYPES['person']})"


def holds_entity(text: Column) -> Column:
    """Whether any entity occurs, by cheap tests first; false for null."""
    email = F.contains(text, F.lit("@")) & text.rlike(TYPES["email"])
    digits = text.rlike(r"\d[\d .()-]{5}|[A-Z]{2}\d") & text.rlike(rf"(?=[\d+(]|[A-Z]{{2}}\d)(?:{_DIGITS})")
    return F.coalesce(email | digits | text.rlike(TYPES["person"]), F.lit(False))


def type_of(found: Column) -> Column:
    """The type of a whole match."""
    return F.coalesce(*[F.when(found.rlike(rf"\A(?:{p})\z"), F.lit(t)) for t, p in TYPES.items()], F.lit("person"))


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _in(word: Column, names) -> Column:
    return word.isin(*names)


def parts(kind: Column, found: Column) -> Column:
    """What is replaced in a match: an array of ``(kind, norm)``."""
    words = F.split(found, " ")
    first = F.lower(F.regexp_replace(words[0], r"\.\z", ""))
    titles = {g: [t.lower() for t in ts] for g, ts in TITLES.items()}
    titled = first.isin(*[t for ts in titles.values() for t in ts])
    names = F.when(titled, F.slice(words, 2, 9)).otherwise(words)
    known = lambda g: reduce(lambda a, b: a | b, [_in(F.lower(names[0]), [n.lower() for n in GIVEN[k]]) for k in GIVEN if k[0] == g])
    by_name = F.when(known("f"), "f").when(known("m"), "m").otherwise("n")
    gender = F.when(first.isin(*titles["f"]), "f").when(first.isin(*titles["m"]), "m").otherwise(by_name)
    person = F.transform(
        names,
        lambda w, i: F.struct(
            F.concat_ws("_", F.when(i < F.size(names) - 1, F.concat(F.lit("given_"), gender)).otherwise("surname"), _script(w)).alias("kind"), F.lower(w).alias("norm")
        ),
    )
    one = lambda norm: F.array(F.struct(kind.alias("kind"), norm.alias("norm")))
    return (
        F.when(kind == "person", person)
        .when(kind == "email", one(F.lower(found)))
        .when(kind == "iban", one(F.replace(found, F.lit(" "), F.lit(""))))
        .when(kind == "ip", one(found))
        .otherwise(one(F.regexp_replace(found, r"\D", "")))
    )


def _draw(seed: Column, i: Column, n: Column | int) -> Column:
    """A number below n from the 512-bit ``seed`` at place i."""
    return (F.conv(F.substring(seed, F.pmod(i * 3, F.lit(120)).cast("int") + 1, F.lit(6)), 16, 10).cast("long") % n).cast("int")


def _spelled(text: Column, seed: Column, keep: Column | int = 0) -> Column:
    """Letters for letters and digits for digits, from place ``keep`` on."""
    letter = lambda i, base: F.char(_draw(seed, i, 26) + F.lit(ord(base)))
    return F.array_join(
        F.transform(
            F.split(text, ""),
            lambda c, i: F.when(i < keep, c).when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string")).when(c.rlike("[a-z]"), letter(i, "a")).when(c.rlike("[A-Z]"), letter(i, "A")).otherwise(c),
        ),
        "",
    )


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, modulo 10."""
    value = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")),
    )
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10


def _name(names, seed: Column, attempt: Column) -> Column:
    """A name of the list; after a collision one of more parts."""
    pool = F.array(*map(F.lit, names))
    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: F.element_at(pool, _draw(seed, i, len(names)) + 1)), "-"))


def _mod97(text: Column) -> Column:
    """Remainder of the number that letters (10 to 35) and digits spell."""
    digit = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + digit(c)) % 97).otherwise((r * 100 + digit(c)) % 97))


def _iban(norm: Column, seed: Column) -> Column:
    """Country kept, the rest drawn, with right check digits where they were right."""
    drawn = _spelled(norm, seed, 2)
    country, rest = F.substring(norm, 1, 2), F.substring(drawn, F.lit(5), F.length(norm))
    check = F.lpad((98 - _mod97(F.concat(rest, country, F.lit("00")))).cast("string"), 2, "0")
    right = _mod97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1
    return F.when(right, F.concat(country, check, rest)).otherwise(drawn)


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity in its normal form."""
    seeded = lambda *x: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, *x).cast("binary"), 512)
    seed = seeded(norm, attempt.cast("string"))
    longer = F.greatest(attempt - SAME_LENGTH, F.lit(0))
    host = F.regexp_extract(norm, r"@(.*)\.[a-z]+\z", 1)
    local = F.concat(F.regexp_extract(norm, r"\A([^@]*)", 1), F.repeat(F.lit("x"), longer))
    mail = F.concat(_spelled(local, seed), F.lit("@"), _spelled(host, seeded(F.lit("host"), host)), F.regexp_extract(norm, r"(\.[a-z]+)\z", 1))
    sized = lambda o, i: F.when(F.length(o) == 3, _draw(seed, i, 156) + 100).when(F.length(o) == 2, _draw(seed, i, 90) + 10).otherwise(_draw(seed, i, 10))
    octet = lambda o, i: F.when(longer > 0, _draw(seed, i, 256)).otherwise(sized(o, i))
    ip = F.array_join(F.transform(F.split(norm, r"\."), lambda o, i: octet(o, i).cast("string")), ".")
    drawn = _spelled(norm, seed, 1)
    body = F.concat(F.substring(drawn, F.lit(1), F.length(norm) - 1))
    card = F.when(_luhn(norm) == 0, F.concat(body, F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))).otherwise(drawn)
    out = F.when(kind == "email", mail).when(kind == "ip", ip).when(kind == "card", card).when(kind == "iban", _iban(norm, seed))
    scripts = {script for _, script in GIVEN}
    given = GIVEN | {("n", s): GIVEN["m", s] + GIVEN["f", s] for s in sorted(scripts)}
    for (gender, script), names in given.items():
        out = out.when(kind == f"given_{gender}_{script}", _name(names, seed, attempt))
    for script, names in SURNAMES.items():
        out = out.when(kind == f"surname_{script}", _name(names, seed, attempt))
    return out.when(kind == "phone", _spelled(norm, seed, F.when(F.length(norm) > 10, F.length(norm) - 10).otherwise(0))).otherwise(_spelled(norm, seed))


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """``(kind, norm, new)`` for distinct ``(kind, norm)``: no two rows of a kind
    share ``new``, and no ``new`` is an entity of the corpus."""
    state = entities.withColumn("attempt", F.lit(0))
    known = entities.select("kind", F.col("norm").alias("new"), F.lit(True).alias("real"))
    turn = Window.partitionBy("kind", "new").orderBy("attempt", "norm")
    for _ in range(ROUNDS):
        drawn = state.withColumn("new", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key))
        judged = write_shared(
            drawn.withColumn("turn", F.row_number().over(turn)).join(known, ["kind", "new"], "left")
            .select("kind", "norm", "attempt", "new", (F.col("real").isNotNull() | (F.col("turn") > 1)).alias("clash")), "surrogates")
        if not judged.filter("clash").head(1):
            return judged.select("kind", "norm", "new")
        state = judged.select("kind", "norm", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
    raise ValueError(f"surrogates still collide after {ROUNDS} draws: a form has too few values")


def _woven(found: Column, new: Column) -> Column:
    """``new`` in the punctuation and case of the spelling ``found``."""
    chars, fresh = F.split(found, ""), F.split(F.regexp_replace(new, r"[^\p{L}\p{N}]", ""), "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(s: Column, c: Column) -> Column:
        put = F.get(fresh, s["at"])
        cased = F.when(c.rlike("[A-Z]"), F.upper(put)).otherwise(put)
        word = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(s["out"], F.when(word, cased).otherwise(c)).alias("out"), (s["at"] + word.cast("int")).alias("at"))

    return F.aggregate(chars, start, step, lambda s: s["out"])


def _named(found: Column, news: Column) -> Column:
    """A person's spelling with new names, title and case kept."""
    words = F.split(found, " ")
    kept = F.size(words) - F.size(news)
    fresh = F.transform(news, lambda n, i: F.when(F.get(words, i + kept).rlike(r"\A\P{Ll}{2,}\z"), F.upper(n)).otherwise(F.array_join(F.transform(F.split(n, "-"), F.initcap), "-")))
    return F.array_join(F.concat(F.slice(words, 1, kept), fresh), " ")


def pseudonymised(docs: DataFrame, key: str = "docloom", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row struct, n_entities)``: the rows with surrogates in their text."""
    text = F.col("row")[text_col].cast("string")
    rows = docs.select(F.struct("*").alias("row"))
    clean = rows.filter(~holds_entity(text)).select("row", F.lit(0).alias("n_entities"))
    hits = write_shared(rows.filter(holds_entity(text)).select("row", F.md5(F.concat_ws("\x1f", F.col("row")[id_col].cast("string"), F.isnull(F.col("row")[id_col]).cast("string"), text).cast("binary")).alias("row_key")), "hits")
    found = write_shared(
        hits.select("row_key", F.posexplode(F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).alias("at", "found")).distinct(), "entities"
    )
    spellings = found.select("found").distinct().withColumn("type", type_of(F.col("found")))
    split = write_shared(spellings.select("found", "type", F.posexplode(parts(F.col("type"), F.col("found"))).alias("part", "p")).select("found", "type", "part", "p.kind", "p.norm"), "parts")
    new = dictionary(split.select("kind", "norm").distinct(), key)
    news = F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda x: x["new"])
    rendered = write_shared(
        split.join(new, ["kind", "norm"]).groupBy("found", "type").agg(news.alias("news"))
        .select("found", F.when(F.col("type") == "person", _named(F.col("found"), F.col("news"))).when(F.col("type").isin("email", "ip") & (F.length("found") != F.length(F.col("news")[0])), F.col("news")[0]).otherwise(_woven(F.col("found"), F.col("news")[0])).alias("put")), "spellings")
    puts = found.join(small_side(rendered, rendered.count(), BROADCAST_ROWS), "found").groupBy("row_key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "put"))), lambda x: x["put"]).alias("puts")
    )
    pieces = F.split(text, ANY, -1)
    whole = F.array_join(F.flatten(F.zip_with(pieces, F.array_append("puts", F.lit("")), lambda p, r: F.array(p, r))), "")
    done = hits.join(puts, "row_key").select(F.col("row").withField(text_col, whole).alias("row"), F.size("puts").alias("n_entities"))
    return clean.unionByName(done)
