"""Personal data: detection and keyed surrogates, with DataFrame functions only.

Entities are found by one pattern. What an entity is called by (mail address in lower case, digits of a phone, value of a secret, each
part of a name without its title) gets one surrogate, derived from a secret key and that value, so the same entity in any spelling is
the same surrogate everywhere (coreference) and different entities stay different (distinctness). The parts of a titled name are also
replaced where they stand alone in the same document. Names that have no title anywhere in their document aren't detected. A surrogate keeps the
entity's type and format: digits stay digits and separators stay where they are, hexadecimal stays hexadecimal in the same case,
cards keep a valid check digit (numbers of that form without one aren't cards and stay), mail addresses and host numbers move to ranges set aside for examples,
and names after a title come from lists of the same gender and script.

Two entities that draw the same surrogate, and a surrogate that is itself an entity of the corpus, are collisions: those entities
draw again with the next counter. Later draws come from larger spaces of the same form: host numbers from all of 240/4, names built
from syllables, mail addresses with a longer local part. Where a format of fixed length is so full that entities are still left after
the last draw, they trade places: each takes the value of another entity of its format, which no other surrogate is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from nearfield.llm.common import Scratch, quoted

#: Surrogate given names by gender and script, and surnames by script. All lists of one script have one length.
NAMES = {
    ("f", "latin"): "Ada Alba Anna Berta Carla Clara Cora Dora Edda Elena Elsa Emma Flora Frida Greta Hanna Ida Ina Irma Julia Karla Lara Lea Lena Lina Lola Luna Maria Marta Mina Nora Olga".split(),
    ("m", "latin"): "Adam Alan Albert Anton Ben Bruno Carl Cesar David Egon Emil Erik Felix Franz Georg Hugo Ivan Jan Jonas Karl Leo Linus Luis Marco Max Milo Nils Oscar Otto Paul Pedro Theo".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Ева Елена Жанна Зоя Инна Ирина Кира Лариса Лидия Мария Нина Ольга".split(),
    ("m", "cyrillic"): "Антон Борис Вадим Виктор Глеб Денис Егор Иван Игорь Кирилл Лев Марк Максим Олег Павел Юрий".split(),
    ("s", "latin"): "Abel Arndt Baum Berg Blanc Boyer Braun Bruno Campos Conti Dale Dumas Ernst Falk Ferro Gallo Gomez Grant Haas Hale Iglesias Jansen Kern Lang Leroy Lopez Marsh Moreno Noel Oliva Perez Rossi".split(),
    ("f", "greek"): "Αγνή Άννα Βάσω Δάφνη Ελένη Ζωή Ηρώ Ιωάννα Καίτη Λένα Μαρία Νίκη Ξένια Ρένα Σοφία Χαρά".split(),
    ("m", "greek"): "Άγγελος Βασίλης Γιάννης Δήμος Ηλίας Θάνος Κώστας Λάμπρος Μάρκος Νίκος Πάνος Πέτρος Σάββας Σπύρος Τάσος Φώτης".split(),
    ("s", "greek"): "Βέργος Γαλανός Δούκας Ζέρβας Θωμάς Κανάρης Λάσκος Μάνος Μελάς Νέγρης Παππάς Ράλλης Ρήγας Σίμος Τζανής Φωκάς".split(),
    ("s", "cyrillic"): "Белов Волков Громов Дорин Ежов Жуков Зимин Ильин Котов Лугов Маров Носов Орлов Попов Рудин Титов".split(),
}
#: Titles before a name, by the gender they tell.
TITLES = {"f": "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|госпожа|г-жа|κυρία|κα", "m": "Mr|Herr|Herrn|Monsieur|Señor|Sr|Don|господин|г-н|κύριος|κος"}
NAME = r"\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+)?"
YEAR = r"(?:1[5-9]|20)\d\d"
#: Dates, with or without separators and time: no phone numbers.
DATE = rf"(?:{YEAR}[-./ ](?:1[0-2]|0?[1-9])[-./ ](?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])[-./ ](?:3[01]|[12]\d|0?[1-9])[-./ ]{YEAR}|{YEAR}(?:1[0-2]|0[1-9])(?:3[01]|[12]\d|0[1-9])(?:\d{{4}}(?:\d\d)?)?|(?:3[01]|[12]\d|0[1-9])(?:1[0-2]|0[1-9]){YEAR})(?!\d)"
#: Phone numbers have 7 to 15 digits. Numbers of one length around a hyphen (ranges), thousands in groups and numbers after a year are
#: none, unless a word for phone stands before them.
PHONES = [
    r"\+\d(?:[ .()/-]{0,3}\d){6,14}",
    rf"\((?!{YEAR}\)|\d+\)[ .-]{{0,2}}{DATE})(?:\d{{3,5}}\)[ .-]{{0,2}}\d(?:[ .-]?\d){{3,9}}|\d\d\)[ .-]{{0,2}}\d(?:[ .-]?\d){{4,11}})",
    r"(?<=(?i:phone|mobile?|handy|call|fax|tel|telefon|teléfono|móvil)[.:]? |(?:т|Т)ел[.:]? |(?:т|Т)елефон[.:]? )\d(?:[ ./-]?\d){6,14}",
    r"0\d{1,4}(?:[ /-]{1,3}|\.)\d(?:[ .-]?\d){4,12}",
    r"(?!\d+0{5}(?!\d))\d{7,15}",
    rf"(?!{YEAR}[ -])(?:(?:\d{{2,5}}[ .-])?\d{{3}}-\d{{4}}|\d\d-\d{{5,8}}|\d{{3}}-\d{{5,8}}|\d{{4}}-\d{{5,8}}|\d{{5}}-\d{{6,8}})(?![ .-]\d)",
    rf"(?!{YEAR}[ -])(?!\d{{1,3}}(?:[ .]\d{{3}})+(?![ .-]?\d))(?!\d\d[ .-]\d\d[ .-]\d\d(?![ .-]?\d))(?!(?:[ .-]?\d){{16}})\d{{2,5}}+(?:[ .-](?!{DATE})\d{{2,5}}+){{2,5}}+",
]
PHONE = rf"(?<![\w+$€£#])(?<!\d[.,:/-])(?=[+(\d])(?!{DATE})(?:{'|'.join(PHONES)})(?![\w-]|[.,:/]\d)"
#: Types in order of preference, with patterns that have no capturing group.
TYPES = {
    # Begins only where a run begins and never gives back, so that long runs of letters stay linear.
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.){1,30}[A-Za-z]{2,}",
    "secret": r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?[A-Za-z0-9+/_\-]{16,}[\"']?",
    "key": r"\b(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})",
    "ipv4": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d-])(?!00[1-9](?:[ -]?\d){10,12}(?![ -]?\d))\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": PHONE,
    "name": rf"\b(?:{TITLES['f']}|{TITLES['m']})\.? {NAME}",
}
ENTITY = "|".join(TYPES.values())
ROUNDS = 8
#: Consonants and vowels of built names, and the end of a built name by its list in NAMES.
SOUNDS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αειου")}
ENDS = {("f", "latin"): "na", ("m", "latin"): "n", ("s", "latin"): "rt", ("f", "cyrillic"): "на", ("m", "cyrillic"): "н", ("s", "cyrillic"): "ров", ("f", "greek"): "να", ("m", "greek"): "νος", ("s", "greek"): "ρης"}


def kind_of(entity: Column) -> Column:
    """The first type whose pattern is the whole entity."""
    return reduce(lambda found, t: F.when(entity.rlike(rf"^(?:{TYPES[t]})$"), F.lit(t)).otherwise(found), reversed([*TYPES]), F.lit("phone"))


#: Country codes by their length.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
LEAD = r"^(?i:[a-z_ -]+\s*[=:]\s*[\"']?)"
TITLE = rf"^(?:{TITLES['f']}|{TITLES['m']})\.? "
#: A word that may be part of a name, and what follows the name in it.
WORD, TAIL = r"(?<!\p{L})\p{Lu}[\p{L}'’-]+", r"(?:(?<=.)['’][sS])?['’-]*$"
ITEMS = "array<struct<kind:string,entity:string>>"


def _part(word: Column) -> Column:
    """What a word of a name is looked up by."""
    return F.lower(F.regexp_replace(F.regexp_replace(word, TAIL, ""), "’", "'"))


def _as_part(word: Column, new: Column) -> Column:
    """The surrogate in the case of the word, with its possessive or other tail."""
    base = F.regexp_replace(word, TAIL, "")
    return F.concat(F.when((F.length(base) > 1) & (base == F.upper(base)), F.upper(new)).otherwise(F.initcap(new)), F.substr(word, F.length(base) + 1))


def _secret_value(entity: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(entity, LEAD, ""), "[\"']$", "")


def items_of(entity: Column, kind: Column) -> Column:
    """The values that a found entity stands for: one, or the parts of a name."""
    plus = F.regexp_replace(F.regexp_replace(entity, r"^00(?=[1-9])", "+"), r"^(\+[\d .-]*)\(0\)", "$1")
    plain = (
        F.when(kind == "email", F.lower(entity)).when(kind == "secret", _secret_value(entity)).when(kind == "phone", F.regexp_replace(plus, "[^0-9+]", ""))
        .when(kind.isin("iban", "card"), F.regexp_replace(entity, "[ -]", "")).otherwise(entity)
    )
    female = entity.rlike(rf"^(?:{TITLES['f']})\.? ")
    words = F.split(F.regexp_replace(entity, TITLE, ""), " ")
    role = lambda i: F.when(i + 1 == F.size(words), F.lit("surname")).when(female, F.lit("given f")).otherwise(F.lit("given m"))
    named = F.transform(words, lambda w, i: F.struct(role(i).alias("kind"), _part(w).alias("entity")))
    return F.when(kind == "name", named).otherwise(F.array(F.struct(kind.alias("kind"), plain.alias("entity")))).cast(ITEMS)


def _spelled(entity: Column, kind: Column, new: Column) -> Column:
    """The surrogates of an entity's values in the entity's own spelling."""
    first = new[0]
    digits = F.regexp_replace(entity, "[^0-9A-Za-z]", "")
    # What a spelling has before the number itself (00, a trunk 0) stays.
    national = F.regexp_replace(first, COUNTRY, "")
    shown = F.when(kind == "phone", F.concat(F.substr(digits, F.lit(1), F.length(digits) - F.length(national)), national)).otherwise(first)
    gaps = F.split(entity, "[0-9A-Za-z]", -1)
    grouped = F.concat_ws("", F.flatten(F.zip_with(gaps, F.concat(F.regexp_extract_all(shown, F.lit("[0-9A-Za-z]"), F.lit(0)), F.array(F.lit(""))), lambda g, c: F.array(g, c))))
    title = F.regexp_extract(entity, TITLE, 0)
    words = F.split(F.regexp_replace(entity, TITLE, ""), " ")
    secret = F.concat(F.regexp_extract(entity, LEAD, 0), first, F.regexp_extract(entity, "[\"']$", 0))
    return (
        F.when(kind == "name", F.concat(title, F.concat_ws(" ", F.zip_with(words, new, _as_part)))).when(kind == "secret", secret)
        .when(kind.isin("phone", "card", "iban"), grouped).otherwise(first)
    )


def _stream(entity: Column, kind: Column, counter: Column, key: str) -> Column:
    """128 keyed hexadecimal digits and 128 more for long entities."""
    seed = F.concat_ws("|", F.lit(key), kind, counter.cast("string"), entity)
    return F.concat(F.sha2(seed, 512), F.sha2(F.concat(F.lit("+"), seed), 512))


def _draw(stream: Column, at: Column | int, values: Column | int) -> Column:
    """A number in [0, values) from six hexadecimal digits; places wrap around."""
    at = F.lit(at) if isinstance(at, int) else at
    return (F.conv(F.substr(stream, (at * 6) % 246 + 1, F.lit(6)), 16, 10).cast("long") % values).cast("int")


def _pick(words: list[str], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), index + 1)


def _name(sort: str, script: str, stream: Column, at: int, counter: Column) -> Column:
    """A name of the list at the first two draws; then one of counter + 2 syllables, so that each draw has more names."""
    syllables = [c + v for c in SOUNDS[script][0] for v in SOUNDS[script][1]]
    built = F.concat_ws("", F.transform(F.sequence(F.lit(1), counter + 2), lambda i: _pick(syllables, _draw(stream, i * 2 + at + 3, len(syllables)))))
    return F.when(counter < 2, _pick([n.lower() for n in NAMES[sort, script]], _draw(stream, at, len(NAMES[sort, script])))).otherwise(F.concat(built, F.lit(ENDS[sort, script])))


def _masked(text: Column, stream: Column) -> Column:
    """Every digit and letter by another of its sort (digit, a-f, A-F, other lower, other upper); the rest stays."""
    sorts = [("0123456789", "[0-9]"), ("abcdefghijklmnopqrstuvwxyz", "[a-z]"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "[A-Z]")]
    hexadecimal = text.rlike(r"^[^g-zG-Z]*$")

    def one(c: Column, i: Column) -> Column:
        out = c
        for letters, pattern in reversed(sorts):
            range_ = F.lit(len(letters)) if letters[0] == "0" else F.when(hexadecimal, F.lit(6)).otherwise(F.lit(26))
            out = F.when(c.rlike(pattern), F.substr(F.lit(letters), _draw(stream, i, range_) + 1, F.lit(1))).otherwise(out)
        return out

    return F.concat_ws("", F.transform(F.split(text, ""), one))


def _luhn(number: Column, skip: int = 0) -> Column:
    """The check sum of a card number's digits from the right; skip is 1 where the last digit is still missing."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))

    def value(c: Column, i: Column) -> Column:
        doubled = c.cast("int") * 2
        return F.when((i + skip) % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(c.cast("int"))

    return F.aggregate(F.transform(digits, value), F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0))) % 10


def is_real(entity: Column) -> Column:
    """Whether what the pattern found is personal: a number in the form of a card is a card only with a valid check digit."""
    return ~entity.rlike(rf"^(?:{TYPES['card']})$") | (_luhn(entity) == 0)


def _with_check_digit(masked: Column) -> Column:
    """Ends the number with its Luhn digit."""
    head = F.regexp_replace(masked, "[0-9]$", "")
    return F.concat(head, ((10 - _luhn(head, 1)) % 10).cast("string"))


def surrogate(entity: Column, kind: Column, counter: Column, key: str, stream: Column | None = None) -> Column:
    """The surrogate of an entity at the given draw; stream: its keyed digits, where they are a column already."""
    stream = _stream(entity, kind, counter, key) if stream is None else stream
    local, end = F.regexp_extract(entity, r"^([^@]+)@", 1), F.concat(F.lit("mail"), _draw(stream, 40, 1000).cast("string"), F.lit(".example.org"))
    longer = F.when(counter > 0, F.concat(F.lit("."), F.substr(stream, F.lit(121), counter * 8))).otherwise(F.lit(""))
    email = F.concat(_masked(local, stream), longer, F.lit("@"), end)
    net = F.when(counter == 0, F.concat(F.lit("198."), (18 + _draw(stream, 0, 2)).cast("string"))).otherwise(F.concat((240 + _draw(stream, 3, 15)).cast("string"), F.lit("."), _draw(stream, 0, 256).cast("string")))
    host = F.concat(net, F.lit("."), _draw(stream, 1, 256).cast("string"), F.lit("."), _draw(stream, 2, 256).cast("string"))
    iban = F.concat(F.substr(entity, F.lit(1), F.lit(2)), _masked(F.substr(entity, F.lit(3)), stream))
    prefix = F.regexp_extract(entity, r"^(?:AKIA|gh[pousr]_|sk-|eyJ)", 0)
    token = F.concat(prefix, _masked(F.substr(entity, F.length(prefix) + 1), stream))
    cyrillic, greek = entity.rlike(r"\p{IsCyrillic}"), entity.rlike(r"\p{IsGreek}")

    def name(sort: str, at: int) -> Column:
        return F.when(cyrillic, _name(sort, "cyrillic", stream, at, counter)).when(greek, _name(sort, "greek", stream, at, counter)).otherwise(_name(sort, "latin", stream, at, counter))

    country = F.coalesce(F.nullif(F.regexp_extract(entity, COUNTRY, 0), F.lit("")), F.regexp_extract(entity, "^0?", 0))
    phone = F.concat(country, _masked(F.substr(entity, F.length(country) + 1), stream))
    plain = _masked(entity, stream)
    return (
        F.when(kind == "email", email).when(kind == "ipv4", host).when(kind == "key", token).when(kind == "iban", iban)
        .when(kind == "card", _with_check_digit(plain)).when(kind == "phone", phone)
        .when(kind == "given f", name("f", 1)).when(kind == "given m", name("m", 1)).when(kind == "surname", name("s", 2)).otherwise(plain)
    )

def _format(entity: Column) -> Column:
    """The entity with every digit as 0, lower letter as a and upper letter as A."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(entity, "[0-9]", "0"), r"\p{Ll}", "a"), r"\p{Lu}", "A")


def _traded(left: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """(entity, kind, surrogate): in keyed order each takes the next one's value of the same kind and format; a single one another's."""
    form = _format(F.col("entity")).alias("form")
    order = Window.partitionBy("kind", "form").orderBy(F.sha2(F.concat_ws("|", F.lit(key), "entity"), 256), "entity")
    around = F.coalesce(F.lead("entity").over(order), F.first("entity").over(order))
    ring = left.select("entity", "kind", form).withColumn("next", around)
    ends = entities.select("entity", "kind", form).groupBy("kind", "form").agg(F.min("entity").alias("low"), F.max("entity").alias("high"))
    other = F.when(F.col("next") != F.col("entity"), F.col("next")).when(F.col("low") != F.col("entity"), F.col("low")).otherwise(F.col("high"))
    return ring.join(ends, ["kind", "form"]).select("entity", "kind", other.alias("surrogate"))


def _unique_surrogates(entities: DataFrame, key: str, store: Scratch) -> DataFrame:
    """(entity, kind, surrogate) with all surrogates distinct, and none of them an entity unless its format is full."""
    open_ = entities.select("entity", "kind", F.lit(0).alias("counter"))
    done: list[DataFrame] = []
    for step in range(ROUNDS):
        named = [F.col(c) for c in ("entity", "kind", "counter")]
        streams = open_.withColumn("_stream", _stream(*named, key))  # once for each entity, not for each character
        drawn = store.step(streams.withColumn("surrogate", surrogate(*named, key, F.col("_stream"))).drop("_stream"), f"drawn{step}")
        winners = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "entity")).alias("winner"))
        taken = entities.select(F.col("entity").alias("surrogate"))
        for before in done:
            taken = taken.unionByName(before.select("surrogate"))
        free = store.step(winners.join(taken, "surrogate", "left_anti"), f"free{step}")
        won = drawn.join(free, "surrogate", "left").withColumn("ok", F.coalesce(F.col("winner") == F.struct("kind", "entity"), F.lit(False)))
        won = store.step(won.select("entity", "kind", "counter", "surrogate", "ok"), f"won{step}")
        done.append(won.where("ok").select("entity", "kind", "surrogate"))
        open_ = won.where("not ok").select("entity", "kind", (F.col("counter") + 1).alias("counter"))
        if open_.isEmpty():
            break
    else:
        done.append(_traded(open_, entities, key))
    return reduce(DataFrame.unionByName, done)


def replace_personal_data(documents: DataFrame, key: str, name: str = "pii") -> DataFrame:
    """All columns of documents with entities in text replaced, and n_entities.

    A null text stays null with no entities; a text without entities is unchanged byte for byte; repeated rows get the same
    surrogates; null ids and columns of any name pass through; a text of any length is searched whole, in one row; an empty table
    gives no rows. A column named n_entities is replaced.
    """
    store = Scratch(documents.sparkSession, name)
    others = [c for c in documents.columns if c not in ("text", "n_entities")]
    row = F.struct(*(F.col(quoted(c)) for c in others)) if others else F.lit(None).cast("int")
    # A cheap look first: every entity has a digit, an @ or a title.
    hint = F.col("text").rlike(rf"[0-9@]|\b(?:{TITLES['f']}|{TITLES['m']})\.? |(?i:token|secret|passw|api[_-]?key|access[_-]?key)")
    found = F.when(hint, F.regexp_extract_all(F.col("text"), F.lit(f"({ENTITY})"), F.lit(1)))
    # Every text is searched once: the table keeps what was found, and the pieces between for the texts that hold something.
    searched = documents.select("text", row.alias("row"), F.monotonically_increasing_id().alias("rid"), found.alias("found"))
    rich = F.coalesce(F.exists("found", is_real), F.lit(False))
    searched = store.step(searched.select("rid", "row", "found", rich.alias("rich"), F.when(~rich, F.col("text")).alias("text"), F.when(rich, F.split(F.col("text"), ENTITY, -1)).alias("parts")), "searched")
    held = searched.where("rich")
    met = held.select("rid", F.posexplode("found").alias("at", "entity"))
    surfaces = met.groupBy("entity").agg(F.count("*").alias("n")).where(is_real(F.col("entity"))).select("entity", kind_of(F.col("entity")).alias("kind"))
    surfaces = store.step(surfaces.withColumn("items", items_of(F.col("entity"), F.col("kind"))), "surfaces")
    items = surfaces.select(F.col("entity").alias("surface"), F.col("kind").alias("type"), F.posexplode("items").alias("at", "item")).select("surface", "type", "at", "item.*")
    values = store.step(items.select("kind", "entity").distinct(), "entities")
    known = _unique_surrogates(values, key, store)
    parts_of = items.join(known, ["kind", "entity"]).groupBy("surface", "type").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate", "kind", "entity"))).alias("new"))
    spelling = _spelled(F.col("surface"), F.col("type"), F.col("new.surrogate"))
    known = store.step(parts_of.select(F.col("surface").alias("entity"), spelling.alias("surrogate"), F.when(F.col("type") == "name", F.col("new")).alias("names")), "surrogates")
    # Both sides are plain tables, so the rows of an entity that is everywhere can be split.
    spelled = met.join(known.drop("names"), "entity", "left").select("rid", "at", F.coalesce("surrogate", "entity").alias("surrogate"), F.col("surrogate").isNotNull().alias("real"))
    spelled = spelled.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate"))).alias("new"), F.count_if("real").cast("int").alias("n"))
    # A part that is both a given name and a surname in one document stands for the surname.
    named = met.join(known.where("names is not null"), "entity").select("rid", F.explode("names").alias("x"))
    named = named.groupBy("rid", "x.entity").agg(F.max_by("x.surrogate", F.struct("x.kind", "x.surrogate")).alias("surrogate"))
    named = named.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("names"))
    whole = held.select("rid", "row", "found", "parts").join(spelled, "rid").join(named, "rid", "left")
    alone = lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0))
    renamed = lambda w: F.coalesce(_as_part(w, F.col("names")[_part(w)]), w)
    between = lambda p: F.concat_ws("", F.flatten(F.zip_with(F.split(p, WORD, -1), F.concat(F.transform(alone(p), renamed), F.array(F.lit(""))), lambda g, w: F.array(g, w))))
    more = F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(F.filter(alone(p), lambda w: F.map_contains_key("names", _part(w)))))
    pieces = F.when(F.col("names").isNotNull(), F.transform("parts", between)).otherwise(F.col("parts"))
    text = F.concat_ws("", F.flatten(F.zip_with(pieces, F.concat(F.col("new.surrogate"), F.array(F.lit(""))), lambda p, s: F.array(p, s))))
    replaced = whole.select("row", text.alias("text"), (F.col("n") + F.when(F.col("names").isNotNull(), more).otherwise(0)).alias("n_entities"))
    every = searched.where("not rich").select("row", "text", F.lit(0).alias("n_entities")).unionByName(replaced)
    columns = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns if c != "n_entities"]
    return every.select(*columns, "n_entities")
