"""PII: detected entities become keyed surrogates of the same type and form.

Detection, surrogates, collision checks and rewriting are DataFrame functions. Mentions of one entity that differ in case
or punctuation alone share its identity: a name or an address in lower case, the digits of a number. Each distinct entity
of the corpus gets one surrogate, drawn from a keyed hash; entities whose surrogate meets another's or a real entity of
the same kind, case aside, are drawn again with the next counter. Case and punctuation of each mention are put back last.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarf.llm.common import let, stage, starts, unstage

# Given names by gender in Latin and Cyrillic script, titles and phrases before a name, words before a number.
GIVEN = {
    "latin_f": ["Anna", "Maria", "Julia", "Laura", "Sophie", "Emma", "Clara", "Elena", "Sarah", "Lucia", "Marie", "Eva", "Paula", "Nina", "Ida", "Alice"],
    "latin_m": ["John", "Peter", "Paul", "Thomas", "Lucas", "Martin", "David", "Daniel", "Felix", "Jonas", "Pierre", "Carlos", "Hugo", "Max", "Simon", "Oscar"],
    "cyrillic_f": ["Анна", "Мария", "Елена", "Ольга", "Ирина", "Наталья", "Татьяна", "Светлана"],
    "cyrillic_m": ["Иван", "Пётр", "Алексей", "Сергей", "Дмитрий", "Андрей", "Михаил", "Николай"],
}
TITLES = {"f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Г-жа"], "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Г-н"], "": ["Dr", "Prof"]}
PHRASES = ["my name is", "My name is", "ich heiße", "Ich heiße", "mein Name ist", "Mein Name ist", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "меня зовут", "Меня зовут", "Name:", "name:", "Nom :", "Nombre:", "Signed,"]
NUMBER_WORDS = ["phone", "tel", "telephone", "téléphone", "telefon", "teléfono", "mobile", "mobil", "móvil", "portable", "handy", "cell", "fax", "call"]
# The country codes of one and two digits; all others have three.
CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
SOUNDS = {
    "latin": ("b br d dr f g gr h k l m n p r s st t tr v w".split(), "a e i o u".split(), ["", "l", "n", "r", "s"], "ard berg ell er ford man mann ow son ton".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т".split(), "а е и о у".split(), ["", "л", "н", "р"], "ов ев ин".split()),
}
#: Rounds after which real values may serve as another's surrogate, and those after which a kind must have too few forms.
STRICT, ROUNDS = 32, 64
LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def noise(key: str, value: Column, counter: Column, use: str) -> Column:
    """64 hexadecimal digits from key, counter, use and value; the outer hash keeps the key from being extended."""
    inner = F.sha2(F.concat(F.lit(key), F.lit("\x1f"), F.lit(use), F.lit("\x1f"), counter.cast("string"), F.lit("\x1f"), value), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def number(hex_digits: Column, start: int, below: int) -> Column:
    """A number under `below` from six of the digits."""
    return F.conv(F.substring(hex_digits, start, 6), 16, 10).cast("long") % below


def reform(key: str, value: Column, counter: Column, use: str) -> Column:
    """Each letter and digit replaced by a keyed one of its class; everything else stays where it is."""

    def run(h: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            block = F.sha2(F.concat(h, (i / 32).cast("int").cast("string")), 256)
            n = F.conv(F.substring(block, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            pick = lambda s: F.substring(F.lit(s), n % len(s) + 1, F.lit(1))
            return F.when(c.rlike("[0-9]"), pick(DIGITS)).when(c.rlike("[a-z]"), pick(LETTERS)).otherwise(c)

        return F.array_join(F.transform(F.split(value, ""), one), "")

    return let(noise(key, value, counter, use), run)


def email(key: str, value: Column, counter: Column, gender: Column) -> Column:
    """Local part re-formed, longer where that collides, at a keyed host in a domain that belongs to nobody."""
    longer = F.when(counter == 0, F.lit("")).otherwise(F.substring(noise(key, value, counter, "longer"), F.lit(1), F.least(counter + 2, F.lit(60))))
    return F.concat(reform(key, F.substring_index(value, "@", 1), counter, "email"), longer, F.lit("@"), F.concat(F.lit("m"), F.substring(noise(key, F.substring_index(value, "@", -1), F.lit(0), "host"), 1, 6)), F.lit(".example.net"))


def ipv4(key: str, value: Column, counter: Column, gender: Column) -> Column:
    """An address of the block for private use; one of the whole space where that collides."""
    first = lambda h: F.when(counter == 0, F.lit("10")).otherwise((number(h, 25, 223) + 1).cast("string"))
    return let(noise(key, value, counter, "ipv4"), lambda h: F.concat_ws(".", first(h), *[number(h, s, 256).cast("string") for s in (1, 9, 17)]))


def phone(key: str, value: Column, counter: Column, gender: Column) -> Column:
    """The country code stays, and a leading zero unless that collides; all other digits are new."""
    stays = F.concat(F.regexp_extract(value, rf"^(?:\+(?:{CODES}|[0-9]{{3}}))?", 0), F.when(counter == 0, F.regexp_extract(value, "^0", 0)).otherwise(F.lit("")))
    return F.concat(stays, reform(key, F.substring(value, F.length(stays) + 1, F.length(value)), counter, "phone"))


def check_digit(digits: Column) -> Column:
    """The last digit that makes the check sum of a card hold, from all digits before it."""

    def add(acc: Column, d: Column) -> Column:
        twice = F.when(acc["odd"], d.cast("int") * 2).otherwise(d.cast("int"))
        return F.struct((acc["sum"] + twice - F.when(twice > 9, 9).otherwise(0)).alias("sum"), (~acc["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(True).alias("odd"))
    return F.aggregate(F.reverse(F.filter(F.split(digits, ""), lambda c: c.rlike("[0-9]"))), start, add, lambda acc: (10 - acc["sum"] % 10) % 10)


def checks(digits: Column) -> Column:
    return check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1)).cast("int")


def card(key: str, value: Column, counter: Column, gender: Column) -> Column:
    """The first digit stays, and the last one makes the check sum hold if it held."""
    new = F.concat(F.left(value, F.lit(1)), reform(key, F.substring(value, F.lit(2), F.length(value) - 2), counter, "card"))
    return let(new, lambda x: F.concat(x, F.when(checks(value), check_digit(x).cast("string")).otherwise(number(noise(key, value, counter, "last"), 1, 10).cast("string"))))


def family(key: str, of: Column, counter: Column, script: str) -> Column:
    """A made-up family name of keyed syllables, more of them as the counter grows."""
    onset, vowel, coda, end = (F.array(*map(F.lit, x)) for x in SOUNDS[script])
    sizes = [len(x) for x in SOUNDS[script]]
    pick = lambda h, start, choice, n: F.get(choice, number(h, start, n).cast("int"))

    def run(h: Column) -> Column:
        one = lambda i: let(F.sha2(F.concat(h, i.cast("string")), 256), lambda b: F.concat(pick(b, 1, onset, sizes[0]), pick(b, 9, vowel, sizes[1]), pick(b, 17, coda, sizes[2])))
        return F.initcap(F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2) + (counter / 4).cast("int")), one), ""), pick(h, 1, end, sizes[3])))

    return let(noise(key, of, counter, "family"), run)


def person(key: str, value: Column, counter: Column, gender: Column) -> Column:
    """A name of as many words: a given name of the same gender and script, made-up family names, initials for initials.

    The gender is that of a listed given name, else of a title somewhere before the name, else feminine where the given name
    ends in a. People of one family name share the new one, unless their surrogates collide.
    """
    words = F.split(value, " ")
    cyrillic, given = value.rlike(r"\p{IsCyrillic}"), F.initcap(words[0])
    known = F.lit(None).cast("string")
    for kind, names in GIVEN.items():
        known = F.when(given.isin(*names), kind[-1]).otherwise(known)
    female = F.coalesce(known, F.when(gender != "", gender), F.when(given.rlike("[aаяáà]$"), "f").otherwise("m")) == "f"

    def pick(kind: str, of: Column) -> Column:
        return F.get(F.array(*map(F.lit, GIVEN[kind])), number(noise(key, of, F.lit(0), kind), 1, len(GIVEN[kind])).cast("int"))

    first = F.when(cyrillic, F.when(female, pick("cyrillic_f", words[0])).otherwise(pick("cyrillic_m", words[0]))).otherwise(F.when(female, pick("latin_f", words[0])).otherwise(pick("latin_m", words[0])))
    seed = lambda w: F.when(counter == 0, w).otherwise(F.concat(value, F.lit("\x1f"), w))
    ends = lambda w: F.when(w.rlike("[оеи][внй]а$|ая$"), F.lit("а")).otherwise(F.lit(""))  # noqa: E731  the feminine form
    last = lambda w: F.when(cyrillic, F.concat(family(key, seed(w), counter, "cyrillic"), ends(w))).otherwise(family(key, seed(w), counter, "latin"))
    initial = lambda w: F.concat(F.substring(F.lit(LETTERS.upper()), number(noise(key, seed(w), counter, "initial"), 1, 26).cast("int") + 1, F.lit(1)), F.lit("."))
    new = F.transform(words, lambda w, i: F.when((i == 0) & (F.size(words) > 1), first).when(w.endswith("."), initial(w)).otherwise(last(w)))
    return F.array_join(new, " ")


def cased(value: Column, surrogate: Column) -> Column:
    """The surrogate in capitals if the value is, else with capitals where the value has them before its @."""
    local = F.substring_index(value, "@", 1)
    return F.when(F.upper(value) == value, F.upper(surrogate)).otherwise(F.array_join(F.transform(F.split(surrogate, ""), lambda c, i: F.when(F.substring(local, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), ""))


def punctuated(value: Column, surrogate: Column) -> Column:
    """The value with the digits of the surrogate in place of its own."""
    digits = F.regexp_replace(surrogate, "[^0-9]", "")
    before = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9]", ""))
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, before(i), F.lit(1))).otherwise(c)), "")


def called(value: Column, of: Column, surrogate: Column) -> Column:
    """The whole surrogate of the name `of`, or the word of it that stands where the value stands in `of`; all in capitals if the value is."""
    place = F.array_position(F.split(F.lower(of), " "), F.lower(value)).cast("int")
    new = F.when((place > 0) & (F.size(F.split(of, " ")) > 1), F.get(F.split(surrogate, " "), place - 1)).otherwise(surrogate)
    return F.when((F.upper(value) == value) & (F.length(value) > 2), F.upper(new)).otherwise(new)


@dataclass(frozen=True)
class Kind:
    """pattern finds candidates, is_it tells kinds apart by form, holds what counts; identity, draw and render make surrogates."""

    name: str
    pattern: str
    is_it: Callable[[Column], Column]
    identity: Callable[[Column], Column]
    draw: Callable[[str, Column, Column, Column], Column]
    render: Callable[[Column, Column, Column], Column]
    holds: Callable[[Column], Column] = lambda value: F.lit(True)


def either(words: list[str]) -> str:
    return "|".join(words)


_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:['’-]\p{L}{2,}){0,2}"
_LISTED = either([n for ns in GIVEN.values() for n in [*ns, *map(str.upper, ns)]])
_BEFORE = rf"(?:(?<=(?<![\p{{L}}\p{{N}}])(?:{either([t for ts in TITLES.values() for t in ts])})\.? )|(?<=(?<![\p{{L}}\p{{N}}])(?:{either(PHRASES)}) ))"
_PERSON = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:(?:{_LISTED}) (?:\p{{Lu}}\. )?{_WORD}|{_BEFORE}{_WORD}(?: \p{{Lu}}\.)?(?: {_WORD}){{0,2}})(?![\p{{L}}\p{{N}}])"
_BYTE = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IPV4 = rf"{_BYTE}(?:\.{_BYTE}){{3}}"
_FOURS = "[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}"
_CARD = rf"(?:{_FOURS}|[2-6][0-9]{{12,18}}|[2-6][0-9]{{3}}(?:[ -][0-9]{{4}}){{2}}[ -][0-9]{{1,4}}(?:[ -][0-9]{{1,3}})?|3[47][0-9]{{2}}[ -][0-9]{{6}}[ -][0-9]{{5}})"
_WORDS_BEFORE = rf"(?<=(?<![\p{{L}}\p{{N}}])(?i:{either(NUMBER_WORDS)})[.:]{{0,2}} {{0,2}})"
_PHONES = (
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    r"\+(?=(?:[ .()/-]{0,3}+[0-9]){8,15}(?![0-9]))[1-9](?:[ .()/-]{0,3}+[0-9]){7,14}",
    r"0[1-9](?:[ .-][0-9]{2}){4}",
    r"0[1-9][0-9]{1,3}[ /][0-9]{3,4}[ -]?[0-9]{3,5}",
    rf"{_WORDS_BEFORE}[0-9](?:[ .()/-]?[0-9]){{6,14}}",
)
#: In order of precedence; where matches meet, the leftmost wins, then the earlier kind. Each pattern gives up at once
#: inside a word: addresses only start where such a run starts, numbers at a digit, bracket or plus, and names with a
#: capital. No part repeats a group without a bound, so a text of any length needs no deep stack.
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9])[A-Za-z0-9.-]*\.[A-Za-z]{2,}", lambda v: v.contains("@"), F.lower, email, lambda v, of, s: cased(v, s), lambda v: ~v.rlike(r"\.\.|@[.-]")),
    Kind("card", rf"(?=[2-6])(?<![0-9A-Za-z.+-]){_CARD}(?![0-9A-Za-z])", lambda v: v.rlike(rf"^{_CARD}$"), lambda v: F.regexp_replace(v, "[^0-9]", ""), card, lambda v, of, s: punctuated(v, s), lambda v: v.rlike(f"^{_FOURS}$") | checks(F.regexp_replace(v, "[^0-9]", ""))),
    Kind("ipv4", rf"(?=[0-9])(?<![0-9.]){_IPV4}(?![0-9]|\.[0-9])", lambda v: v.rlike(f"^{_IPV4}$"), lambda v: v, ipv4, lambda v, of, s: s),
    Kind("phone", rf"(?=[+(0-9])(?<![0-9A-Za-z+])(?:{either(list(_PHONES))})(?![0-9A-Za-z])", lambda v: v.rlike(r"^[+(0-9]"), lambda v: F.regexp_replace(v, r"(?<!^)[^0-9]|^[^+0-9]", ""), phone, lambda v, of, s: punctuated(v, s)),
    Kind("person", _PERSON, lambda v: v.rlike(r"^\p{Lu}"), F.lower, person, called),
)
ANY = "|".join(f"(?:{k.pattern})" for k in KINDS)


def by_kind(kind: Column, what: Callable[[Kind], Column]) -> Column:
    out = F.lit(None)
    for k in reversed(KINDS):
        out = F.when(kind == k.name, what(k)).otherwise(out)
    return out


def kind_of(value: Column) -> Column:
    """The kind of a candidate by its form; null if it doesn't hold, as a long number without a card's check sum."""
    out = F.lit(None).cast("string")
    for k in reversed(KINDS):
        out = F.when(k.is_it(value), F.when(k.holds(value), F.lit(k.name))).otherwise(out)
    return out


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, identity, gender) to (kind, identity, surrogate): within a kind no two are equal but for case, and none is a real identity.

    Rounds go over what still collides; of several entities with one surrogate the least keeps it. Those tables shrink to
    nothing within a few rounds, as each counter draws anew. Should a kind have hardly more forms than entities, rounds from
    STRICT on let the surrogate of one be the real value of another, which is itself replaced everywhere.
    """
    todo, done, counter = entities.select("kind", "identity", "gender"), None, 0
    while True:
        made = by_kind(F.col("kind"), lambda k: k.draw(key, F.col("identity"), F.lit(counter), F.col("gender")))  # noqa: B023
        drawn = stage(todo.select("kind", "identity", "gender", made.alias("surrogate")).withColumn("folded", F.lower("surrogate")), "drawn")
        good = drawn.join(drawn.groupBy("kind", "folded").agg(F.min("identity").alias("identity")), ["kind", "folded", "identity"])
        if counter < STRICT:
            good = good.join(entities.select("kind", F.col("identity").alias("folded")), ["kind", "folded"], "left_anti")
        else:
            good = good.where("folded <> identity")
        if done is not None:
            good = good.join(done.select("kind", F.lower("surrogate").alias("folded")), ["kind", "folded"], "left_anti")
        good = good.select("kind", "identity", "surrogate")
        after = stage(good if done is None else done.unionByName(good), "surrogates")
        rest = stage(drawn.select("kind", "identity", "gender").join(after.select("kind", "identity"), ["kind", "identity"], "left_anti"), "colliding")
        unstage(drawn)
        if done is not None:
            unstage(done)
        todo, done, counter = rest, after, counter + 1
        if not rest.take(1):
            return done
        if counter == ROUNDS:
            raise ValueError("some kind has too few forms for the distinct entities of this corpus")


def candidates(docs: DataFrame) -> DataFrame:
    """uid, doc_id, text where nothing is found, else between and found: what lies between the candidates, and these.

    In a text with full names, each of their words alone is a candidate as well.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("first", F.when(F.rlike("text", F.lit(ANY)), F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    names = F.filter("first", lambda v: v.rlike(r"^\p{Lu}.* ") & ~v.contains("@"))
    words = F.filter(F.flatten(F.transform(names, lambda v: F.split(v, " "))), lambda w: (F.length(w) > 2) & ~w.endswith("."))
    rows = rows.withColumn("words", F.array_distinct(F.concat(words, F.transform(words, F.upper), F.transform(words, F.initcap))))
    alone = F.concat(F.lit(ANY + r"|(?=\p{Lu})(?<![\p{L}\p{N}])(?:"), F.array_join("words", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    rows = rows.withColumn("pattern", F.when(F.size("words") > 0, alone).otherwise(F.lit(ANY)))
    hit = F.col("first").isNotNull()
    rows = rows.select("uid", "doc_id", F.when(~hit, F.col("text")).alias("text"), F.when(hit, F.split("text", F.col("pattern"), -1)).alias("between"), F.when(hit, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).alias("found"))
    return stage(rows, "candidates")


def mentions_of(hits: DataFrame) -> DataFrame:
    """uid, at, value, of (the full name that a single word belongs to, the first in the text, else the value), kind, identity, gender."""
    names = F.array_distinct(F.filter("found", lambda v: v.rlike(r"^\p{Lu}.* ") & ~v.contains("@")))
    holder = lambda v, ns: F.when(v.rlike(r"^\p{Lu}[^ @]*$"), F.get(F.filter(ns, lambda n: F.array_contains(F.split(F.lower(n), " "), F.lower(v))), F.lit(0)))
    ends = lambda b, titles: b.rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{either(titles)})\.? $")
    title = lambda b: F.when(ends(b, TITLES["f"]), "f").when(ends(b, TITLES["m"]), "m").otherwise("")
    each = F.zip_with("found", F.slice("between", F.lit(1), F.size("found")), lambda v, b: F.struct(v.alias("value"), F.when(v.rlike(r"^\p{Lu}") & ~v.contains("@"), title(b)).otherwise("").alias("gender")))
    m = hits.select("uid", names.alias("names"), F.posexplode(each).alias("at", "m")).select("uid", "at", "m.value", "m.gender", F.coalesce(holder(F.col("m.value"), F.col("names")), F.col("m.value")).alias("of"))
    m = m.withColumn("kind", kind_of(F.col("value")))
    return m.withColumn("identity", by_kind(F.col("kind"), lambda k: k.identity(F.col("of"))))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """One row per input row: doc_id, text with surrogates in place of entities, n_entities, entities ('kind:start:end').

    Offsets are code points of the input, ends exclusive. Null and empty texts are empty. Equal entities get equal surrogates
    in all rows, repeated ones included, whatever their case and punctuation; where candidates meet, the leftmost counts. A
    single word of a full name, in a text that has this name, gets the same word of its surrogate; if several full names of
    the text have it, that of the first. Very long texts take time in proportion, times the full names in them. An empty
    table gives an empty result. Texts without a candidate pass untouched and are not shuffled; the others are, once.
    """
    rows = candidates(docs)
    hits = rows.where("found is not null").select("uid", "doc_id", "between", "found")
    mentions = stage(mentions_of(hits), "mentions")
    entities = stage(mentions.where("kind is not null").groupBy("kind", "identity").agg(F.max("gender").alias("gender")), "entities")
    named = mentions.join(surrogates(entities, key), ["kind", "identity"], "left")
    new = by_kind(F.col("kind"), lambda k: k.render(F.col("value"), F.col("of"), F.col("surrogate")))
    named = named.select("uid", F.struct("at", "kind", F.length("value").alias("n"), F.coalesce(new, F.col("value")).alias("new")).alias("m"))
    per_row = named.groupBy("uid").agg(F.sort_array(F.collect_list("m")).alias("m"))
    whole = hits.select("uid", "doc_id", "between").join(per_row, "uid")
    text = F.array_join(F.zip_with("between", "m", lambda b, m: F.concat(b, F.coalesce(m["new"], F.lit("")))), "")
    at = starts(F.zip_with("m", F.slice("between", F.lit(1), F.size("m")), lambda m, b: F.struct(F.length(b).alias("b"), m["n"].alias("w"))))
    said = F.zip_with("m", at, lambda m, s: F.when(m["kind"].isNotNull(), F.concat_ws(":", m["kind"], s.cast("string"), (s + m["n"]).cast("string"))))
    spans = F.array_compact(said)
    changed = whole.select("doc_id", text.alias("text"), spans.alias("spans")).select("doc_id", "text", F.size("spans").cast("long").alias("n_entities"), F.array_join("spans", ",").alias("entities"))
    same = rows.where("found is null").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("entities"))
    return same.unionByName(changed)
