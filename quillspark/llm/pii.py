"""PII surrogates: each detected entity gets a keyed replacement of its own type, gender, script and format.

DataFrame functions only. Mentions are found by one pattern and taken apart (a given name
and a surname, the two sides of an address, the digits of a number). Each different part
gets a surrogate from a keyed hash, the same wherever it occurs, so mentions of one entity
stay together; surrogates that collide, with each other or with a part that the corpus
holds, are drawn again until all are distinct. Replacements are built in the format of
each mention and put in its place.
"""

from __future__ import annotations

import hashlib
import secrets
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, shuffle_partitions

#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Paul", "Hans", "Klaus", "Jürgen", "Pierre", "Jacques", "François", "Louis", "Carlos", "José", "Miguel", "Pablo", "Richard", "Charles", "Daniel", "Matthew", "Andrew", "George", "Stefan", "Wolfgang", "Henri", "Antoine", "Juan", "Diego", "Javier", "Giovanni", "Marco", "Ahmed", "Mohammed", "Omar", "Ali", "Raj", "Arjun", "Rahul", "Wei", "Jun", "Hiroshi", "Kenji"),
    ("latin", "f"): ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Emma", "Alice", "Ursula", "Greta", "Heidi", "Marie", "Sophie", "Camille", "Hélène", "María", "Carmen", "Lucía", "Pilar", "Barbara", "Jessica", "Karen", "Nancy", "Olivia", "Sophia", "Anna", "Laura", "Katrin", "Sabine", "Claire", "Isabelle", "Ana", "Elena", "Isabel", "Giulia", "Chiara", "Fatima", "Aisha", "Leila", "Priya", "Anita", "Sunita", "Mei", "Ling", "Yuki", "Sakura"),
    ("cyrillic", "m"): ("Иван", "Александр", "Сергей", "Дмитрий", "Николай", "Павел", "Михаил", "Владимир"),
    ("cyrillic", "f"): ("Анна", "Мария", "Ольга", "Елена", "Наталья", "Татьяна", "Ирина", "Светлана"),
    ("greek", "m"): ("Γιώργος", "Νίκος", "Δημήτρης", "Κώστας", "Γιάννης", "Παύλος"),
    ("greek", "f"): ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Ιωάννα"),
}
#: Forms of address, which stay as they are.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Господин", "Госпожа", "Κύριος", "Κυρία")
#: Syllables that surnames are made of, by script.
SYLLABLES = {
    "latin": ("ba", "ber", "cor", "dan", "del", "fen", "gar", "hol", "ken", "lan", "mar", "mon", "nor", "par", "ros", "san", "tor", "val", "ver", "win"),
    "cyrillic": ("ба", "бор", "вер", "гор", "дан", "зор", "кал", "лен", "мар", "нов", "пет", "рам", "сол", "тар", "фед", "шор"),
    "greek": ("βα", "γεν", "δαμ", "ζερ", "θαν", "καλ", "λαμ", "μαρ", "νικ", "παν", "ραλ", "σαρ", "ταν", "φιλ", "χρο", "ψαλ"),
}
_NAME = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_GIVEN = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n)))
_TITLE = "|".join(sorted(TITLES, key=lambda n: (-len(n), n)))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
_KEY_PREFIX = "AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abprs]-"
#: Kinds of mention in the order in which they are tried. Repeats of groups are bounded, or possessive, which takes no stack; an address has the lengths of the DNS.
KINDS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,126}+",
    "key": rf"(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![A-Za-z0-9])|(?:{_KEY_PREFIX})[A-Za-z0-9_-]{{16,255}}+",
    "ipv6": rf"(?:{_HEX}:){{7}}{_HEX}(?![0-9A-Fa-f:])|(?:(?:{_HEX}:){{2,6}}|[Ff][Ee]80:):(?:{_HEX}:){{0,5}}{_HEX}(?![0-9A-Fa-f:])",
    "secret": r"""(?i:password|passwd|token|secret|api[_-]?key)\s?[=:]\s?["']?[A-Za-z0-9_+/-]{8,}+["']?""",
    "person": rf"(?:(?:{_TITLE})\.?\s)?(?:{_GIVEN})\s{_NAME}(?!\p{{L}})|(?:{_TITLE})\.?\s{_NAME}(?!\p{{L}})",
    "ip": rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\d)",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "card": r"\d(?:[ -]?\d){12,18}(?!\d)",
}
PATTERN = r"(?<![\p{L}\p{N}])(?:" + "|".join(KINDS.values()) + ")"
#: Draws after which a surrogate may be longer than what it replaces, and equal to a part that the corpus holds.
STRICT_DRAWS = 4
#: Addresses of the private ranges that have surrogates of their own.
PRIVATE = {"10.": 256 * 256 * 254, "192.168.": 256 * 254}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _draw(seed: Column, n: int) -> Column:
    """A number below n from a keyed hash."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, 12), 16, 10).cast("long") % F.lit(n)


def _pick(seed: Column, values: tuple[str, ...] | list[str]) -> Column:
    return F.get(F.array(*map(F.lit, values)), _draw(seed, len(values)).cast("int"))


def kind_of(mention: Column) -> Column:
    out = F.lit("card")
    for kind, pattern in reversed(list(KINDS.items())[:-1]):
        out = F.when(mention.rlike(rf"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), F.lit("cyrillic")).when(name.rlike(r"^\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


_PERSON = rf"^((?:(?:{_TITLE})\.?\s)?)((?:(?:{_GIVEN})\s)?)({_NAME})$"
_SECRET = r"""^([A-Za-z_-]+\s?[=:]\s?["']?)(.*?)(["']?)$"""


def parts_of(mention: Column, kind: Column) -> Column:
    """array<struct<kind, value>>: what of a mention is replaced, in a form that does not depend on its format."""
    part = lambda k, v: F.struct((k if isinstance(k, Column) else F.lit(k)).alias("kind"), v.alias("value"))
    surname, given = F.regexp_extract(mention, _PERSON, 3), F.trim(F.regexp_extract(mention, _PERSON, 2))
    name = part(F.concat(F.lit("surname:"), _script(surname)), F.lower(surname))
    digits = _digits(mention)
    return (
        F.when(kind == "email", F.array(part("local", F.lower(F.substring_index(mention, "@", 1))), part("domain", F.lower(F.substring_index(mention, "@", -1)))))
        .when(kind == "person", F.when(given != "", F.array(name, part("given", given))).otherwise(F.array(name)))
        .when(kind == "secret", F.array(part("secret", F.regexp_extract(mention, _SECRET, 2))))
        .when(kind == "phone", F.array(part("phone", F.substring(digits, F.greatest(F.length(digits) - 9, F.lit(1)), F.lit(10)))))
        .when(kind == "iban", F.array(part("iban", F.replace(mention, F.lit(" "), F.lit("")))))
        .when(kind.isin("ip", "key"), F.array(part(kind, mention)))
        .when(kind == "ipv6", F.array(part(kind, F.lower(mention))))
        .otherwise(F.array(part(kind, digits)))
    )


def _reshaped(value: Column, seed: Column, kept: Column | int = 0) -> Column:
    """Each letter by a letter of its case, each digit by a digit; hexadecimal values stay so; the first `kept` characters stay."""
    hexa = value.rlike("^[0-9a-f:]+$") & value.rlike("[0-9]") & value.rlike("[a-f:]")

    def other(c: Column, i: Column) -> Column:
        s = F.concat(seed, F.lit(":"), (i + 1).cast("string"))
        return (
            F.when(i < kept, c)
            .when(hexa & (c != ":"), F.substring(F.sha2(s, 256), 1, 1))
            .when(c.rlike("[0-9]"), _draw(s, 10).cast("string"))
            .when(c.rlike("[a-z]"), F.char(_draw(s, 26) + 97))
            .when(c.rlike("[A-Z]"), F.char(_draw(s, 26) + 65))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), other), "")


def _mod97(text: Column) -> Column:
    """Of digits and capitals, A as 10 to Z as 35, read as one number."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _iban(value: Column, seed: Column) -> Column:
    """Another of the country; with valid check digits where those of the value are."""
    country, body = F.substring(value, 1, 2), lambda x: F.substring(x, F.lit(5), F.length(value))
    drawn = F.concat(country, F.substring(_reshaped(value, seed, 2), F.lit(3), F.length(value)))
    digits = F.lpad((98 - _mod97(F.concat(body(drawn), country, F.lit("00")))).cast("string"), 2, "0")
    return F.when(_mod97(F.concat(body(value), F.substring(value, 1, 4))) == 1, F.concat(country, digits, body(drawn))).otherwise(drawn)


def _luhn_sum(digits: Column) -> Column:
    """Of digits that a check digit is to follow."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when((n - i) % 2 == 0, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x)


def _check_digit(digits: Column) -> Column:
    return F.pmod(-_luhn_sum(digits), F.lit(10)).cast("string")


def surrogate_of(kind: Column, value: Column, draw: Column, key: str) -> Column:
    """The surrogate of a part at a draw: a function of the key, the kind and the value alone."""
    seed = F.concat_ws("|", F.lit(key), kind, value, draw.cast("string"))
    longer = F.when(draw >= STRICT_DRAWS, F.substring(F.sha2(F.concat(seed, F.lit("+")), 256), F.lit(1), (draw - STRICT_DRAWS + 3).cast("int"))).otherwise(F.lit(""))
    body = F.substring(value, F.lit(1), F.length(value) - 1)
    card = F.concat(F.substring(value, 1, 1), F.substring(_reshaped(body, seed), F.lit(2), F.length(value)))
    last = F.substring(value, -1, 1)
    card = F.concat(card, F.when(_check_digit(body) == last, _check_digit(card)).otherwise(_draw(F.concat(seed, F.lit("c")), 10).cast("string")))
    dotted = _reshaped(value, seed)
    phone = F.when(F.length(value) == 10, F.concat((_draw(F.concat(seed, F.lit("a")), 8) + 2).cast("string"), F.substring(dotted, 2, 2), (_draw(F.concat(seed, F.lit("b")), 8) + 2).cast("string"), F.substring(dotted, 5, 6))).otherwise(dotted)
    octet = lambda i, n, low: (_draw(F.concat(seed, F.lit(f"o{i}")), n) + low).cast("string")
    ip = (
        F.when(F.startswith(value, F.lit("10.")), F.concat_ws(".", F.lit("10"), octet(2, 256, 0), octet(3, 256, 0), octet(4, 254, 1)))
        .when(F.startswith(value, F.lit("192.168.")), F.concat_ws(".", F.lit("192.168"), octet(3, 256, 0), octet(4, 254, 1)))
        .otherwise(F.concat_ws(".", octet(1, 89, 101), octet(2, 256, 0), octet(3, 256, 0), octet(4, 254, 1)))
    )
    top = F.substring_index(value, ".", -1)
    domain = F.concat(_reshaped(F.substring(value, F.lit(1), F.length(value) - F.length(top) - 1), seed), longer, F.lit("."), top)

    def surname(script: str) -> Column:
        syllable = lambda i: _pick(F.concat(seed, F.lit("s"), i.cast("string")), SYLLABLES[script])
        more = F.when(draw >= STRICT_DRAWS, F.array_join(F.transform(F.sequence(F.lit(4), F.greatest(draw, F.lit(STRICT_DRAWS)).cast("int") - STRICT_DRAWS + 4), syllable), ""))
        return F.concat(*(syllable(F.lit(i)) for i in range(4)), F.coalesce(more, F.lit("")))

    given = F.lit(None).cast("string")
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).digest())
        for a, b in zip(order, order[1:] + order[:1], strict=True):
            given = F.when(value == F.lit(a), F.lit(b)).otherwise(given)
    return (
        F.when(kind == "local", F.concat(dotted, longer))
        .when(kind == "domain", domain)
        .when(kind == "secret", F.concat(dotted, longer))
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "ip", ip)
        .when(kind == "iban", _iban(value, seed))
        .when(kind == "key", _reshaped(value, seed, F.length(F.regexp_extract(value, f"^({_KEY_PREFIX})", 1))))
        .when(kind == "given", given)
        .when(kind == "surname:cyrillic", F.concat(surname("cyrillic"), F.when(value.rlike("[ая]$"), F.lit("ова")).otherwise(F.lit("ов"))))
        .when(kind == "surname:greek", F.concat(surname("greek"), F.when(F.endswith(value, F.lit("ς")), F.lit("ς")).otherwise(F.lit(""))))
        .when(F.startswith(kind, F.lit("surname")), surname("latin"))
        .otherwise(dotted)
    )


def _permuted(value: Column, key: str, prefix: str) -> Column:
    """An address of a private range by another of it: a keyed permutation without fixed points.

    The ends .0 and .255 are permuted among themselves. A Feistel network over the two
    sides of the address, a step of its right side, and the network backwards.
    """
    octets = F.split(value, r"\.")
    at = lambda i: F.get(octets, F.lit(i)).cast("long")
    left, n = (at(1) * 256 + at(2), 65536) if prefix == "10." else (at(2), 256)
    edge = at(3).isin(0, 255)
    right, m = F.when(edge, (at(3) / 255).cast("long")).otherwise(at(3) - 1), F.when(edge, F.lit(2).cast("long")).otherwise(F.lit(254).cast("long"))
    seed = F.concat(F.lit(f"{key}|{prefix}|"), m.cast("string"))

    def network(sides: Column, rounds: range, sign: int) -> Column:
        def one(x: Column, k: Column) -> Column:
            of = lambda side: F.concat_ws("|", seed, k.cast("string"), side.cast("string"))
            on_left = F.pmod(x["left"] + sign * _draw(of(x["right"]), n), F.lit(n).cast("long"))
            on_right = F.pmod(x["right"] + sign * _draw(of(x["left"]), m), m)
            return F.struct(F.when(k % 2 == 0, on_left).otherwise(x["left"]).alias("left"), F.when(k % 2 == 1, on_right).otherwise(x["right"]).alias("right"))

        return F.aggregate(F.array(*map(F.lit, rounds)), sides, one)

    there = network(F.struct(left.alias("left"), right.alias("right")), range(6), 1)
    step = F.struct(there["left"].alias("left"), F.pmod(there["right"] + 1 + _draw(F.concat(seed, F.lit("step")), m - 1), m).alias("right"))
    back = network(step, range(5, -1, -1), -1)
    head = (F.lit("10"), F.floor(back["left"] / 256).cast("string"), (back["left"] % 256).cast("string")) if prefix == "10." else (F.lit("192.168"), back["left"].cast("string"))
    return F.concat_ws(".", *head, F.when(edge, back["right"] * 255).otherwise(back["right"] + 1).cast("string"))


def distinct_surrogates(parts: DataFrame, key: str, max_draws: int = 64) -> DataFrame:
    """(kind, value, surrogate) of different parts (kind, value): no two of a kind share a surrogate.

    Of parts whose draws collide the least value keeps it, the others draw again; in the
    first draws no surrogate equals a part of its kind in the corpus either. Given names
    are permuted within their gender and script, which cannot collide, and so are addresses
    within a private range of which the corpus holds over a quarter: there surrogates are
    addresses that the corpus may hold. Surnames grow with the draw. Another kind whose form
    has no room for that many parts ends in an error.
    """
    given = parts.where("kind = 'given'").select("kind", "value", surrogate_of(F.col("kind"), F.col("value"), F.lit(0), key).alias("surrogate"))
    waiting, done = parts.where("kind <> 'given'"), None
    within = lambda prefix: (F.col("kind") == "ip") & F.startswith(F.col("value"), F.lit(prefix))
    held = parts.agg(*(F.count_if(within(prefix)).alias(str(k)) for k, prefix in enumerate(PRIVATE))).first()
    for (prefix, room), n in zip(PRIVATE.items(), held, strict=True):
        if 4 * n > room:
            given = given.union(parts.where(within(prefix)).select("kind", "value", _permuted(F.col("value"), key, prefix).alias("surrogate")))
            waiting = waiting.where(~within(prefix))
    waiting = waiting.repartition(shuffle_partitions(parts.sparkSession), "kind", "value")  # a draw costs much more than its row
    for draw in range(max_draws):
        drawn = waiting.withColumn("surrogate", surrogate_of(F.col("kind"), F.col("value"), F.lit(draw), key))
        owners = drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
        if draw < STRICT_DRAWS:
            owners = owners.join(parts.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        else:
            owners = owners.where("surrogate <> value")
        if done is not None:
            owners = owners.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        marked = materialise(waiting.join(owners, ["kind", "value"], "left").select("kind", "value", "surrogate"), "surrogates")
        won = marked.where("surrogate is not null")
        done = won if done is None else done.union(won)
        waiting = marked.where("surrogate is null").select("kind", "value")
        if waiting.isEmpty():
            return done.union(given)
    raise ValueError(f"no distinct surrogates after {max_draws} draws")


def _like(surrogate: Column, mention: Column) -> Column:
    """Digits of a surrogate, from the right, in the place of those of a mention."""
    n, m = F.length(_digits(mention)), F.length(surrogate)

    def place(i: Column) -> Column:
        c, before = F.substring(mention, i, F.lit(1)), F.length(_digits(F.substring(mention, F.lit(1), i)))
        at = before - (n - m)
        return F.when(c.rlike("[0-9]") & (at >= 1), F.substring(surrogate, at, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), place), "")


def _spaced(surrogate: Column, mention: Column) -> Column:
    """The characters of a surrogate with the blanks of a mention."""

    def place(i: Column) -> Column:
        at = F.length(F.replace(F.substring(mention, F.lit(1), i), F.lit(" "), F.lit("")))
        return F.when(F.substring(mention, i, F.lit(1)) == " ", F.lit(" ")).otherwise(F.substring(surrogate, at, F.lit(1)))

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(mention)), place), "")


def _replacement(mention: Column, kind: Column, first: Column, second: Column) -> Column:
    surname = F.when(F.regexp_extract(mention, _PERSON, 3).rlike("-"), F.concat(F.initcap(F.substring(first, 1, 5)), F.lit("-"), F.initcap(F.substring(first, F.lit(6), F.length(first))))).otherwise(F.initcap(first))
    given = F.when(second.isNotNull(), F.concat(second, F.lit(" "))).otherwise(F.lit(""))
    return (
        F.when((kind == "email") & (mention == F.upper(mention)), F.upper(F.concat(first, F.lit("@"), second)))
        .when(kind == "email", F.concat(first, F.lit("@"), second))
        .when(kind == "person", F.concat(F.regexp_extract(mention, _PERSON, 1), given, surname))
        .when(kind == "secret", F.concat(F.regexp_extract(mention, _SECRET, 1), first, F.regexp_extract(mention, _SECRET, 3)))
        .when(kind.isin("ip", "key"), first)
        .when(kind == "ipv6", F.when(mention == F.lower(mention), first).otherwise(F.upper(first)))
        .when(kind == "iban", _spaced(first, mention))
        .otherwise(_like(first, mention))
    )


def replacements(mentions: DataFrame, key: str) -> DataFrame:
    """(mention, kind, replacement) of different mentions."""
    # few and small, but each costs much: kept apart, not gathered in one partition
    of = mentions.repartition(shuffle_partitions(mentions.sparkSession), "mention").withColumn("kind", kind_of(F.col("mention")))
    apart = materialise(of.select("mention", "kind", F.posexplode(parts_of(F.col("mention"), F.col("kind")))).select("mention", F.col("kind").alias("type"), "pos", "col.kind", "col.value"), "parts")
    surrogates = distinct_surrogates(apart.select("kind", "value").distinct(), key)
    side = lambda k: F.max(F.when(F.col("pos") == k, F.col("surrogate")))
    both = apart.join(surrogates, ["kind", "value"]).groupBy("mention", "type").agg(side(0).alias("first"), side(1).alias("second"))
    return both.select("mention", F.col("type").alias("kind"), _replacement(F.col("mention"), F.col("type"), F.col("first"), F.col("second")).alias("replacement"))


def surrogate_texts(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = 32_000_000) -> DataFrame:
    """(doc_id, text, n_entities): every row with the entities of its text replaced.

    Whoever holds `key` can draw the same surrogates, so it is a secret. A null text stays
    null, an empty one empty; repeated rows stay and read alike; other columns are not read.
    People are found by a title or a listed given name before a capitalised word, all else
    by its form; of an address with more labels than the DNS has only those are replaced. The replacements of a text are found by its SHA-256, so copies
    share them. They are broadcast only below `broadcast_bytes`; beyond, texts and
    replacements meet in a shuffle.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.where("text is not null").select(F.sha2("text", 256).alias("sha"), F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("pos", "mention"))
    found = materialise(found.groupBy("sha", "pos").agg(F.max("mention").alias("mention")), "mentions")
    known = materialise(replacements(found.select("mention").distinct(), key), "replacements")
    lists = found.join(known.select("mention", "replacement"), "mention").groupBy("sha").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "replacement"))), lambda x: x["replacement"]).alias("new"))
    lists = materialise(lists, "lists")
    size = lists.agg(F.sum(F.lit(100) + F.length(F.array_join("new", "")) + 24 * F.size("new"))).first()[0] or 0
    joined = rows.withColumn("sha", F.sha2("text", 256)).join(F.broadcast(lists) if size <= broadcast_bytes else lists, "sha", "left")
    between = F.split("text", PATTERN, -1)
    text = F.when(F.col("new").isNull(), F.col("text")).otherwise(F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get("new", i), F.lit("")))), ""))
    return joined.select("doc_id", text.alias("text"), F.coalesce(F.size("new"), F.lit(0)).cast("long").alias("n_entities"))


@lru_cache(maxsize=1)
def _fresh_key() -> str:
    return secrets.token_hex(16)


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of what is private in it.

    The key is the session's `spark.quillspark.pii.key`; where none is set, a fresh one that
    no other run of the driver shares.
    """
    key = spark.conf.get("spark.quillspark.pii.key", None) or _fresh_key()
    return surrogate_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), key)
