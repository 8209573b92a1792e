"""Surrogates for personal data and secrets, with DataFrame functions only.

A detected entity is replaced by one of its own kind and form. Letters and digits are
shifted within their class (digits, lower case, upper case, hexadecimal digits, octets, the
vowels or consonants of a script) by a keyed network over both halves of the entity: equal
entities get equal surrogates, different ones of a form different surrogates. Given names
are exchanged within the list of their gender and script. A check over all entities of the
corpus finds surrogates that equal another surrogate or another real entity and gives
those the next key until none is left.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import written

# Given names by gender and script.
GIVEN = [
    "Alice Anna Claire Emma Helen Julia Laura Lucy Maria Marta Sarah Sofia".split(),
    "Carlos Daniel David James John Louis Martin Michael Paul Peter Robert Thomas".split(),
    "Анна Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    "Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей".split(),
]
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
VOWELS = ["aeiou", "AEIOU", "аеиоуыэюя", "АЕИОУЭЮЯ"]
CONSONANTS = [
    "bcdfghjklmnpqrstvwxyz",
    "BCDFGHJKLMNPQRSTVWXYZ",
    "бвгджзклмнпрстфхцчш",
    "БВГДЖЗКЛМНПРСТФХЦЧШ",
]
OCTETS = "".join(chr(0x4E00 + i) for i in range(256))

_NAMES = "|".join(n for names in GIVEN for n in names)
_INITIALS = "".join(sorted({n[0] for names in GIVEN for n in names} | set("MDP")))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: kind, pattern; at one place the first that matches wins. Values of any length match:
#: their quantifiers are possessive, the others bounded and starts held to the edges of
#: words, so that no text makes the search backtrack far. A domain has at most 127 labels
#: of 63 characters. A look at the first character comes first, because it rules most places out.
PATTERNS = [
    (
        "email",
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,125}"
        r"\.[A-Za-z]{2,63}(?![A-Za-z0-9])",
    ),
    ("key", r"(?=A)(?<![A-Za-z0-9])A(?:KIA|SIA)[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("password", r"(?=[Pp])(?i:password|passwd|pwd)[ ]?[=:][ ]?\"?[^\s\"']{6,}+"),
    ("token", r"(?=[TtSsAa])(?i:token|secret|api_key)[ ]?[=:][ ]?\"[A-Za-z0-9_./+=-]{12,}+\""),
    ("ip", rf"(?=[0-9])(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])"),
    (
        "phone",
        r"(?=\+)(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
        r"|(?=\()(?<![0-9])\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}(?![0-9])",
    ),
    ("ssn", r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    (
        "card",
        r"(?=[3-6])(?<![0-9])(?:[3-6][0-9]{12,18}|[3-6][0-9]{3}(?:[ -][0-9]{4}){3})(?![0-9])",
    ),
    (
        "person",
        rf"(?=[{_INITIALS}])(?<!\p{{L}})(?:(?:Mr|Mrs|Ms|Dr|Prof)\.? )?(?:{_NAMES}) \p{{Lu}}\p{{Ll}}++(?!\p{{L}})",
    ),
]
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
HALF_ROUNDS = 6


def _kind(m: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS:
        test = m.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def _classes(kind: Column) -> list[Column]:
    """Alphabets of a kind; a character is shifted in the first that has it."""
    rest = [DIGITS, LOWER, UPPER]
    of = {
        "ip": [OCTETS],
        "person": [*VOWELS, *CONSONANTS],
        "token": ["0123456789abcdef", "ghijklmnopqrstuvwxyz", UPPER],
        "password": ["0123456789abcdef", "ghijklmnopqrstuvwxyz", UPPER],
    }
    out = []
    for i in range(max(map(len, of.values()))):
        pick = None
        for k, alphabets in of.items():
            a = alphabets[i] if i < len(alphabets) else ""
            pick = F.when(kind == k, a) if pick is None else pick.when(kind == k, a)
        out.append(pick.otherwise(rest[i] if i < len(rest) else ""))
    return out


N_CLASSES = 8


def _opened(value: Column, kind: Column) -> tuple[Column, Column, Column]:
    """What stays in front, what is shifted, what stays behind."""
    head = {
        "email": "",
        "key": r"^(....)",
        "password": r"^([^=:]*[=:] ?\"?)",
        "token": r"^([^=:]*[=:] ?\")",
        "phone": r"^(\+[0-9]{1,3}[ .-]?|)",
        "card": r"^(.)",
        "person": r"^(.* )",
    }
    tail = {"email": r"(\.[A-Za-z]+)$", "token": r"(\")$", "card": r"(.)$"}
    front, back = F.lit(""), F.lit("")
    for k, p in head.items():
        if p:
            front = F.when(kind == k, F.regexp_extract(value, p, 1)).otherwise(front)
    for k, p in tail.items():
        back = F.when(kind == k, F.regexp_extract(value, p, 1)).otherwise(back)
    inner = F.substring(
        value, F.length(front) + 1, F.length(value) - F.length(front) - F.length(back)
    )
    octets = F.array_join(
        F.transform(
            F.split(value, r"\."), lambda o: F.substring(F.lit(OCTETS), o.cast("int") + 1, F.lit(1))
        ),
        "",
    )
    return front, F.when(kind == "ip", octets).otherwise(inner), back


def _given(front: Column, key: str) -> Column:
    """The front of a person (title and given name) with the name exchanged in its list."""
    name = F.regexp_extract(front, r"(\p{L}+) $", 1)
    title = F.regexp_extract(front, r"^(.*?)\p{L}+ $", 1)
    out = front
    for names in GIVEN:
        digest = hashlib.sha256(f"{key}|{names[0]}".encode()).digest()
        shift = 1 + int.from_bytes(digest[:4], "big") % (len(names) - 1)
        turned = F.array(*[F.lit(names[(i + shift) % len(names)]) for i in range(len(names))])
        at = F.array_position(F.array(*[F.lit(x) for x in names]), name)
        got = F.concat(title, F.try_element_at(turned, at.cast("int")), F.lit(" "))
        out = F.when(at > 0, got).otherwise(out)
    return out


def _luhn(number: Column) -> Column:
    digits = F.reverse(F.regexp_replace(number, "[^0-9]", ""))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10


def _shifted(text: Column, digest: Column, state: Column) -> Column:
    def shift(c: Column, i: Column) -> Column:
        by = F.conv(F.substring(digest, 1 + 2 * (i % 32), F.lit(2)), 16, 10).cast("int")
        out = c
        for j in reversed(range(N_CLASSES)):
            a = state[f"c{j}"]
            at = F.instr(a, c)
            turned = F.substring(a, F.pmod(at - 1 + by, F.length(a)) + 1, F.lit(1))
            out = F.when((F.length(a) > 0) & (at > 0), turned).otherwise(out)
        return out

    moved = F.array_join(F.transform(F.split(text, ""), shift), "")
    return F.when(F.length(text) == 0, text).otherwise(moved)


def surrogates(entities: Column, attempts: Column, key: str) -> Column:
    """Array of surrogates for an array of entity strings; `attempts` numbers the keys."""
    keep = ["kind", "front", "back", "whole", "attempt", *[f"c{j}" for j in range(N_CLASSES)]]

    def named(s: Column, **new: Column) -> Column:
        old = [s[n].alias(n) for n in [*keep, "x", "y"] if n not in new]
        return F.struct(*old, *[c.alias(n) for n, c in new.items()])

    typed = F.transform(
        F.arrays_zip(entities.alias("v"), attempts.alias("t")),
        lambda z: F.struct(z["v"].alias("v"), z["t"].alias("t"), _kind(z["v"]).alias("kind")),
    )

    def opened(z: Column) -> Column:
        front, inner, back = _opened(z["v"], z["kind"])
        return F.struct(
            z["kind"].alias("kind"),
            front.alias("front"),
            back.alias("back"),
            z["v"].alias("whole"),
            z["t"].alias("attempt"),
            inner.alias("inner"),
            *[c.alias(f"c{j}") for j, c in enumerate(_classes(z["kind"]))],
        )

    def halved(z: Column) -> Column:
        half = F.floor(F.length(z["inner"]) / 2).cast("int")
        x = F.substring(z["inner"], F.lit(1), half)
        y = F.substring(z["inner"], half + 1, F.length(z["inner"]))
        return F.struct(*[z[n].alias(n) for n in keep], x.alias("x"), y.alias("y"))

    state = F.transform(F.transform(typed, opened), halved)
    def half_round(state: Column, r: int, moving: str, fixed: str) -> Column:
        def digested(s: Column) -> Column:
            salt = F.concat_ws("|", F.lit(key), F.lit(str(r)), s["kind"], s["attempt"].cast("string"))
            return F.struct(s.alias("s"), F.sha2(F.concat(salt, F.lit("|"), s[fixed]), 256).alias("h"))

        def turned(p: Column) -> Column:
            return named(p["s"], **{moving: _shifted(p["s"][moving], p["h"], p["s"])})

        return F.transform(F.transform(state, digested), turned)

    for r in range(HALF_ROUNDS):
        state = half_round(state, r, *(("x", "y") if r % 2 == 0 else ("y", "x")))

    def closed(s: Column) -> Column:
        inner = F.concat(s["x"], s["y"])
        octets = F.array_join(
            F.transform(
                F.split(inner, ""),
                lambda c: (F.instr(F.lit(OCTETS), c) - 1).cast("string"),
            ),
            ".",
        )
        card = F.concat(
            s["front"],
            inner,
            F.pmod(_luhn(s["whole"]) - _luhn(F.concat(s["front"], inner, F.lit("0"))), F.lit(10)).cast(
                "string"
            ),
        )
        person = F.concat(_given(s["front"], key), inner)
        plain = F.concat(s["front"], inner, s["back"])
        return (
            F.when(s["kind"] == "ip", octets)
            .when(s["kind"] == "card", card)
            .when(s["kind"] == "person", person)
            .otherwise(plain)
        )

    return F.transform(state, closed)


#: what every match of a kind other than `person` has in it
SIGNS = ("passw", "pwd", "token", "secret", "api_key", "akia", "asia")


def may_hold_entities(text: Column) -> Column:
    """False only where no pattern can match: most texts are settled by these short tests."""
    low = F.lower(text)
    out = F.contains(text, F.lit("@")) | text.rlike("[0-9]")
    for sign in SIGNS:
        out = out | F.contains(low, F.lit(sign))
    return out | text.rlike(dict(PATTERNS)["person"])


def found_entities(text: Column) -> Column:
    """Matches in order; none for a null text."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(may_hold_entities(text), found).otherwise(F.array().cast("array<string>"))


def next_keys(entities: DataFrame, key: str) -> DataFrame:
    """value, attempt (over 0) of the entities whose first surrogate is taken.

    `entities`: distinct values. Taken means: equal to the surrogate of a smaller value, or
    to an entity of the corpus, itself included. Those get the next key, again and again
    until nothing is taken; the table of those is empty or very small.
    """
    given = entities.withColumn("attempt", F.lit(0))
    while True:
        made = written(
            given.withColumn(
                "s", surrogates(F.array("value"), F.array("attempt"), key)[0]
            )
        )
        real = made.select(F.col("value").alias("s"), F.lit(True).alias("real"))
        first = made.groupBy("s").agg(F.min(F.struct("attempt", "value")).alias("first"))
        judged = made.join(first, "s").join(real, "s", "left")
        # an entity without a letter or digit that could move stays what it is
        taken = (F.col("real").isNotNull() & (F.col("attempt") < 64)) | (
            F.struct("attempt", "value") != F.col("first")
        )
        if judged.where(taken).isEmpty():
            return made.where("attempt > 0").select("value", "attempt")
        given = written(
            judged.select(
                "value", (F.col("attempt") + F.when(taken, 1).otherwise(0)).alias("attempt")
            )
        )


def _rewritten(docs: DataFrame, key: str, doc_key: str, text: str) -> tuple[DataFrame, Column]:
    """The documents with their entities in `__m`, and the expression of the new text."""
    old = F.col(f"`{text}`").cast("string")
    values = docs.select(F.explode(found_entities(old)).alias("value")).distinct()
    again = next_keys(written(values), key)
    told = docs.withColumn("__m", found_entities(old))
    attempts = F.transform("__m", lambda v: F.lit(0))
    if not again.isEmpty():
        # maps of the few such entities, per text that has one
        told = told.withColumn("__row", F.xxhash64(F.col(f"`{doc_key}`"), old))
        few = (
            told.select("__row", F.explode(F.array_distinct("__m")).alias("value"))
            .join(again, "value")
            .groupBy("__row")
            .agg(F.map_from_entries(F.collect_set(F.struct("value", "attempt"))).alias("__more"))
        )
        told = told.join(few, "__row", "left")
        attempts = F.transform("__m", lambda v: F.coalesce(F.try_element_at("__more", v), F.lit(0)))
    new = surrogates(F.col("__m"), attempts, key)
    joined = F.array_join(
        F.zip_with(
            F.split(old, PATTERN, -1), new, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))
        ),
        "",
    )
    return told, F.when(F.size("__m") > 0, joined).otherwise(old)


def replace_entities(
    docs: DataFrame, key: str, doc_key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds (sorted, distinct).

    One row per document row. `key` is the secret of the mapping: with it an entity gets the
    same surrogate in every document and run. Email addresses keep their dots and top
    domain, phone numbers their country code and punctuation, cards their network and the
    validity of their check digit, addresses of machines stay addresses, names keep title,
    gender and script. Null text: null text and no entities. Empty and very long texts are
    ordinary; other columns are ignored; repeated rows give a row each.
    """
    rows = docs.select(
        F.col(f"`{doc_key}`").cast("long").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    told, new = _rewritten(rows, key, "doc_id", "text")
    return told.select(
        "doc_id",
        new.alias("text"),
        F.greatest(F.coalesce(F.size("__m"), F.lit(0)), F.lit(0)).cast("long").alias("n_entities"),
        F.coalesce(
            F.array_sort(F.array_distinct(F.transform("__m", _kind))),
            F.array().cast("array<string>"),
        ).alias("kinds"),
    )


def rewrite_documents(
    docs: DataFrame, key: str, doc_key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents with all their columns and the text of `replace_entities`.

    Column names that begin with two underscores are taken.
    """
    columns = docs.columns
    told, new = _rewritten(docs, key, doc_key, text)
    return told.withColumn(text, new).select(*[F.col(f"`{c}`") for c in columns])
