"""Personal data replaced by keyed surrogates of the same kind and format; DataFrame functions only.

Detected are e-mail addresses, phone numbers, IPv4 and IPv6 addresses, payment cards (Luhn), US social security
numbers, IBANs (mod 97), and names after a form of address in Latin or Cyrillic script. A mention has one or two
entities: a name its given and its family name, an address itself and its domain. An entity's canonical form
(lower-case address, digits of a number, a name part) gets its surrogate from SHA-256 over a secret key, the
kind, the canonical form and an attempt number. Letters stay letters, digits stay digits, cards and IBANs get new check
digits, names come from lists of the same script and gender. So the same entity has the same surrogate in all
documents, whatever its punctuation or case: "Mr John Smith", "Mr Smith" and "Mrs Smith" share a family name, two
addresses of one domain share the domain. In a document that gives a name with a form of address, the same full
or family name without one is replaced too.

Collision checks: the distinct entities of all documents are a table. Surrogates that two entities share, or
that are real entities themselves, are drawn again with the next attempt number, all but the first holder's,
until none is left. Names and addresses grow with the attempts, so that there are enough for any number of them;
a number keeps its digits, so a corpus with nearly all numbers of a form ends in an error. Initials stay.

Only documents with entities are shuffled, and those only as a fingerprint with their entities; an entity that a
third of the documents mention is a key of the entity table once, and its mentions are joined with Spark's
skew handling.

Defined results: null texts stay null; documents without entities stay as they are; repeated documents are
replaced alike; an empty table gives no rows. All columns stay; n_chars, where there is one, follows the new text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import fresh, pick, stored

ATTEMPTS = 64

#: Forms of address by script and gender, and names to draw from.
TITLES = {
    ("latin", "m"): "Mr|Herr|Monsieur|Señor|Sr|Sir",
    ("latin", "f"): "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Srta",
    ("latin", "n"): "Dr|Doctor|Prof|Professor",
    ("cyrillic", "m"): "Господин|господин|г-н",
    ("cyrillic", "f"): "Госпожа|госпожа|г-жа",
    ("cyrillic", "n"): "Доктор|доктор|Профессор|профессор",
}
NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Louis Marco Nils Oscar Pablo Quentin Robert Simon Tomas Ulrich Victor Walter Xavier Yann Anton".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Ines Julia Karin Laura Maria Nora Olivia Paula Renata Sara Teresa Ursula Vera Wanda Yvonne Zoe Alice Elisa".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Лев Максим Никита Олег Павел Роман Сергей".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья".split(),
}
for _script in ("latin", "cyrillic"):
    NAMES[_script, "n"] = NAMES[_script, "m"] + NAMES[_script, "f"]
PARTS = {
    "latin": ("bar ben cal dar fel gor hal kel lan mor nor pel rin sol tam ver".split(), "berg dal feld gren holm land mann nes rup sen son stad ton vik wald wick".split()),
    "cyrillic": ("бар вел гор дор зор кал лев мор нов пол рад сол тар фед хол яр".split(), "анко евич енко ец ин ко ский ов ук чук ян ых евский инский анский овец".split()),
}

#: Joint pattern; all of its entities are found by one scan, left to right.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
HEX4 = "[0-9A-Fa-f]{1,4}"
IPV6 = rf"(?<![\w:.])(?:(?:{HEX4}:){{7}}{HEX4}|(?:{HEX4}:){{1,6}}(?::{HEX4}){{1,6}})(?![\w:])"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])(?:\d[ -]?){12,18}\d(?![\d-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"
_TITLE = "|".join(t for t in TITLES.values())
#: A name, with the apostrophe of O'Neil but not that of a genitive.
WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{L}+)*"
INITIALS = r"(?:\p{Lu}\. ?)*"
NAME = rf"\b(?:{_TITLE})\.? {INITIALS}{WORD}(?: {INITIALS}{WORD})?"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, IPV6, SSN, PHONE, CARD, IBAN, NAME))


def _byte(digest: Column, i: Column) -> Column:
    """The i-th of 64 bytes (two digests) as a number."""
    return F.conv(F.substring(digest, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _digest(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    base = F.concat_ws("\u0001", F.lit(key), kind, canonical, attempt.cast("string"))
    return F.concat(F.sha2(base, 256), F.sha2(F.concat(base, F.lit("\u0001more")), 256))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _replaced(text: Column, digest: Column) -> Column:
    """Letters a-z and digits replaced one by one; other signs stay."""
    def one(c: Column, i: Column) -> Column:
        b = _byte(digest, i) + i * 7
        return F.when(c.rlike("[0-9]"), ((b % 10)).cast("string")).when(c.rlike("[a-z]"), F.char(b % 26 + 97)).when(c.rlike("[A-Z]"), F.char(b % 26 + 65)).otherwise(c)

    return F.concat_ws("", F.transform(_letters(text), one))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of all digits, the last one counted as the check digit."""
    values = F.transform(F.reverse(_letters(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _mod97(iban: Column) -> Column:
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    steps = F.transform(_letters(moved), lambda c: F.when(c.rlike("[0-9]"), F.struct(F.lit(10).alias("m"), c.cast("int").alias("v"))).otherwise(F.struct(F.lit(100).alias("m"), (F.ascii(c) - 55).alias("v"))))
    return F.aggregate(steps, F.lit(0), lambda a, s: (a * s["m"] + s["v"]) % 97)


def kind_of(mention: Column) -> Column:
    """The kind of a mention of the joint pattern, or null if check digits fail."""
    digits, plain = F.regexp_replace(mention, r"\D", ""), F.regexp_replace(mention, "[ -]", "")
    kind = F.when(mention.contains("@"), "email").when(mention.rlike(rf"^(?:{IPV4})$"), "ipv4").when(mention.rlike(rf"^(?:{IPV6})$"), "ipv6").when(mention.rlike(rf"^(?:{SSN})$"), "ssn")
    kind = kind.when(mention.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$"), F.when(_mod97(plain) == 1, "iban"))
    kind = kind.when(mention.rlike(rf"^(?:{PHONE})$"), "phone")
    kind = kind.when(mention.rlike(r"^[\d -]+$"), F.when(_luhn_sum(digits) % 10 == 0, "card"))
    for (script, gender), titles in TITLES.items():
        kind = kind.when(mention.rlike(rf"^(?:{titles})\.? "), f"name_{script}_{gender}")
    return kind


def entity_in(mention: Column) -> Column:
    """The mention; of one that fails its check digits the longest prefix of whole groups that passes, or null."""
    def passes(p: Column) -> Column:
        plain = F.regexp_replace(p, "[ -]", "")
        iban = F.when(plain.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$"), _mod97(plain) == 1)
        return F.coalesce(iban.when(plain.rlike(r"^\d{13,19}$"), _luhn_sum(plain) % 10 == 0), F.lit(False))

    ends = F.sequence(F.greatest(F.length(mention) - 1, F.lit(12)), F.lit(12), F.lit(-1))
    ends = F.filter(ends, lambda e: F.rlike(F.substr(mention, e + 1, F.lit(1)), F.lit("[ -]")))
    prefix = F.try_element_at(F.filter(F.transform(ends, lambda e: F.substr(mention, F.lit(1), e)), passes), F.lit(1))
    return F.when(kind_of(mention).isNotNull(), mention).otherwise(prefix)


def name_words(mention: Column) -> Column:
    """The one or two words of a name, without form of address and initials."""
    return F.regexp_extract_all(F.regexp_replace(mention, r"^\S+ ", ""), F.lit(WORD), F.lit(0))


def entities_of(mention: Column, kind: Column) -> Column:
    """The entities of a mention, in order: structs of kind and canonical form, which mentions of the same entity share."""
    entity = lambda k, c: F.struct(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), c.alias("canonical"))
    words, address = name_words(mention), F.lower(mention)
    given, family = F.regexp_replace(kind, "^name", "given"), F.regexp_replace(kind, "^name(.*)_.$", "family$1")
    name = F.when(F.size(words) > 1, F.array(entity(given, words[0]), entity(family, words[1]))).otherwise(F.array(entity(family, words[0])))
    plain = F.when(kind == "ipv4", mention).when(kind == "ipv6", address).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
    return (
        F.when(kind == "email", F.array(entity("email", address), entity("domain", F.substring_index(address, "@", -1))))
        .when(kind.startswith("name"), name)
        .otherwise(F.array(entity(kind, plain.otherwise(F.regexp_replace(mention, r"\D", "")))))
    )


def _surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """Canonical form of the replacement."""
    d = _digest(kind, canonical, attempt, key)
    b = lambda i: _byte(d, F.lit(i))
    grown = F.translate(F.left(F.sha2(F.concat(d, F.lit("grown")), 256), F.floor(attempt / 4).cast("int")), "0123456789", "ghijklmnop")
    local = F.concat(_replaced(F.substring_index(canonical, "@", 1), d), grown)
    domain = F.concat(_replaced(F.regexp_extract(canonical, r"^(.*)\.", 1), d), grown, F.regexp_extract(canonical, r"(\.[^.]*)$", 1))
    hextets = F.concat_ws("", F.transform(_letters(canonical), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex(_byte(d, i) % 16)))))
    octets = F.concat_ws(".", *[(b(i) % 223 + 1).cast("string") for i in range(4)])
    card_body = F.concat(F.substring(canonical, 1, 1), _replaced(F.substr(canonical, F.lit(2), F.length(canonical) - 2), d))
    card = F.concat(card_body, ((10 - _luhn_sum(F.concat(card_body, F.lit("0"))) % 10) % 10).cast("string"))
    iban_body = _replaced(F.substr(canonical, F.lit(5)), d)
    iban = F.concat(F.substring(canonical, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(canonical, 1, 2), F.lit("00"), iban_body))).cast("string"), 2, "0"), iban_body)
    # the country code, and a first digit other than 0, stay with the number's form
    phone = F.concat(F.substring(canonical, 1, 1), _replaced(F.substr(canonical, F.lit(2)), d))
    ssn = F.concat((b(40) % 8 + 1).cast("string"), _replaced(F.substr(canonical, F.lit(2)), d))
    out = F.when(kind == "email", local).when(kind == "domain", domain).when(kind == "ipv6", hextets).when(kind == "ipv4", octets).when(kind == "card", card).when(kind == "iban", iban).when(kind == "phone", phone).when(kind == "ssn", ssn)
    syllables = lambda head, n: F.concat_ws("", F.transform(F.slice(F.sequence(F.lit(0), F.lit(ATTEMPTS)), 1, n.cast("int")), lambda i: F.get(head, _byte(d, i + 5) % 16)))
    for script, parts in PARTS.items():
        head, tail = (F.array(*map(F.lit, p)) for p in parts)
        family = F.initcap(F.concat(head[b(1) % 16], head[b(4) % 16], syllables(head, F.floor(attempt / 3)), tail[b(2) % 16]))
        out = out.when(kind == f"family_{script}", family)
        for gender in "mfn":
            names = NAMES[script, gender]
            given = F.array(*map(F.lit, names))[b(3) % len(names)]
            out = out.when(kind == f"given_{script}_{gender}", F.concat(given, syllables(head, F.floor(attempt / 2))))
    return out


def _rendered(mention: Column, kind: Column, surrogates: Column) -> Column:
    """The surrogates of a mention's entities in the mention's own form: its signs and its capitals."""
    marks, joined = _letters(mention), F.array_join(surrogates, "@")
    new = _letters(F.when(kind == "email", joined).otherwise(surrogates[0]))
    # signs that the canonical form leaves out are kept where they are
    kept = F.when(kind == "iban", "[^ ]").when(kind.isin("email", "ipv6"), ".").otherwise("[0-9]")
    place = F.transform(marks, lambda c, i: F.size(F.filter(F.slice(marks, 1, i + 1), lambda x: F.rlike(x, kept))))
    upper = kind.isin("email", "ipv6")
    by_place = F.zip_with(marks, place, lambda c, p: F.when(~F.rlike(c, kept), c).when(c.rlike("[A-Z]") & upper, F.upper(F.try_element_at(new, p))).otherwise(F.try_element_at(new, p)))
    # an address that has grown goes on after the mention's end
    rest = F.when(kind == "email", F.array_join(F.slice(new, F.size(marks) + 1, F.greatest(F.size(new) - F.size(marks), F.lit(0))), "")).otherwise("")
    title = F.regexp_extract(mention, rf"^(\S+ {INITIALS})", 1)
    middle = F.regexp_extract(mention, rf"^\S+ {INITIALS}{WORD} ({INITIALS})", 1)
    name = F.concat(title, surrogates[0], F.when(F.size(surrogates) > 1, F.concat(F.lit(" "), middle, F.get(surrogates, F.lit(1)))).otherwise(""))
    return F.when(kind == "ipv4", surrogates[0]).when(kind.startswith("name"), name).otherwise(F.concat(F.concat_ws("", by_place), rest))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for distinct entities (kind, canonical), without collisions."""
    entities = stored(entities.distinct(), "entities")
    # the gender of a given name is part of its kind, but what must differ is the name
    family = F.regexp_replace("kind", "_[mfn]$", "")
    done = None
    rest = entities.withColumn("attempt", F.lit(0))
    for _ in range(ATTEMPTS):
        drawn = rest.withColumn("surrogate", _surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), key)).withColumn("family", family)
        everyone = drawn if done is None else drawn.unionByName(done)
        first = everyone.groupBy("family", "surrogate").agg(F.min(F.struct("attempt", "kind", "canonical")).alias("first"))
        if done is not None:
            # those drawn before keep what they have
            held = done.select("family", "surrogate", F.lit(True).alias("held"))
            first = first.join(held, ["family", "surrogate"], "left")
        else:
            first = first.withColumn("held", F.lit(None).cast("boolean"))
        real = entities.select(family.alias("family"), F.col("canonical").alias("surrogate"), F.lit(True).alias("real")).distinct()
        judged = drawn.join(first, ["family", "surrogate"]).join(real, ["family", "surrogate"], "left")
        mine = F.col("first") == F.struct("attempt", "kind", "canonical")
        judged = judged.withColumn("good", mine & F.col("held").isNull() & F.col("real").isNull())
        judged = stored(judged.select("kind", "canonical", "attempt", "surrogate", "family", "good"), "drawn")
        good = judged.where("good").drop("good")
        done = good if done is None else done.unionByName(good)
        rest = judged.where(~F.col("good")).select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        if rest.isEmpty():
            return done.select("kind", "canonical", "surrogate")
    raise RuntimeError("surrogates collide after all attempts")


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """docs with a replaced text, and n_entities (mentions replaced) as a last column.

    Who has the key can recompute surrogates from guessed entities: it is a secret of the job's.
    """
    text = pick(docs, "text")[0]
    mark, count = fresh(docs, "mentions"), fresh(docs, "n_entities")
    # a text can hold an entity only with "@", a digit or a form of address
    hint = text.rlike(rf"[@0-9]|\b(?:{_TITLE})\.? \p{{Lu}}|{HEX4}::?{HEX4}")
    flagged = docs.withColumn(mark, F.when(hint, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    none, some = F.coalesce(F.size(mark), F.lit(0)) <= 0, F.size(mark) > 0
    columns = pick(docs, *docs.columns)
    untouched = flagged.where(none).select(*columns, F.lit(0).cast("long").alias(count))

    # a text's fingerprint with its mentions: equal texts are one
    print_, own = F.concat(F.sha2(text, 256), F.length(text).cast("string")), fresh(docs, "print")
    hits = flagged.where(some).withColumn(own, print_)
    found = stored(hits.select(F.col(own).alias("print"), F.col(mark).alias("mentions")).groupBy("print").agg(F.first("mentions").alias("mentions")), "mentions")
    each = found.select("print", F.posexplode("mentions").alias("pos", "whole")).withColumn("mention", entity_in(F.col("whole"))).withColumn("sort", kind_of(F.col("mention")))
    parts = each.where(F.col("sort").isNotNull()).select("print", "pos", "whole", "mention", "sort", F.posexplode(entities_of(F.col("mention"), F.col("sort"))).alias("part", "entity"))
    parts = parts.select("print", "pos", "whole", "mention", "sort", "part", "entity.*")
    table = surrogate_table(parts.select("kind", "canonical"), key)
    joined = parts.join(table, ["kind", "canonical"]).groupBy("print", "pos", "whole", "mention", "sort").agg(
        F.array_sort(F.collect_list(F.struct("part", "canonical", "surrogate"))).alias("found")  # one or two
    )
    surrogates, words = F.transform("found", lambda f: f["surrogate"]), F.transform("found", lambda f: f["canonical"])
    replaced = joined.select(
        "print", F.struct("pos", F.concat(_rendered(F.col("mention"), F.col("sort"), surrogates), F.substr("whole", F.length("mention") + 1)).alias("new")).alias("new"),
        # the name as it may stand elsewhere in the document: in full, and the family name alone
        F.when(F.col("sort").startswith("name"), F.filter(F.array(
            F.when(F.size("found") > 1, F.struct(F.array_join(words, " ").alias("old"), F.array_join(surrogates, " ").alias("new"))),
            F.struct(F.element_at(words, -1).alias("old"), F.element_at(surrogates, -1).alias("new")),
        ), lambda n: n.isNotNull())).alias("names"),
    )
    whole = replaced.groupBy("print").agg(F.map_from_entries(F.collect_list("new")).alias("new"), F.flatten(F.collect_set("names")).alias("names"))
    # full names before family names
    ordered = F.transform(F.array_sort(F.transform(F.array_distinct("names"), lambda n: F.struct((-F.length(n["old"])).alias("size"), n["old"].alias("old"), n["new"].alias("new")))), lambda n: F.struct(
        F.concat(F.lit(r"(?<![\p{L}\p{N}'’-])\Q"), n["old"], F.lit(r"\E(?![\p{L}\p{N}-])")).alias("old"), n["new"].alias("new")))
    new, names = fresh(docs, "new"), fresh(docs, "names")
    out = hits.join(whole.select("print", "new", ordered).toDF(own, new, names), own, "left")
    pieces = F.split(text, PATTERN, -1)
    filled = F.transform(F.col(mark), lambda m, i: F.coalesce(F.try_element_at(F.col(new), i), m))
    untitled = lambda p: F.aggregate(F.coalesce(F.col(names), F.array().cast("array<struct<old:string,new:string>>")), p, lambda a, n: F.regexp_replace(a, n["old"], n["new"]))
    whole_text = F.concat_ws("", F.flatten(F.zip_with(pieces, filled, lambda p, m: F.array(untitled(p), F.coalesce(m, F.lit(""))))))
    changed = out.withColumn("text", whole_text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    changed = changed.select(*columns, F.coalesce(F.size(new), F.lit(0)).cast("long").alias(count))
    return untouched.unionByName(changed)
