"""PII surrogates, in DataFrame functions only.

Detected entities (e-mail addresses, phone numbers, IPv4 addresses, payment card numbers, IBANs, US social
security numbers, and names after a form of address) are replaced by keyed surrogates of the same type:

* *Keyed*: a surrogate is drawn from SHA-256 of key, type, entity and round; without the key it
  tells nothing of the entity.
* *Type and format*: letters become letters, digits digits, at the mention's own lengths and
  separators; cards pass the Luhn check, addresses have octets up to 255, mail domains are
  under ``example.com``. Names keep the form of address, its gender (given names end by gender)
  and script (Latin or Cyrillic).
* *Coreference*: mentions are normalised (case, separators, country code), and one entity has
  one surrogate in the whole corpus; family names agree with and without a given name.
* *Collision checks*: surrogates of a type must differ from each other and from every real
  entity of the type. Entities that lose a check draw again (next round) until none does; after
  ``STRETCH`` rounds letters are added, so short mail names cannot run out.

Entities are pre-aggregated before the shuffle, so one entity in a third of all rows is a
row a task. Only rows with a mention are shuffled; the others pass through the scan. A text is
cut at its mentions and joined again, so everything between them stays as it is.

Cases: null text stays null, texts without a mention are unchanged. Null ids and repeated rows are treated
like others (equal rows get equal results). Other columns are kept by ``replaced``. Empty tables give none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm._tables import stored

STRETCH = 6
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
PHONE = r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"
IP = r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w-])(?!\.\d)"
CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-])"
IBAN = r"(?<![\w-])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
#: Forms of address by gender (fixed values).
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "Госпожа")
NAME = (r"(?<![\p{L}\d])(?:" + "|".join(sorted(MALE + FEMALE, key=len, reverse=True))
        + r")\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?(?!\p{L})")
ANY = "|".join(f"(?:{p})" for p in (EMAIL, PHONE, SSN, IP, CARD, IBAN, NAME))


def _digest(key: str, kind: Column, norm: Column, turn: Column, salt: str = "") -> Column:
    return F.sha2(F.concat_ws("\x00", F.lit(key), kind, norm, turn.cast("string"), F.lit(salt)), 256)


def _number(hexes: Column, start: int, size: int = 6) -> Column:
    return F.conv(F.substring(hexes, start, size), 16, 10).cast("long")


def _digits(hexes: Column) -> Column:
    """Forty decimal digits of a digest."""
    return F.concat(*[F.lpad((_number(hexes, 1 + 6 * i) % 10000).cast("string"), 4, "0") for i in range(10)])


def _letters(hexes: Column, chars: Column) -> Column:
    """Characters replaced class by class: a-z by a-z, 0-9 by 0-9, all else kept."""
    def one(c, i):
        x = F.conv(F.substring(hexes, (F.pmod(i * 5, F.lit(56)) + 1).cast("int"), F.lit(6)), 16, 10).cast("long") + i
        return (F.when(c.rlike("^[a-z]$"), F.chr(F.lit(97) + F.pmod(x, F.lit(26))))
                .when(c.rlike("^[0-9]$"), F.pmod(x, F.lit(10)).cast("string")).otherwise(c))
    return F.array_join(F.transform(chars, one), "")


def _luhn(body: Column) -> Column:
    """``body`` digits with the check digit that makes the whole pass the Luhn test."""
    d = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, F.when(c.cast("int") > 4, 2 * c.cast("int") - 9)
                                                                      .otherwise(2 * c.cast("int"))).otherwise(c.cast("int")))
    total = F.aggregate(d, F.lit(0), lambda a, x: a + x)
    return F.concat(body, F.pmod(-total, F.lit(10)).cast("string"))


#: Syllables of drawn names, and the endings of given names by gender (fixed values).
LATIN = ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ka", "ke", "la", "le", "lo", "ma", "me", "mo",
         "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve", "vo", "zo")
CYRILLIC = ("ба", "бе", "бо", "да", "де", "до", "фа", "фе", "ка", "ке", "ла", "ле", "ло", "ма", "ме", "мо",
            "на", "не", "но", "ра", "ре", "ро", "са", "се", "со", "та", "те", "то", "ва", "ве", "во", "зо")
ENDING = {"given_m": ("n", "н"), "given_f": ("lia", "лия"), "family": ("ri", "ри")}


def _name(hexes: Column, norm: Column, kind: Column, turn: Column) -> Column:
    def of(table, script):
        parts = [F.element_at(F.array(*map(F.lit, table)), (F.pmod(_number(hexes, 1 + 5 * i), F.lit(32)) + 1).cast("int"))
                 for i in range(4)]
        end = reduce(lambda c, k: c.when(kind == k, F.lit(ENDING[k][script])), list(ENDING)[1:],
                     F.when(kind == list(ENDING)[0], F.lit(ENDING[list(ENDING)[0]][script])))
        more = F.when(turn >= STRETCH, F.array_join(F.array(*parts[:2]), "")).otherwise("")
        return F.concat(*parts, more, end)
    return F.when(norm.rlike(r"\p{IsCyrillic}"), of(CYRILLIC, 1)).otherwise(of(LATIN, 0))


def _surrogate(key: str) -> Column:
    """The surrogate of an entity row (kind, norm, turn), normalised like the entity."""
    kind, norm, turn = F.col("kind"), F.col("norm"), F.col("turn")
    h = _digest(key, kind, norm, turn)
    digits = _digits(h)
    n = F.length(norm)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    place = _digest(key, F.lit("domain"), domain, F.lit(0))
    more = F.when(turn >= STRETCH, _letters(h, F.split(F.lit("abcdef"), ""))).otherwise("")
    email = F.concat(_letters(h, F.split(local, "")), more, F.lit("@"),
                     _letters(place, F.split(F.lit("abcdefgh"), "")), F.lit(".example.com"))
    phone = F.concat((2 + F.pmod(_number(h, 50), F.lit(8))).cast("string"), F.substring(digits, 1, 9))
    octet = lambda i, low, span: (low + F.pmod(_number(h, 1 + 6 * i), F.lit(span))).cast("string")
    ip = F.concat_ws(".", octet(0, 1, 223), octet(1, 0, 256), octet(2, 0, 256), octet(3, 0, 256))
    card = _luhn(F.concat(F.substring(norm, 1, 1), F.substring(digits, F.lit(1), n - 2)))
    iban = F.upper(F.concat(F.lower(F.substring(norm, 1, 2)), _letters(h, F.split(F.lower(F.substring(norm, F.lit(3), n)), ""))))
    ssn = F.concat(F.lit("9"), F.substring(digits, 1, 8))       # numbers from 900 on are never issued
    return (F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip)
            .when(kind == "card", card).when(kind == "iban", iban).when(kind == "ssn", ssn)
            .otherwise(_name(h, norm, kind, turn)))


def _entity(m: Column) -> Column:
    """Struct (kind, norm, kind2, norm2) of a mention; the second pair is the family name after a given one."""
    digits = F.regexp_replace(m, r"\D", "")
    title = F.regexp_replace(F.substring_index(m, " ", 1), r"\.$", "")
    rest = F.split(m, " ")
    given = F.when(title.isin(*FEMALE), F.lit("given_f")).otherwise("given_m")
    two = F.size(rest) > 2
    kind = (F.when(m.contains("@"), "email").when(m.rlike(f"^(?:{SSN})$"), "ssn").when(m.rlike(f"^(?:{PHONE})$"), "phone")
            .when(m.rlike(f"^(?:{IP})$"), "ip").when(m.rlike(f"^(?:{CARD})$"), "card").when(m.rlike(f"^(?:{IBAN})$"), "iban")
            .when(two, given).otherwise("family"))
    norm = (F.when(kind == "email", F.lower(m)).when(kind == "phone", F.substring(digits, -10, 10)).when(kind == "ip", m)
            .when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(m, " ", ""))
            .otherwise(F.lower(F.get(rest, F.lit(1)))))
    return F.struct(kind.alias("kind"), norm.alias("norm"), F.when(kind.startswith("given"), F.lit("family")).alias("kind2"),
                    F.when(kind.startswith("given"), F.lower(F.get(rest, F.lit(2)))).alias("norm2"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) for distinct entities (kind, norm), without collisions."""
    real = stored(entities.select("kind", "norm").distinct(), "entities")
    done = stored(real.withColumn("turn", F.lit(0)).withColumn("surrogate", _surrogate(key)), "drawn")
    while True:
        # of equal surrogates the earliest round and smallest entity keeps it; real entities keep their own names
        owner = done.groupBy("kind", "surrogate").agg(F.min(F.struct("turn", "norm")).alias("own"))
        taken = real.select("kind", F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
        seen = done.join(owner, ["kind", "surrogate"]).join(taken, ["kind", "surrogate"], "left")
        lost = F.col("real").isNotNull() | (F.col("own.norm") != F.col("norm"))
        if seen.where(lost).isEmpty():
            return done.select("kind", "norm", "surrogate")
        done = stored(seen.select("kind", "norm", F.when(lost, F.col("turn") + 1).otherwise(F.col("turn")).alias("turn"))
                      .withColumn("surrogate", _surrogate(key)), "drawn")


def _shown(m: Column, kind: Column, s: Column, s2: Column) -> Column:
    """A surrogate in the format of its mention."""
    phone = r"^(.*?)(\d{3})(\D+)(\d{3})(\D+)(\d{4})$"
    part = lambda i: F.regexp_extract(m, phone, i)
    cap = lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))
    sep = F.regexp_extract(m, "[ -]", 0)
    title = F.substring_index(m, " ", 1)
    return (F.when(kind == "email", F.when(F.upper(m) == m, F.upper(s)).otherwise(s))
            .when(kind == "phone", F.concat(part(1), F.substring(s, 1, 3), part(3), F.substring(s, 4, 3), part(5), F.substring(s, 7, 4)))
            .when((kind == "card") & (sep != ""), F.concat_ws("", F.substring(s, 1, 4), sep, F.substring(s, 5, 4), sep,
                                                              F.substring(s, 9, 4), sep, F.substring(s, 13, 4)))
            .when(kind == "ssn", F.concat_ws("-", F.substring(s, 1, 3), F.substring(s, 4, 2), F.substring(s, 6, 4)))
            .when((kind == "iban") & m.contains(" "), F.trim(F.regexp_replace(s, "(.{4})", "$1 ")))
            .when(kind == "family", F.concat(title, F.lit(" "), cap(s)))
            .when(kind.startswith("given"), F.concat(title, F.lit(" "), cap(s), F.lit(" "), cap(s2))).otherwise(s))


def replaced(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """``docs`` with surrogates in text and n_pii, the mentions replaced. All other columns are kept."""
    docs = docs.drop("n_pii")
    has = F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    named = F.xxhash64("doc_id", "text").alias("_row"), F.crc32(F.col("text").cast("binary")).alias("_crc")
    hit = docs.where(has)
    mentions = stored(hit.select(*named, F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("_pos", "_m"))
                      .distinct().withColumn("_e", _entity(F.col("_m"))), "mentions")
    one = mentions.select(F.col("_e.kind").alias("kind"), F.col("_e.norm").alias("norm"))
    two = mentions.select(F.col("_e.kind2").alias("kind"), F.col("_e.norm2").alias("norm")).where("kind is not null")
    table = stored(surrogates(one.unionByName(two), key), "surrogates")
    first = table.select(F.col("kind").alias("_k1"), F.col("norm").alias("_n1"), F.col("surrogate").alias("_s1"))
    second = table.select(F.col("kind").alias("_k2"), F.col("norm").alias("_n2"), F.col("surrogate").alias("_s2"))
    shown = (mentions.select("*", F.col("_e.kind").alias("_k1"), F.col("_e.norm").alias("_n1"), F.col("_e.kind2").alias("_k2"),
                             F.col("_e.norm2").alias("_n2")).join(first, ["_k1", "_n1"]).join(second, ["_k2", "_n2"], "left")
             .select("_row", "_crc", "_pos", _shown(F.col("_m"), F.col("_k1"), F.col("_s1"), F.col("_s2")).alias("_new")))
    lists = (shown.groupBy("_row", "_crc").agg(F.array_sort(F.collect_list(F.struct("_pos", "_new"))).alias("_list")))
    pieces = F.arrays_zip(F.split("text", ANY, -1).alias("a"), F.transform("_list", lambda x: x["_new"]).alias("b"))
    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["a"], F.coalesce(p["b"], F.lit("")))), "")
    done = (hit.select("*", *named).join(lists, ["_row", "_crc"])
            .select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns],
                    F.size("_list").cast("long").alias("n_pii")))
    return docs.where(~has).withColumn("n_pii", F.lit(0).cast("long")).unionByName(done)


def surrogate_texts(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    """(doc_id, text, n_pii)."""
    return replaced(docs.select("doc_id", "text"), key)
