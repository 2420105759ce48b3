"""Surrogates for personal data and secrets, in DataFrame functions only.

Detected entities get replacements made from a key: of the same type and format (digits for digits, letters for letters of
the same script and case, the same punctuation; a value of punctuation alone gets a fixed format), names of the same gender and script.  The same entity gets the same
surrogate in every document, also where it is written in another way; different entities get different ones, and
none gets what another entity is really called.  That is checked over all entities, and who loses a collision tries again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

#: Honorifics by gender, and syllables of made-up names by script.
HONORIFICS = {
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "госпожа"],
    "u": ["Dr", "Prof"],
}
SYLLABLES = {
    "latin": ["ba", "del", "fi", "gor", "ha", "jen", "ka", "lu", "mir", "no", "pe", "ral", "sa", "ti", "vo", "zen"],
    "cyrillic": ["ба", "дел", "фи", "гор", "ха", "жен", "ка", "лу", "мир", "но", "пе", "рал", "са", "ти", "во", "зен"],
}
ENDINGS = {("latin", "m"): "ton", ("latin", "f"): "ella", ("latin", "u"): "in", ("cyrillic", "m"): "слав", ("cyrillic", "f"): "ина", ("cyrillic", "u"): "ин"}

#: Letters beyond ASCII by script: what a letter or mark matches, the first of a run of such letters, how many.  Others become ASCII.
LETTERS = [
    (r"[\p{IsLatin}&&\p{Ll}]", 0xE0, 23), (r"[\p{IsLatin}&&\p{Lu}]", 0xC0, 23),
    (r"[\p{IsCyrillic}&&\p{Lu}]", 0x410, 32), (r"\p{IsCyrillic}", 0x430, 32), (r"[\p{IsGreek}&&\p{Lu}]", 0x391, 17), (r"\p{IsGreek}", 0x3B1, 25),
    (r"\p{IsHebrew}", 0x5D0, 27), (r"\p{IsArabic}", 0x628, 19), (r"\p{IsDevanagari}", 0x915, 37), (r"\p{IsThai}", 0xE01, 46),
    (r"\p{IsHiragana}", 0x3041, 86), (r"\p{IsKatakana}", 0x30A1, 90), (r"\p{IsHangul}", 0xAC00, 11172), (r"\p{IsHan}", 0x4E00, 20902),
]
#: Turns after which a key has too few surrogates of its format, and gets a longer one.
TURNS = 8

_ALL = "|".join(x for part in HONORIFICS.values() for x in part)
_FIRST = "".join(sorted({x[0] for part in HONORIFICS.values() for x in part}))
#: What is looked for, in order: at one place the first that fits is taken.
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "secret": r"(?=[PpSsAaTt])(?i:password|passwd|pwd|secret|api[_-]?key|token)[ ]{0,2}[=:][ ]{0,2}[\"']?[^\s\"']{6,}+",
    "aws": r"(?=A)(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?=[0-9])(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,4}(?![0-9])",
    "card": r"(?=[0-9])(?<![0-9A-Za-z])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
    "hex": r"(?=[0-9a-f])(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])",
    "person": rf"(?=[{_FIRST}])(?<!\p{{L}})(?:{_ALL})\.? \p{{Lu}}[\p{{L}}'-]++(?: \p{{Lu}}[\p{{L}}'-]++)*+",
}
PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())
#: Texts without any of these hold nothing that PATTERN finds; most texts end here.
#: What an alternative begins with is looked at first, which most places fail.
MAYBE = rf"[0-9@]|(?=[PpSsKkTt])(?i:password|passwd|pwd|secret|key|token)[ ]{{0,2}}[=:]|(?=[{_FIRST}])(?:{_ALL})\.? \p{{Lu}}|[a-f]{{32}}|A[KS]IA[A-Z0-9]{{16}}"


def is_digit(c: Column) -> Column:
    return c.between("0", "9")


def _spread(df: DataFrame, *columns: str) -> DataFrame:
    """Few bytes but much work for each row: dealt out over all tasks, which adaptive execution would join by size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _kind(raw: Column) -> Column:
    return reduce(lambda c, t: c.when(raw.rlike(f"^(?:{TYPES[t]})$"), t), list(TYPES)[1:], F.when(raw.rlike(f"^(?:{TYPES['email']})$"), "email")).otherwise("hex")


_HEAD = r"^(?i:password|passwd|pwd|secret|api[_-]?key|token)[ ]{0,2}[=:][ ]{0,2}[\"']?"


def _names(raw: Column) -> Column:
    return F.regexp_replace(raw, rf"^(?:{_ALL})\.? ", "")


def _gender(raw: Column) -> Column:
    title = F.regexp_extract(raw, rf"^({_ALL})(?!\p{{L}})", 1)
    return F.when(title.isin(*HONORIFICS["m"]), "m").when(title.isin(*HONORIFICS["f"]), "f").otherwise("u")


def _parts(raw: Column, kind: Column, gender: Column) -> Column:
    """The entities in what was found, as (kind, key): one, or a name's words.  The key is the same for each way of writing."""
    solid = F.regexp_replace(F.upper(raw), "[^0-9A-Z]", "")
    one = lambda k, key: F.array(F.struct(k.alias("kind"), key.alias("key")))
    names = F.split(_names(raw), " ")
    person = F.transform(names, lambda w, i: F.struct(F.when(i == F.size(names) - 1, F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender)).alias("kind"), F.lower(w).alias("key")))
    return (
        F.when(kind == "person", person)
        .when(kind == "email", one(kind, F.lower(raw)))
        .when(kind == "ip", one(kind, raw))
        .when(kind == "secret", one(kind, F.regexp_replace(raw, _HEAD, "")))
        .when((kind == "phone") & F.length(solid).between(11, 13), one(kind, F.substring(solid, -10, 10)))
        .when(kind.isin("aws", "hex"), one(kind, raw))
        .otherwise(one(kind, solid))
    )


def _luhn(digits: Column) -> Column:
    """Sum of Luhn's check; 0 modulo 10 for a valid number."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (1 + F.pmod(n - i, F.lit(2)))
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(value(i) > 9, value(i) - 9).otherwise(value(i)))


def _with_surrogate(keys: DataFrame, secret: str) -> DataFrame:
    """``keys`` (kind, key, turn) with a surrogate each.  In several projections, so that what is used often is written once."""
    kind, key, turn, digest = (F.col(c) for c in ("kind", "key", "turn", "_digest"))
    keys = keys.withColumn("_digest", F.sha2(F.concat_ws("|", F.lit(secret), kind, key, turn.cast("string")), 512))
    byte = lambda d, i: F.conv(F.substring(d, 2 * F.pmod(i - 1, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
    number = lambda i: byte(digest, i)
    pick = lambda table, v, m: F.substring(F.lit(table), F.pmod(v, F.lit(m)) + 1, F.lit(1))
    # characters that say what kind of thing it is stay: country, issuer, reserved domain
    head = F.when(kind == "iban", 2).when(kind == "aws", 4).when(kind == "card", 1).otherwise(0)
    tail = F.when(kind == "email", F.length(F.regexp_extract(key, r"(?:\.example)?\.[a-z0-9-]+$", 0))).otherwise(0)
    # worked out once for all characters of a key, which may be long
    whole = F.struct(digest.alias("d"), F.length(key).alias("n"), head.alias("head"), tail.alias("tail"), key.rlike("^[0-9a-f]+$").alias("hex"))

    def foreign(c, v, more):
        """A letter of the same script; digits of any script become ASCII digits."""
        script = reduce(lambda w, x: w.when(c.rlike(x[0]), F.struct(F.lit(x[1]).alias("first"), F.lit(x[2]).alias("n"))), LETTERS[1:], F.when(c.rlike(LETTERS[0][0]), F.struct(F.lit(LETTERS[0][1]).alias("first"), F.lit(LETTERS[0][2]).alias("n"))))
        letter = lambda p: F.decode(F.unhex(F.lpad(F.hex(p["first"] + F.pmod(v * 256 + more, p["n"])), 4, "0")), "UTF-16BE")
        # bound once: the choice of the script is long
        of_script = F.element_at(F.transform(F.array(script), letter), 1)
        scripts = F.when(c.rlike(r"\p{N}"), pick("0123456789", v, 10)).otherwise(F.coalesce(of_script, pick("abcdefghijklmnopqrstuvwxyz", v, 26)))
        return F.when(c.rlike(r"[\p{L}\p{M}\p{N}]"), scripts).otherwise(c)

    def char(w, c, i):
        v = byte(w["d"], i)
        return (
            F.when((i <= w["head"]) | (i > w["n"] - w["tail"]), c)
            .when((kind == "phone") & i.isin(1, 4) & (w["n"] == 10), pick("23456789", v, 8))
            .when(((kind == "hex") | w["hex"]) & (is_digit(c) | c.between("a", "f")) & kind.isin("hex", "secret"), pick("0123456789abcdef", v, 16))
            .when(is_digit(c), pick("0123456789", v, 10))
            .when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz", v, 26))
            .when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", v, 26))
            .when(c < "\x7f", c)
            .otherwise(foreign(c, v, byte(w["d"], i + 1)))
        )

    mapped = F.element_at(F.transform(F.array(whole), lambda w: F.array_join(F.transform(F.split(key, ""), lambda c, i: char(w, c, i + 1)), "")), 1)
    # what has nothing to map is replaced in a fixed format, so that nothing of it stays and each turn gives another one
    part = lambda i: F.substring(digest, i, 16)
    fixed = F.when(kind == "email", F.concat(part(1), F.lit("@"), part(17), F.substring(key, F.length(key) - tail + 1, tail))).otherwise(part(1))
    varies = F.substring(key, head + 1, F.length(key) - head - tail).rlike(r"[\p{L}\p{M}\p{N}]")
    keys = keys.withColumn("_mapped", mapped)
    keys = keys.withColumn("_mapped", F.when(~varies, fixed).when(turn >= TURNS, F.concat(part(1), "_mapped")).otherwise(F.col("_mapped")))
    mapped = F.col("_mapped")
    # the check digit of a card stays right
    keys = keys.withColumn("_body", F.when(kind == "card", F.substring(mapped, F.lit(1), F.length(mapped) - 1)))
    keys = keys.withColumn("_next", F.concat("_body", F.lit("0")))
    check = F.pmod(10 - F.pmod(_luhn(F.col("_next")), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn(key), F.lit(10)) == 0, F.concat("_body", check)).otherwise(mapped)
    ip = F.concat_ws(".", *((1 + F.pmod(number(F.lit(i)) , F.lit(223 if i == 1 else 254))).cast("string") for i in (1, 2, 3, 4)))
    name = F.lit(None).cast("string")
    for script, test in (("latin", F.lit(True)), ("cyrillic", key.rlike(r"\p{IsCyrillic}"))):
        table = F.array(*map(F.lit, SYLLABLES[script]))
        stem = lambda n, table=table: F.concat(*(F.element_at(table, F.pmod(number(F.lit(i)), F.lit(16)) + 1) for i in range(1, n + 1)))
        end = reduce(lambda c, g, script=script: c.when(kind == f"given_{g}", ENDINGS[script, g]), "mfu", F.when(F.lit(False), ""))
        name = F.when(test, F.when(kind == "surname", stem(5)).otherwise(F.concat(stem(4), end))).otherwise(name)
    is_name = (kind == "surname") | kind.startswith("given_")
    made = F.when(is_name, name).when(kind == "ip", ip).when(kind == "card", card).otherwise(mapped)
    return keys.withColumn("surrogate", made).drop("_digest", "_mapped", "_body", "_next")


def _written(raw: Column, kind: Column, parts: Column) -> Column:
    """The surrogates in the way the entity was written."""
    new = F.element_at(parts, 1)
    n = F.length(raw)
    char = lambda i: F.substring(raw, i, F.lit(1))
    right = lambda i: F.length(F.regexp_replace(F.substring(raw, i, n), "[^0-9A-Za-z]", ""))
    bare = F.regexp_replace(new, "[^0-9A-Za-z]", "")
    from_right = lambda i: F.substring(bare, F.length(bare) - right(i) + 1, F.lit(1))
    solid = lambda c: is_digit(c) | c.between("A", "Z") | c.between("a", "z")
    put = lambda i: F.when(~solid(char(i)) | (right(i) > F.length(bare)), char(i)).when(char(i).between("A", "Z"), F.upper(from_right(i))).otherwise(from_right(i))
    like_raw = F.array_join(F.transform(F.sequence(F.lit(1), n), put), "")
    head = F.regexp_extract(raw, rf"^(?:(?:{_ALL})\.? |{_HEAD[1:]})", 0)
    # a surrogate that is longer than the entity does not fit its way of writing
    like_raw = F.when(F.length(bare) > right(F.lit(1)), new).otherwise(like_raw)
    return F.when(kind == "person", F.concat(head, F.array_join(F.transform(parts, F.initcap), " "))).when(kind == "secret", F.concat(head, new)).when(kind.isin("ip", "aws", "hex"), new).otherwise(like_raw)


def surrogates(entities: DataFrame, secret: str, scratch: Scratch) -> DataFrame:
    """(kind, key, surrogate) for distinct (kind, key): no two alike of one kind, none the key of an entity of its kind."""
    keys = scratch.write(entities.select("kind", "key").distinct().withColumn("turn", F.lit(0)), "keys")
    real = keys.select(F.col("kind").alias("rk"), F.col("key").alias("real"))
    while True:
        made = _with_surrogate(_spread(keys, "key"), secret)
        first = F.row_number().over(W.partitionBy("kind", "surrogate").orderBy("turn", "key")) > 1
        taken = made.withColumn("later", first).join(real, (F.col("kind") == F.col("rk")) & (F.col("surrogate") == F.col("real")), "left")
        made = scratch.write(taken.select("kind", "key", "turn", "surrogate", (F.col("later") | F.col("real").isNotNull()).alias("again")), "made")
        if made.where("again").isEmpty():
            return made.select("kind", "key", "surrogate")
        keys = made.select("kind", "key", (F.col("turn") + F.col("again").cast("int")).alias("turn"))


def surrogate_key(spark: SparkSession) -> str:
    """The secret that surrogates are made from: ``spark.tidemark.surrogateKey`` of the session; without one a key for tests."""
    return spark.conf.get("spark.tidemark.surrogateKey", "tidemark")


def replace_entities(docs: DataFrame, secret: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """The rows of ``docs`` with each detected entity replaced by its surrogate; ``count_col`` adds how many there were
    (in place of a column of that name).

    All rows and columns are kept.  A null or empty text and a text without entities stay as they are; equal texts get
    equal results, so repeated rows are worked out once.  An empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "surrogates")
    text = F.col(f"`{text_col}`").cast("string")
    found = docs.where(text.rlike(MAYBE)).select(F.md5(text).alias("fp"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found")).where(F.size("found") > 0)
    found = scratch.write(found, "found")
    found = scratch.write(found.groupBy("fp").agg(F.first("found").alias("found")), "distinct")
    seen = scratch.write(found.select("fp", F.posexplode("found").alias("pos", "raw")), "seen")
    raw = F.col("raw")
    raws = _spread(seen.select("raw").distinct(), "raw").withColumn("kind", _kind(raw))
    raws = scratch.write(raws.select("raw", "kind", F.when(F.col("kind") == "person", F.lower(_names(raw))).alias("name"), _gender(raw).alias("gender")), "raws")
    # a title without gender takes that of the same name under other titles, where these agree
    told = raws.where("name is not null and gender <> 'u'").groupBy(F.col("name").alias("called")).agg(F.min("gender").alias("told"), F.max("gender").alias("other")).where("told = other")
    raws = raws.join(told, F.col("name") == F.col("called"), "left")
    gender = F.when(F.col("gender") == "u", F.coalesce("told", "gender")).otherwise(F.col("gender"))
    parts = scratch.write(raws.select("raw", F.col("kind").alias("of"), F.posexplode(_parts(raw, F.col("kind"), gender)).alias("i", "e")).select("raw", "of", "i", "e.kind", "e.key"), "parts")
    new = surrogates(parts, secret, scratch).select(F.col("kind").alias("sk"), F.col("key").alias("sv"), "surrogate")
    joined = parts.join(new, (F.col("kind") == F.col("sk")) & (F.col("key") == F.col("sv")))
    whole = joined.groupBy("raw", "of").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "surrogate"))), lambda x: x["surrogate"]).alias("parts"))
    table = scratch.write(_spread(whole, "raw").select(F.col("raw").alias("was"), _written(F.col("raw"), F.col("of"), F.col("parts")).alias("now")), "table")
    put = seen.join(table, F.col("raw") == F.col("was")).groupBy("fp").agg(F.array_sort(F.collect_list(F.struct("pos", "now"))).alias("put"))
    put = scratch.write(put.select(F.col("fp").alias("_pii_fp"), F.transform("put", lambda x: x["now"]).alias("_pii_put")), "put")
    maybe = docs.where(text.rlike(MAYBE)).withColumn("_pii_key", F.md5(text)).join(put.hint("merge"), F.col("_pii_key") == F.col("_pii_fp"), "left")
    pieces = F.zip_with(F.split(text, PATTERN, -1), "_pii_put", lambda s, r: F.concat(s, F.coalesce(r, F.lit(""))))
    changed = F.when(F.col("_pii_put").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(pieces, ""))
    count = [F.coalesce(F.when(F.col("_pii_put").isNotNull(), F.size("_pii_put")), F.lit(0)).alias(count_col)] if count_col else []
    columns = [c for c in docs.columns if c != count_col]
    replaced = maybe.select(*(changed.alias(c) if c == text_col else F.col(f"`{c}`") for c in columns), *count)
    rest = docs.where(~F.coalesce(text.rlike(MAYBE), F.lit(False)))
    return replaced.union(rest.select(*(F.col(f"`{c}`") for c in columns), *([F.lit(0).alias(count_col)] if count_col else [])))
