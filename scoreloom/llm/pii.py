"""Surrogates for personal data, with DataFrame functions only.

Entities (e-mail, phone, IP, card, account and security numbers, access keys, secrets, names
after a title) are found by one regular expression. Each distinct entity, in a normal form that
writes all its mentions alike, gets a keyed surrogate of its own type: same length, character
classes and script, names by the gender of their title. All surrogates of the corpus are checked
against each other and against the originals; those that collide are drawn again until all
differ. So distinct entities stay distinct, and mentions of one entity stay together: also a full
name that stands without its title elsewhere in the text. Names that two titles of different gender
share are two persons. Card and IBAN surrogates have sound check digits where the original has.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm.scratch import stored, unused

# Titles by gender, given names by gender and script, syllables by script.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Sra", "г-жа"]
NEUTRAL = ["Dr", "Prof", "Mx"]
GIVEN = {
    ("m", "latin"): ["Aaron", "Bruno", "Carl", "Dario", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Nils", "Oscar", "Pavel"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Helga", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    ("n", "latin"): ["Alex", "Robin", "Sascha", "Kim", "Toni", "Luca", "Jamie", "Noel", "Chris", "Dana", "Eden", "Jules", "Marin", "Quinn", "Remy", "Sam"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Мария"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя", "Слава"],
}
SYLLABLES = {"latin": ["ba", "be", "bo", "da", "de", "do", "fa", "ga", "ka", "ke", "ko", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "no", "pa", "ra", "re", "ri", "ro", "sa", "so", "ta", "te", "va"], "cyrillic": ["ба", "во", "га", "ди", "ка", "ле", "ма", "но", "па", "ра", "со", "та", "ви", "зо", "ри", "лу"]}
#: Setting of the session that holds the key. Without it a key is drawn for the life of the driver.
KEY_SETTING = "spark.scoreloom.pii.key"
_DRAWN = secrets.token_hex(32)
#: Draws in an entity's own format; each later one is a sign longer than the one before.
NARROW = 8

_TITLES = "|".join(MALE + FEMALE + NEUTRAL)
#: Guards before each alternative keep the search linear in the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}(?![A-Za-z0-9])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z])(?i:passwords?|passwd|pwd|secret|token|api[_-]?key|auth[_-]?token|access[_-]?token)\s{0,3}[=:]\s{0,3}[\"']?(?=[+/_.~-]*+[A-Za-z0-9])[A-Za-z0-9+/_.~-]{6,}+",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\w+-])(?:\d{4}[ -]){3}\d{1,7}(?![\w-])|(?<![\w+-])\d{13,19}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w+])\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}(?!\w)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "name": r"(?<![\p{L}\p{N}])(?:" + _TITLES + r")\.? \p{Lu}[\p{L}'’-]++(?: \p{Lu}[\p{L}'’-]++)*+",
}
#: What each kind can begin with; few places of a text pass, and only there its pattern is tried.
_BEGIN = {"key": "A[KS]IA", "secret": "[aApPsStT]", "ip": "[0-9]", "iban": "[A-Z][A-Z][0-9]", "card": "[0-9]", "ssn": "[0-9]", "phone": "[0-9+(]", "name": "[A-Zг]"}
#: No entity begins behind a Latin letter, so this is asked first.
ANY = "(?<![A-Za-z])(?:" + "|".join(f"(?={_BEGIN[k]})(?:{p})" if k in _BEGIN else p for k, p in PATTERNS.items()) + ")"
#: Without one of these signs a text can hold nothing but names and access keys.
_SIGNS = "[0-9@=:]"
_REST = "(?<![A-Za-z])(?:" + "|".join(f"(?={_BEGIN[k]})(?:{PATTERNS[k]})" for k in ("key", "name")) + ")"
_NAME = f"(?={_BEGIN['name']})(?:{PATTERNS['name']})"


def has_entity(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike(_SIGNS), text.rlike(ANY)).otherwise(text.rlike(_REST)), F.lit(False))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or _DRAWN


def _kind(e: Column) -> Column:
    kind = F.lit("name")  # what no pattern fits is a name without its title
    for name, p in reversed(PATTERNS.items()):
        kind = F.when(e.rlike(rf"\A(?:{p})\z"), name).otherwise(kind)
    return kind


#: Country codes of one and two digits; all others have three. Signs between their digits do not matter.
_COUNTRY = r"(?:[17]|2\D*[07]|3\D*[0-469]|4\D*[013-9]|5\D*[1-8]|6\D*[0-6]|8\D*[1246]|9\D*[0-58]|\d\D*\d\D*\d)"
_LEAD = {"secret": r"(?s)\A[A-Za-z_-]+\s*[=:]\s*[\"']?", "name": r"\A(?:" + _TITLES + r")\.? ", "key": r"\AA[KS]IA", "phone": r"\A\+" + _COUNTRY}


def _parts(e: Column, kind: Column) -> tuple[Column, Column]:
    """What stays of an entity at its start, and the rest that is replaced."""
    lead = F.lit("")
    for name, p in _LEAD.items():
        lead = F.when(kind == name, F.regexp_extract(e, p, 0)).otherwise(lead)
    return lead, F.expr("substring(e, char_length(lead) + 1)")


def _described(e: DataFrame) -> DataFrame:
    """Column e to e, kind, lead, body, gender (m, f; n if not told or no name), script, core (the normal form)."""
    d = e.withColumn("kind", _kind(F.col("e")))
    lead, body = _parts(F.col("e"), F.col("kind"))
    d = d.withColumn("lead", lead).withColumn("body", body)
    title = F.regexp_replace("lead", r"[. ]", "")
    gender = F.when(title.isin(MALE), "m").when(title.isin(FEMALE), "f").otherwise("n")
    numbers = F.col("kind").isin("card", "ssn", "phone")
    digits, code = (F.regexp_replace(c, r"\D", "") for c in ("body", "lead"))
    core = F.when((F.col("kind") == "phone") & (code != ""), F.concat_ws(" ", code, digits)).when(numbers, digits).when(F.col("kind") == "iban", F.regexp_replace("body", " ", "")).when(F.col("kind").isin("email", "name"), F.lower("body")).otherwise(F.col("body"))
    return d.withColumn("gender", F.when(F.col("kind") == "name", gender).otherwise("n")).withColumn("script", F.when(F.col("body").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")).withColumn("core", core)


def _byte(digest: Column, i: Column) -> Column:
    """Byte i of a hex digest of 64 bytes, used around and around."""
    return F.conv(F.substring(digest, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _shifted(text: Column, digest: Column) -> Column:
    """Each letter and digit replaced by another of its class (hex texts stay hex)."""
    hexa = text.rlike(r"\A[0-9a-f]+\z")

    def one(c: Column, i: Column) -> Column:
        def pick(alphabet: str) -> Column:
            at = F.position(c, F.lit(alphabet))
            return F.substring(F.lit(alphabet), F.pmod(at - 1 + _byte(digest, i), F.lit(len(alphabet))) + 1, F.lit(1))

        return F.when(c.rlike("[0-9]"), pick("0123456789")).when(c.rlike("[a-z]"), F.when(hexa, pick("abcdef")).otherwise(pick("abcdefghijklmnopqrstuvwxyz"))).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x00", *parts), 512)


def _bare() -> Column:
    """What of a core surrogates stand for: of a phone number all but its country code."""
    return F.when(F.col("kind") == "phone", F.substring_index("core", " ", -1)).otherwise(F.col("core"))


def _surrogate(key: str, attempt: int) -> Column:
    """A candidate for the core of a described entity."""
    salt = F.lit(f"{key}\x00{attempt}")
    digest = _digest(salt, "kind", "core", "gender")
    domain = F.expr("substring(core, instr(core, '@') + 1)")
    tld = F.regexp_extract(domain, r"\.[a-z]+\z", 0)
    host = F.expr("regexp_replace(substring(core, instr(core, '@') + 1), '[.][a-z]+$', '')")
    more = F.substring(_digest(salt, F.lit("more"), "kind", "core", "gender"), 1, max(0, attempt + 1 - NARROW))
    digits = F.translate(more, "abcdef", "012345")
    email = F.concat(_shifted(F.substring_index("core", "@", 1), digest), more, F.lit("@"), _shifted(host, _digest(F.lit(key), F.lit("host"), host)), tld)
    ip = F.concat_ws(".", F.pmod(_byte(digest, F.lit(0)), F.lit(223)) + 1, *(_byte(digest, F.lit(k)) for k in (1, 2, 3)))
    ip = F.concat(ip, F.lit("."), digits) if attempt >= NARROW else ip

    def word(w: Column, i: Column) -> Column:
        last = i == F.size(F.split("core", " ")) - 1
        own = _digest(F.when(last, F.lit(f"{key}\x00{attempt}")).otherwise(F.lit(key)), w, F.when(last & F.col("shared"), F.col("gender")).otherwise(""))
        out = None
        for script, syl in SYLLABLES.items():
            spell = F.concat(*[F.element_at(F.array(*map(F.lit, syl)), F.pmod(_byte(own, F.lit(2 * k)) * 256 + _byte(own, F.lit(2 * k + 1)), F.lit(len(syl))) + 1) for k in range(3 + min(attempt, 28))])
            given = F.lit("")
            for (g, s), names in GIVEN.items():
                if s == script:
                    given = F.when(F.col("gender") == g, F.element_at(F.array(*[F.lit(x.lower()) for x in names]), F.pmod(_byte(own, F.lit(20)), F.lit(len(names))) + 1)).otherwise(given)
            made = F.when(last, spell).otherwise(given)
            out = made if out is None else F.when(F.col("script") == script, made).otherwise(out)
        return out

    name = F.array_join(F.transform(F.split("core", " "), word), " ")
    longer = F.when(F.col("kind").isin("card", "ssn", "phone"), digits).when(F.col("kind").isin("iban", "key"), F.upper(more)).otherwise(more)
    plain = F.concat(_shifted(_bare(), digest), longer)
    return F.when(F.col("kind") == "email", email).when(F.col("kind") == "ip", ip).when(F.col("kind") == "name", name).when(F.col("kind") == "card", _like_card(plain)).when(F.col("kind") == "iban", _like_iban(plain)).otherwise(plain)


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _like_card(digits: Column) -> Column:
    """`digits` with a sound last digit, if the card's own is sound."""
    front = F.substring(digits, F.lit(1), F.char_length(digits) - 1)
    sound = F.filter(F.array(*(F.concat(front, F.lit(str(k))) for k in range(10))), _luhn)
    return F.when(_luhn(F.col("core")), F.element_at(sound, 1)).otherwise(digits)


def _mod97(text: Column) -> Column:
    """Remainder by 97 of letters and digits, A to Z read as 10 to 35."""
    def step(rest: Column, c: Column) -> Column:
        v = F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
        return F.pmod(F.when(v > 9, rest * 100).otherwise(rest * 10) + v, F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _like_iban(made: Column) -> Column:
    """`made` with the country of the account, and sound check digits if its own are sound."""
    country, account = F.substring("core", 1, 2), F.substring(made, 5, 10_000)
    turned = F.concat(F.substring("core", 5, 10_000), F.substring("core", 1, 4))
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(_mod97(turned) == 1, check).otherwise(F.substring(made, 3, 2)), account)


def _render() -> Column:
    """The surrogate core `s` in the format of a mention `body`; what `s` is longer follows at the end."""
    def digit(c: Column, i: Column) -> Column:
        before = F.char_length(F.regexp_replace(F.substring(F.col("body"), F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
        return F.when(c.rlike("[A-Za-z0-9]"), F.substring(F.col("s"), before, F.lit(1))).otherwise(c)

    rest = F.expr("substring(s, char_length(regexp_replace(body, '[^A-Za-z0-9]', '')) + 1)")
    filled = F.concat(F.array_join(F.transform(F.split("body", ""), digit), ""), rest)
    upper = F.col("body") == F.upper("body")
    cased = F.when(upper, F.upper("s")).when(F.col("kind") == "name", F.initcap("s")).otherwise(F.col("s"))
    return F.concat("lead", F.when(F.col("kind").isin("card", "ssn", "phone", "iban"), filled).otherwise(cased))


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """Entities (kind, core, gender, script) to (kind, core, gender, s), one row for each entity as it
    is mentioned; all s of a kind differ and none equals an original. A mention that tells no gender
    is the one person of its name, if there is but one. Each round settles the first of those that drew
    the same; the rest, few, draw again, from NARROW draws on in longer formats, so that all
    settle also where a format has fewer values than entities."""
    found = found.withColumn("gender", F.coalesce("gender", F.lit("n")))
    named = found.groupBy("kind", "core").agg(F.collect_set("gender").alias("told"), F.min("script").alias("script"))  # three genders at most
    told = F.array_except("told", F.array(F.lit("n")))
    named = named.withColumn("shared", F.size(told) > 1)
    people = stored(named.select("kind", "core", "script", "shared", F.explode(F.when(F.col("shared"), F.col("told")).otherwise(F.array(F.coalesce(F.get(told, F.lit(0)), F.lit("n"))))).alias("gender"), "told"), "entities")
    left, done, attempt = people.drop("told"), None, 0
    originals = people.select("kind", _bare().alias("s")).distinct()
    while True:
        drawn = left.withColumn("s", _surrogate(key, attempt))
        first = drawn.groupBy("kind", "s").agg(F.min(F.struct("core", "gender")).alias("x")).join(originals, ["kind", "s"], "left_anti")
        if done is not None:
            first = first.join(done.select("kind", "s"), ["kind", "s"], "left_anti")
        settled = stored(first.select("kind", "x.core", "x.gender", "s"), "surrogates")
        done = settled if done is None else stored(done.unionByName(settled), "surrogates")
        left = stored(left.join(settled, ["kind", "core", "gender"], "left_anti"), "entities")
        attempt += 1
        if left.isEmpty():
            break
    asked = people.select("kind", "core", F.explode(F.when(F.col("shared"), F.array("gender")).otherwise(F.col("told"))).alias("as"), "gender")
    return asked.join(done.hint("merge"), ["kind", "core", "gender"]).select("kind", "core", F.col("as").alias("gender"), "s")


def _pattern(text: Column) -> Column:
    """ANY, and the full names that stand behind a title in this text, a longer one before those it begins with."""
    names = F.transform(F.regexp_extract_all(text, F.lit(_NAME), F.lit(0)), lambda n: F.regexp_replace(n, _LEAD["name"], ""))
    full = F.array_distinct(F.filter(names, lambda n: F.instr(n, " ") > 0))
    full = F.array_sort(full, lambda a, b: F.char_length(b) - F.char_length(a))
    bare = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}'’-])(?:"), F.array_join(full, "|"), F.lit(r")(?![\p{L}\p{N}'’-])"))
    return F.when(F.size(full) > 0, bare).otherwise(F.lit(ANY))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """`docs` with their texts rewritten, and the number of entities (a column of this name is replaced). Null and
    empty texts stay as they are; rows are kept one by one, also repeated ones. Rows without an
    entity are not shuffled; entities are joined by shuffle, where Spark splits a very common one."""
    text, has = F.col(text_col), has_entity(F.col(text_col))
    row, pattern, new = unused(docs, "row"), unused(docs, "pattern"), unused(docs, "new")
    hit = stored(docs.where(has).withColumn(row, F.monotonically_increasing_id()).withColumn(pattern, _pattern(text)), "private")
    mentions = hit.select(F.col(row).alias("row"), F.posexplode(F.regexp_extract_all(text, F.col(pattern), F.lit(0))).alias("pos", "e"))
    told = _described(mentions)
    made = surrogates(told.select("kind", "core", "gender", "script"), key).hint("merge")
    renamed = told.join(made, ["kind", "core", "gender"]).select("row", F.struct("pos", _render().alias("r")).alias("x"))
    rewritten = renamed.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list("x")).alias(new))
    gaps = F.split(text, F.col(pattern), -1)
    joined = F.array_join(F.zip_with(gaps, F.concat(F.col(f"{new}.r"), F.array(F.lit(""))), lambda g, r: F.concat(g, r)), "")
    changed = hit.join(rewritten, row).withColumn(text_col, joined).withColumn(count_col, F.size(new).cast("long"))
    same = docs.where(~has).withColumn(count_col, F.lit(0).cast("long"))
    columns = [c for c in docs.columns if c != count_col] + [count_col]
    return same.select(columns).unionByName(changed.select(columns))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`, personal data replaced: doc_id, text, n_entities."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), session_key(spark))
