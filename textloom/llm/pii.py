"""Personal data: detected entities get keyed, type-consistent surrogates. SQL functions only.

One pattern finds e-mail addresses, secrets, bank account numbers (IBAN), IPv4 addresses,
card numbers, social-security numbers, phone numbers and persons after a title. What a
text says is put in a canonical form, so that spellings of one entity meet (an address
in any case, a phone number in any layout, a name after any title or none), and each
distinct canonical form in the corpus gets one surrogate, made from a keyed HMAC-SHA-256:

    e-mail      same lengths and letter/digit pattern; a reserved domain ending
    card        same length, first digit kept, Luhn-valid if the original was
    phone       same layout, country code kept;  SSN: same layout
    IBAN        same layout and country, valid check digits if the original's were
    IPv4        octets with as many digits
    secret      same pattern of letters and digits, known prefix kept
    name        in the original's script and case; a name seen as a given name becomes one of
                the gender that its titles in the corpus agree on, a neutral one otherwise

Coreference: a name is one entity whatever its title, so "Dr Anna Berg" and "Mrs Berg" share
it; in a text with such a person, the same names standing alone with a capital are replaced too.

Collision checks: two entities of a type never share a surrogate and no surrogate equals
an entity of the corpus; where they would, the later one (in canonical order) draws again,
and the check is made anew until it finds nothing. Repeated draws widen the space (more
letters, digits or syllables), so that it never runs out.

Rows that may hold entities are written once, with a row number, to the shared folder;
entities are exploded, joined with the surrogate table and put back in place. Other rows
pass through untouched.

Defined cases: null and empty texts, and texts without entities, come back as they are;
overlapping candidates go to the leftmost, then to the first type in the order above; very
long texts are searched whole, by patterns that don't recurse; repeated rows and ids each
keep their row; an empty table stays empty; other columns, of whatever name, are kept.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small, stored

#: A capitalised name; a genitive 's is no part of it.
NAME = r"\p{Lu}(?=[\p{L}'’-])\p{L}{0,63}+(?:[-'’](?!s(?!\p{L}))\p{L}{1,63}+){0,8}+"
#: Names and what stands between them.
TOKEN = NAME + r"|\p{L}++|[^\p{L}]++"
#: Java patterns in the order in which they are tried; none has a capturing group.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9]{1,63}+(?:-{1,63}+[A-Za-z0-9]{1,63}+){0,30}+){1,126}+",
    "assigned": r"(?<![\p{L}\p{N}])(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token|token)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?(?=[A-Za-z_+/=.~!@^-]*[0-9])[A-Za-z0-9_+/=.~!@^-]{8,}",
    "key": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])",
    "hex": r"(?<![A-Za-z0-9])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,128}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9+.,-])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,3}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9])",
    "person": r"(?<![\p{L}\p{N}])(?:Mr|Mrs|Ms|Miss|Mister|Mme|Mlle|Madame|Monsieur|Herr|Frau|Señor|Señora|Sra|Srta|Sr|Dr|Prof|M(?=\.)|г-н|г-жа|господин|госпожа|κύριος|κυρία)\.? " + NAME + "(?: " + NAME + "){0,2}" + r"(?!\p{N})",
}
#: A match begins with a digit, + or (, or with the first letter of a run of letters; asked first, as it
#: rules most places out at once.
GUARD = r"(?:(?=[0-9+(])|(?<!\p{L})(?=\p{L}))"
ANY = GUARD + "(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: Texts with an entity hold a digit, an @, or one of these beginnings: a cheap test that lets most
#: texts without any pass by. A text that it lets in wrongly comes out as it was.
MAY_HOLD = r"(?=[A-Zgsxгκ])(?:M(?:r|s|is|me|lle|adame|onsieur|\.)|Herr|Frau|Señ|Sr|Dr|Prof|г-|госп|κ[ύυ]ρ|AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox|sk-)"
#: What stands before the value in an ``assigned`` match, and before the names in a ``person`` match.
BEFORE_VALUE = r"^(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token|token)[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?"
TITLE = r"^\S+ "
KEY_PREFIX = r"^(?:AKIA|ASIA|gh[pousr]_|glpat-|xox[abprs]-|sk-|AIza)"
TITLES = {
    "m": r"^(?:Mr|Mister|Monsieur|M|Herr|Señor|Sr|г-н|господин|κύριος)\.? ",
    "f": r"^(?:Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Señora|Sra|Srta|г-жа|госпожа|κυρία)\.? ",
}

#: Given names of surrogate persons by script and gender, and syllables of surrogate surnames.
GIVEN = {
    "latin_m": "adam alan bruno carl david emil felix hugo ivan jonas karl leo marc noel oscar paul ralf simon tomas viktor".split(),
    "latin_f": "alice anna bella clara diana elena flora greta hanna irene julia karin laura maria nora olga paula rosa sofia vera".split(),
    "latin_n": "alex andrea chris dana eden jamie jordan kim lee marion noa robin sam sascha toni".split(),
    "cyrillic_m": "антон борис виктор глеб денис егор иван кирилл лев максим олег павел роман семён тимур".split(),
    "cyrillic_f": "алла вера галина дарья елена жанна инна клара лидия мария нина ольга полина раиса софья".split(),
    "cyrillic_n": "женя саша валя слава шура".split(),
    "greek_m": "ανδρέας γιώργος δημήτρης ηλίας θωμάς κώστας λουκάς μάριος νίκος πέτρος στέφανος φώτης".split(),
    "greek_f": "άννα βασιλική γεωργία δήμητρα ελένη ζωή ιωάννα κατερίνα μαρία νίκη σοφία φανή".split(),
    "greek_n": "άρις φοίβη νεφέλη".split(),
}
SYLLABLES = {
    "latin": "bar ben bor cal cor dal dan del dor fal fen gar gil hal har hol jan kel kor lan lin lor mal mar mel mor nal nor pal per ral ren ros sal san sel sol tal ter tor val ver vin wal wen wil yar zan zel".split(),
    "cyrillic": "бар бел вал вер гор дар дем дол жар зан кал кор лаз лев мал мир нор ор пал рад рог сал сев тар тим фад хар чер шал яр".split(),
    "greek": "αλ βασ γαλ δαμ ελ ζαχ θεο καλ κων λαμ μαρ νικ παπ ραλ σαρ σταθ τσακ φιλ χαρ χρισ".split(),
}
SURNAME_END = {"latin": "en", "cyrillic": "ин", "greek": "ίδης"}


def _digest(key: str, *parts):
    """HMAC-SHA-256 of the parts, in hexadecimal digits."""
    raw = key.encode("utf-8")
    raw = (raw if len(raw) <= 64 else hashlib.sha256(raw).digest()).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in raw))
    inner = F.sha2(F.concat(pad(0x36), F.encode(F.concat_ws("\u001f", *parts), "UTF-8")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


def _draw(seed, salt, n):
    """A number below ``n`` drawn from the seed for one use."""
    return F.pmod(F.xxhash64(seed, salt), F.lit(n).cast("long")).cast("int")


def _after(text, pattern):
    """The text without the beginning that the pattern describes."""
    return F.regexp_replace(text, pattern, "")


def _letter(seed, i, alphabet="abcdefghijklmnopqrstuvwxyz"):
    return F.substr(F.lit(alphabet), _draw(seed, i, len(alphabet)) + 1, F.lit(1))


def _shape(text, seed):
    """Letters to letters of the same case, digits to digits; everything else stays."""
    one = lambda c, i: (
        F.when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(_letter(seed, i))).when(c.rlike(r"\p{L}"), _letter(seed, i)).otherwise(c)
    )
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _hex_shape(text, seed):
    one = lambda c, i: F.when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string")).otherwise(_letter(seed, i, "abcdef"))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits, doubled: int):
    """Luhn sum; ``doubled`` 1 doubles the last digit and every second before it, 0 the others."""
    n = F.length(digits)
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == doubled, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def _mod_97(text):
    """An account number, rearranged, modulo 97; letters count as 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _type_of(m):
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(m.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(out)
    return out


def _script(word):
    return F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def entities(hits: DataFrame) -> DataFrame:
    """(uid, pos, part, type, canon, lead, form, given) of (uid, text).

    ``pos`` numbers a text's matches, ``part`` the pieces of one: a person is a piece per
    name, anything else one piece. ``form`` is what the surrogate replaces, ``lead`` what
    stands before it in the match and stays; ``given`` is the title's gender where the piece
    is a given name, else null.
    """
    m = hits.select("uid", F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("pos", "match")).withColumn("kind", _type_of(F.col("match")))
    match, kind = F.col("match"), F.col("kind")
    digits = F.regexp_replace(match, "[^0-9]", "")
    code = F.when(~match.startswith("+"), 0).when(digits.rlike("^[17]"), 1).otherwise(2)  # digits of the country
    lead = F.when(kind == "assigned", F.regexp_extract(match, BEFORE_VALUE, 0)).otherwise(F.lit(""))
    form = F.when(kind == "assigned", _after(match, BEFORE_VALUE)).otherwise(match)
    plain = m.where("kind <> 'person'").select(
        "uid",
        "pos",
        F.lit(0).alias("part"),
        F.when(kind.isin("key", "hex", "assigned"), F.lit("secret")).otherwise(kind).alias("type"),
        F.when(kind == "email", F.lower(match))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.concat(F.substr(digits, F.lit(1), code), F.lit("/"), F.substr(digits, code + 1)))
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .otherwise(form)
        .alias("canon"),
        lead.alias("lead"),
        form.alias("form"),
    )
    gender = F.when(match.rlike(TITLES["m"]), F.lit("m")).when(match.rlike(TITLES["f"]), F.lit("f")).otherwise(F.lit("n"))
    names = m.where("kind = 'person'").select("uid", "pos", gender.alias("gender"), F.regexp_extract(match, TITLE, 0).alias("title"), F.split(_after(match, TITLE), " ").alias("names"))
    words = names.select("uid", "pos", "gender", "title", F.size("names").alias("n"), F.posexplode("names").alias("part", "form"))
    persons = words.select(
        "uid",
        "pos",
        "part",
        F.concat(F.lit("name_"), _script(F.col("form"))).alias("type"),
        F.lower("form").alias("canon"),
        F.when(F.col("part") == 0, F.col("title")).otherwise(F.lit(" ")).alias("lead"),
        "form",
        F.when(F.col("part") < F.col("n") - 1, F.col("gender")).alias("given"),
    )
    return plain.withColumn("given", F.lit(None).cast("string")).unionByName(persons)


def _candidate(key: str):
    """Surrogate of (type, canon) at an attempt, in canonical form."""
    kind, canon, attempt = F.col("type"), F.col("canon"), F.col("attempt")
    seed = _digest(key, kind, canon, attempt.cast("string"))

    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    own_seed = _digest(key, F.lit("domain"), domain)
    reserved = F.regexp_extract(domain, r"(?:^|\.)(example\.(?:com|org|net))$", 1)
    head = F.regexp_replace(domain, r"\.?example\.(?:com|org|net)$", "")
    new_domain = (
        F.when((reserved != "") & (head == ""), reserved)
        .when(reserved != "", F.concat(_shape(head, own_seed), F.lit("."), reserved))
        .otherwise(F.concat(_shape(F.regexp_replace(domain, r"\.[^.]*$", ""), own_seed), F.lit(".example")))
    )
    wider = F.greatest(F.floor(attempt / 4).cast("int") - 1, F.lit(0))  # characters more than the original has
    email = F.concat(_shape(F.concat(local, F.repeat(F.lit("x"), wider)), seed), F.lit("@"), new_domain)
    more = F.repeat(F.lit("0"), wider)

    body = F.concat(F.substr(canon, F.lit(1), F.lit(1)), _shape(F.concat(F.substr(canon, F.lit(2), F.length(canon) - 2), more), seed))
    check = (10 - _luhn_sum(body, 1) % 10) % 10
    card = F.concat(body, F.when(_luhn_sum(canon, 0) % 10 == 0, check).otherwise((check + 1 + _draw(seed, F.lit("check"), 9)) % 10).cast("string"))

    phone = F.concat(F.substring_index(canon, "/", 1), F.lit("/"), _shape(F.concat(F.substring_index(canon, "/", -1), more), seed))

    def octet(c, i):
        n = F.length(c)  # after a few collisions the number of digits is given up
        return F.when(attempt >= 4, 1 + _draw(seed, i, 254)).when(n == 1, 1 + _draw(seed, i, 9)).when(n == 2, 10 + _draw(seed, i, 90)).otherwise(100 + _draw(seed, i, 155)).cast("string")

    ip = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
    ip = F.when(attempt >= 24, F.concat(F.lit("2001:db8::"), F.substr(seed, F.lit(1), F.lit(4)), F.lit(":"), F.substr(seed, F.lit(5), F.lit(4)))).otherwise(ip)
    secret = F.when(canon.rlike("^[0-9a-f]+$"), _hex_shape(F.concat(canon, more), seed)).otherwise(F.concat(F.regexp_extract(canon, KEY_PREFIX, 0), _shape(F.concat(_after(canon, KEY_PREFIX), more), seed)))
    country, account = F.substr(canon, F.lit(1), F.lit(2)), _shape(F.concat(F.substr(canon, F.lit(5)), more), seed)
    valid = _mod_97(F.concat(F.substr(canon, F.lit(5)), F.substr(canon, F.lit(1), F.lit(4)))) == 1
    right = 98 - _mod_97(F.concat(account, country, F.lit("00")))
    iban = F.concat(country, F.lpad(F.when(valid, right).otherwise(_draw(seed, F.lit("check"), 100)).cast("string"), 2, "0"), account)

    out = F.when(kind == "email", email).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip)
    out = out.when(kind == "iban", iban).when(kind == "secret", secret).when(kind == "ssn", _shape(F.concat(canon, more), seed))
    for script, syllables in SYLLABLES.items():
        parts = F.array(*map(F.lit, syllables))
        # a syllable more with every attempt: the space of names doesn't run out
        spun = F.array_join(F.transform(F.sequence(F.lit(1), 2 + attempt), lambda i: F.element_at(parts, _draw(seed, i, len(syllables)) + 1)), "")  # noqa: B023
        named = F.concat(spun, F.lit(SURNAME_END[script]))
        for gender in "mfn":
            pool = GIVEN[f"{script}_{gender}"]
            first = F.element_at(F.array(*map(F.lit, pool)), _draw(seed, F.lit("given"), len(pool)) + 1)
            named = F.when(F.col("gender") == gender, F.concat(first, F.when(attempt > 1, F.concat(F.lit("-"), spun)).otherwise(F.lit("")))).otherwise(named)
        out = out.when(kind == f"name_{script}", named)
    return out


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """(type, canon, surrogate), a row per distinct entity, free of collisions."""
    said = lambda g: F.max(F.col("given") == g)
    gender = F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").when(F.col("m").isNotNull(), "n")
    known = found.groupBy("type", "canon").agg(said("m").alias("m"), said("f").alias("f")).select("type", "canon", gender.alias("gender"), F.lit(0).alias("attempt"))
    draw = stored(known.withColumn("surrogate", _candidate(key)), "pii-surrogates")
    while True:
        shared = draw.groupBy("type", "surrogate").agg(F.count("*").alias("n"), F.min("canon").alias("first")).where("n > 1").select("type", "surrogate", "first")
        taken = draw.select("type", F.col("canon").alias("surrogate"), F.lit(None).cast("string").alias("first"))
        bad = draw.join(shared.unionByName(taken), ["type", "surrogate"]).where("first IS NULL OR first <> canon")
        bad = stored(bad.select("type", "canon", F.lit(1).alias("again")).distinct(), "pii-collisions")
        if not bad.limit(1).count():
            return draw.select("type", "canon", "surrogate")
        redrawn = draw.join(bad, ["type", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("again", F.lit(0)))
        draw = stored(redrawn.withColumn("surrogate", F.when(F.col("again") == 1, _candidate(key)).otherwise(F.col("surrogate"))).drop("again"), "pii-surrogates")


def _cased(form, name):
    """A name in the case of what it replaces."""
    upper = (F.upper(form) == form) & (F.lower(form) != form) & (F.length(form) > 1)
    return F.when(upper, F.upper(name)).otherwise(F.initcap(name))


def _laid_out(form, kind, surrogate):
    """The surrogate in the layout and case of what it replaces."""
    flat = F.regexp_replace(surrogate, "/", "")  # country code and number of a phone
    laid = F.aggregate(  # the form's digits (an IBAN's letters too) are replaced one by one
        F.split(form, ""),
        F.struct(F.lit(0).alias("n"), F.lit("").alias("s")),
        lambda a, c: F.struct(
            (a["n"] + c.rlike("[A-Z0-9]").cast("int")).alias("n"),
            F.concat(a["s"], F.when(c.rlike("[A-Z0-9]"), F.substr(flat, a["n"] + 1, F.lit(1))).otherwise(c)).alias("s"),
        ),
    )
    filled = F.concat(laid["s"], F.substr(flat, laid["n"] + 1))  # a widened surrogate is longer
    upper = (F.upper(form) == form) & (F.lower(form) != form) & (F.length(form) > 1)
    return (
        F.when(kind.isin("card", "ssn", "phone", "iban"), filled)
        .when((kind == "email") & upper, F.upper(surrogate))
        .when(kind.startswith("name_"), _cased(form, surrogate))
        .otherwise(surrogate)
    )


def _recurring(gap, names):
    """What stands between matches, with the names of the text's persons replaced wherever they stand alone."""
    one = lambda t: F.when(t.rlike(r"\A\p{Lu}") & F.map_contains_key(names, F.lower(t)), _cased(t, F.element_at(names, F.lower(t)))).otherwise(t)
    return F.array_join(F.transform(F.regexp_extract_all(gap, F.lit(TOKEN), F.lit(0)), one), "")


def anonymised(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col``, drawn under the secret ``key``; ``count_col`` adds
    the number of matches replaced (names that recur alone aren't counted again)."""
    if not key:
        raise ValueError("surrogates need a key")
    has = F.coalesce(F.col(text_col).rlike("[0-9@]") | F.col(text_col).rlike(MAY_HOLD), F.lit(False))
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_"))
    hits = stored(docs.where(has).select(F.monotonically_increasing_id().alias("uid"), F.col(text_col).alias("text"), rest.alias("rest")), "pii-hits")
    found = stored(entities(hits.select("uid", "text")), "pii-entities")
    table = small(surrogates(found, key), 200_000)  # rows of up to a few hundred bytes
    new = F.concat("lead", _laid_out(F.col("form"), F.col("type"), F.col("surrogate")))
    name = F.when(F.col("type").startswith("name_"), F.struct("canon", "surrogate"))
    placed = found.join(table, ["type", "canon"]).select("uid", "pos", "part", new.alias("new"), name.alias("name"))
    back = placed.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", "part", "new"))).alias("new"), F.map_from_entries(F.collect_set("name")).alias("names"))
    whole = hits.join(back, "uid", "left").withColumn("gaps", F.split("text", ANY, -1))
    whole = whole.withColumn("gaps", F.when(F.size("names") > 0, F.transform("gaps", lambda g: _recurring(g, F.col("names")))).otherwise(F.col("gaps")))
    pieces = F.transform(F.coalesce("new", F.array().cast("array<struct<pos:int,part:int,new:string>>")), lambda x: F.when(x["part"] == 0, F.concat(F.element_at("gaps", x["pos"] + 1), x["new"])).otherwise(x["new"]))
    joined = F.concat(F.array_join(pieces, ""), F.element_at("gaps", -1))
    n = [(F.size("gaps") - 1).alias(count_col)] if count_col else []
    done = whole.select(*[joined.alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns], *n)
    clean = docs.where(~has)
    return (clean.withColumn(count_col, F.lit(0)) if count_col else clean).unionByName(done)
