"""PII surrogates: keyed, type-consistent replacements (operator 7).

One pattern finds e-mail addresses, IPv4 and IPv6 addresses, IBANs, phone, card
and social security numbers, and titled person names.  Every entity gets a
surrogate drawn from a keyed SHA-256 stream of its canonical form (case-folded
address, digits of a number, single name parts), so all mentions of it, in
whatever format, get the same one: "Mr John Smith" and "Mr Smith" stay one
surname.  Once a person is found by title and full name, the same full name
without a title is replaced as well, anywhere in that document.

Surrogates keep the type and format: digits for digits and letters for
letters, a top-level domain, octets of the same width, a card's Luhn and an
IBAN's check digits, the punctuation of the mention, and for names the gender
of the title and the script.  (Latin, Cyrillic, Greek and Armenian; a name in
another cased script gets a Latin one.)  What looks like an IBAN without valid
check digits, or like a phone of under seven digits, is no entity.

Collision checks keep distinct entities distinct: over the table of entities,
surrogates drawn twice or equal to a real entity are redrawn (all but the
first, in a fixed order) until none is left.  From ``WIDEN`` redraws on each
one lengthens the form, so that its space grows tenfold a time and no corpus
runs out of it.  Only redrawn entities are joined to mentions; all other
surrogates are computed in place.

The pattern repeats groups only possessively or up to a small bound, so the
matcher needs no stack that grows with the text, and looks at a character a
bounded number of times.

DataFrame functions only.  The pattern runs over each text once: documents are
staged with their mentions.  Mentions travel without texts and once a document
and place, and per-document arrays of surrogates go back by one join on the
document key.

Defined results: null text stays null; texts without entities are unchanged;
repeated rows are one document; null ids are a key of their own; an empty table
gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impressa.llm.common import KEY, doc_key, shuffle_partitions
from impressa.sources.sinks import stage

# Patterns of the entity types, titles by gender, given names by
# gender and script, and syllables of surnames by script.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]{1,63}+\.){1,16}[A-Za-z]{2,63}+"
IPV6 = (r"(?<![\w:.])(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
        r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])")
IBAN = r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?!\w|\.[0-9])"
CARD = r"(?<!\w)(?:[0-9]{4}[ -]?){3}[0-9]{4}(?!\w)"
SSN = r"(?<!\w)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!\w)"
NATIONAL = r"(?<!\w)(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?!\w)"
_FOUR = r"(?:[0-9]{4}[ -]?){3}[0-9]{4}"
_SO_FAR = r"[0-9][ .()-]{0,2}" * 11
#: Cards from here on: whole ones up to the end of the run of four-digit groups, or any after 11 digits of a phone.
_CARDS = rf"(?<!\w){_FOUR}(?:[ -]{_FOUR})*+(?!\w|[ -][0-9]{{4}}(?!\w))|(?<={_SO_FAR}){CARD}"
#: No group of a phone's tail is the head of another entity.
PHONE = (r"(?<!\w)\+(?=(?:[0-9][ .()-]{0,2}){6}[0-9])[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})"
         rf"(?:(?! (?:{SSN}|{NATIONAL}))[ .-]?(?!{EMAIL}|{IP}|{_CARDS})[0-9]{{2,4}}){{1,4}}(?!\w)|{NATIONAL}")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "г-н")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "г-жа")
GIVEN = {
    "m": {"latin": ["James", "Peter", "Martin", "Lucas", "Daniel", "Victor", "Simon", "Oscar"],
          "cyrillic": ["Иван", "Пётр", "Олег", "Павел", "Роман", "Антон", "Денис", "Максим"]},
    "f": {"latin": ["Mary", "Laura", "Helen", "Nora", "Sophie", "Clara", "Julia", "Irene"],
          "cyrillic": ["Анна", "Мария", "Ольга", "Елена", "Нина", "Вера", "Ирина", "Дарья"]},
}
SYLLABLES = {
    "latin": ["ba", "den", "fol", "gar", "hin", "jor", "kel", "lam", "mor", "nes", "pol", "ric", "sel", "tor", "van", "wes"],
    "cyrillic": ["ба", "вен", "гор", "дан", "жел", "зин", "кор", "лан", "мир", "нов", "пет", "рос", "сел", "тур", "фед", "шин"],
}
TITLES = "|".join(sorted(MALE + FEMALE, key=len, reverse=True))
NAME = rf"(?<!\w)(?:{TITLES})\.? \p{{Lu}}\p{{Ll}}+(?: (?!(?:{TITLES})\.? \p{{Lu}})\p{{Lu}}\p{{Ll}}+)?"
_FIRST = "".join(sorted({t[0] for t in MALE + FEMALE}))
_REST = "|".join(sorted({t[1:] for t in MALE + FEMALE}, key=len, reverse=True))
#: Every entity begins behind no word character, which spares most places all but one look.
ANY = (rf"(?<!\w)(?:{EMAIL}|(?=[0-9A-Fa-f+(])(?:" + "|".join([IPV6, IP, PHONE, CARD, SSN]) + rf")|(?=[A-Z]){IBAN}|(?=[{_FIRST}]){NAME})")
#: What a text must hold for ANY to match at all; one class of characters first, which a matcher scans for fast.
HINT = (rf"[@0-9:+{_FIRST}](?:(?<=@)|(?<=[0-9])[0-9][0-9]|(?<=[0-9])\.[0-9]|(?<=:)[0-9A-Fa-f:]|(?<=\+)[0-9]"
        rf"|(?<=[{_FIRST}])(?:{_REST})\.? )|[A-Z][0-9][0-9]")
PHONE_DIGITS = 7
#: Redraws after which a form gets longer, and redraws at most: a form of n digits then has over 10^(n + 30) values.
WIDEN, MAX_ATTEMPTS = 8, 40
# Consonants and vowels of generated names, and the endings of given names by gender.
SOUNDS = {"greek": ("βγδζκλμνπρστ", "αεηιου", {"m": "ος", "f": "α"}), "armenian": ("բգդզկլմնպրստ", "աեիոու", {"m": "ն", "f": "ա"})}


def _of(c: Column, i, n: int = 4) -> Column:
    """Number from the hash stream ``c`` (512 hex digits): ``n`` digits at the i-th place, wrapping."""
    i = F.lit(i) if isinstance(i, int) else i
    return F.conv(F.substr(c, (i * n) % 480 + 1, F.lit(n)), 16, 10).cast("int")


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """512 hex digits from the key, the entity and the attempt."""
    return F.concat(*[F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"), F.lit(str(n))), 256) for n in range(8)])


def _classwise(text: Column, s: Column, digits: bool = True) -> Column:
    """Each ASCII letter replaced by a letter of its case, each digit by a digit, others kept."""
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def one(c, i):
        r = _of(s, i)
        out = (F.when(F.instr(F.lit(low), c) > 0, F.substr(F.lit(low), r % 26 + 1, F.lit(1)))
               .when(F.instr(F.lit(up), c) > 0, F.substr(F.lit(up), r % 26 + 1, F.lit(1))))
        return out.when(F.instr(F.lit(num), c) > 0, F.substr(F.lit(num), r % 10 + 1, F.lit(1))).otherwise(c)

    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, one), "")


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    twice = F.transform(d, lambda x, i: F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x))
    return F.aggregate(twice, F.lit(0), lambda a, x: a + x)


def _pick(values: list[str], r: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), r % len(values) + 1)


def _syllables(script: Column, s: Column, n: Column) -> Column:
    def one(i):
        return F.when(script == "cyrillic", _pick(SYLLABLES["cyrillic"], _of(s, i + 1))).otherwise(_pick(SYLLABLES["latin"], _of(s, i + 1)))
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), "")).otherwise(F.lit(""))


def _sounds(script: str, s: Column, n: Column) -> Column:
    """``n`` syllables of a consonant and a vowel."""
    consonants, vowels, _ = SOUNDS[script]
    pick = lambda letters, r: F.substr(F.lit(letters), r % len(letters) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(pick(consonants, _of(s, 2 * i)), pick(vowels, _of(s, 2 * i + 1)))), "")


def mod97(text: Column) -> Column:
    """Remainder of an IBAN-like text read as digits, with letters as 10 to 35."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step)


def iban_rest(iban: Column) -> Column:
    """Remainder by 97 of an IBAN without spaces: 1 if its check digits are right."""
    return mod97(F.concat(F.substr(iban, F.lit(5), F.length(iban)), F.substr(iban, F.lit(1), F.lit(4))))


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Canonical surrogate of an entity; ``kind`` is email, ip, ipv6, iban, phone, card, ssn, surname:script or given:gender:script."""
    s = _stream(key, kind, canon, attempt)
    name, tld = F.regexp_extract(canon, r"^(.*)\.([^.]+)$", 1), F.regexp_extract(canon, r"^(.*)\.([^.]+)$", 2)
    local, domain = F.substring_index(name, "@", 1), F.substring_index(name, "@", -1)
    more = F.greatest(attempt - 1, F.lit(0))
    extra = F.when(more > 0, F.substring(_classwise(F.repeat(F.lit("a"), 40), F.reverse(s)), 1, 40)).otherwise(F.lit(""))
    email = F.concat(_classwise(local, s), F.substr(extra, F.lit(1), more), F.lit("@"), _classwise(domain, F.reverse(s)), F.lit("."), tld)
    wide = attempt > WIDEN

    def octet(o, i):
        r = F.conv(F.substr(s, i * 6 + 1, F.lit(6)), 16, 10).cast("int")
        return (F.when(wide, r % 256).when(F.length(o) == 1, r % 10).when(F.length(o) == 2, r % 90 + 10)
                .otherwise(r % 156 + 100)).cast("string")

    ip = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
    hexed = F.array_join(F.transform(F.filter(F.split(canon, ""), lambda c: c != ""),
                                     lambda c, i: F.when(c == ":", c).otherwise(F.substr(s, i * 3 + 1, F.lit(1)))), "")
    ipv6 = F.when(wide, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr(s, i * 4 + 1, F.lit(4))), ":")).otherwise(hexed)
    longer = F.when(wide, F.substr(F.translate(F.reverse(s), "abcdef", "012345"), F.lit(1), attempt - WIDEN)).otherwise(F.lit(""))
    drawn = F.concat(_classwise(canon, s), longer)
    body = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    check = ((F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.when(luhn_sum(canon) % 10 == 0, F.concat(body, check)).otherwise(drawn)
    lead = F.regexp_extract(canon, r"^\+[0-9]", 0)
    phone = F.concat(lead, F.substr(drawn, F.length(lead) + 1, F.length(drawn)))
    country, bban = F.substr(canon, F.lit(1), F.lit(2)), F.substr(drawn, F.lit(5), F.length(drawn))
    iban = F.concat(country, F.lpad((F.lit(98) - mod97(F.concat(bban, country, F.lit("00")))).cast("string"), 2, "0"), bban)
    script = F.substring_index(kind, ":", -1)
    gender = F.substring_index(F.substring_index(kind, ":", 2), ":", -1)
    given = None
    for g in GIVEN:
        for sc, pool in GIVEN[g].items():
            test, value = (gender == g) & (script == sc), _pick(pool, _of(s, 0))
            given = F.when(test, value) if given is None else given.when(test, value)
    given = F.concat(given, _syllables(script, s, attempt.cast("int")))
    surname = F.initcap(_syllables(script, s, F.lit(3) + attempt.cast("int")))
    for sc, (_, _, endings) in SOUNDS.items():
        for g, ending in endings.items():
            given = F.when((script == sc) & (gender == g), F.initcap(F.concat(_sounds(sc, s, F.lit(2) + attempt.cast("int")), F.lit(ending)))).otherwise(given)
        surname = F.when(script == sc, F.initcap(_sounds(sc, s, F.lit(3) + attempt.cast("int")))).otherwise(surname)
    return (F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", ipv6).when(kind == "iban", iban).when(kind == "card", card)
            .when(kind == "phone", phone).when(kind == "ssn", drawn).when(kind.startswith("given"), given).otherwise(surname))


def classified(found: DataFrame) -> DataFrame:
    """Mentions (..., raw) with kind, canon, gkind, gcanon: given names of persons in g-columns; kind is null where raw is no entity."""
    raw, digits = F.col("raw"), F.regexp_replace("raw", "[^0-9]", "")
    title = F.regexp_extract(raw, rf"^({TITLES})\.? ", 1)
    parts, solid = F.split(raw, " "), F.replace(raw, F.lit(" "), F.lit(""))
    last = F.element_at(parts, -1)
    script = F.lit("latin")
    for name in ("Cyrillic", "Greek", "Armenian"):
        script = F.when(last.rlike(rf"\p{{Is{name}}}"), name.lower()).otherwise(script)
    kind = (F.when(raw.contains("@"), "email").when(title != "", F.concat(F.lit("surname:"), script))
            .when(raw.contains(":"), "ipv6").when(raw.rlike("^[A-Z]"), F.when(iban_rest(solid) == 1, "iban"))
            .when(raw.rlike(r"^[0-9]+(\.[0-9]+){3}$"), "ip").when(raw.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when((F.length(digits) == 16) & ~raw.rlike("[+(]"), "card").when(F.length(digits) >= PHONE_DIGITS, "phone"))
    canon = (F.when(kind.isin("email", "ipv6"), F.lower(raw)).when(kind == "ip", raw).when(kind == "iban", solid)
             .when(title != "", last).when(raw.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits))
    has = (title != "") & (F.size(parts) > 2)
    gkind = F.when(has, F.concat(F.lit("given:"), F.when(title.isin(*FEMALE), "f").otherwise("m"), F.lit(":"), script))
    return found.select("*", kind.alias("kind"), F.when(kind.isNotNull(), canon).alias("canon"), gkind.alias("gkind"),
                        F.when(has, F.element_at(parts, 2)).alias("gcanon"))


def redrawn(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, attempt) of the entities whose first surrogate collided, with attempts that don't."""
    settled = stage(entities.withColumn("attempt", F.lit(0)), "pii-attempts")
    real = entities.select("kind", F.col("canon").alias("s")).withColumn("real", F.lit(True))
    for _ in range(MAX_ATTEMPTS):
        drawn = stage(settled.withColumn("s", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))), "pii-drawn")
        many = drawn.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon")).alias("owner"), F.count("*").alias("n"))
        bad = many.join(real, ["kind", "s"], "left").where("n > 1 or real").select("kind", "s", "owner", F.coalesce("real", F.lit(False)).alias("real"))
        bad = stage(bad, "pii-collisions")
        if bad.isEmpty():
            return drawn.where("attempt > 0").select("kind", "canon", "attempt")
        again = drawn.join(bad, ["kind", "s"], "left")
        lost = F.col("owner").isNotNull() & (F.col("real") | (F.col("owner.canon") != F.col("canon")))
        settled = stage(again.select("kind", "canon", (F.col("attempt") + F.when(lost, 1).otherwise(0)).alias("attempt")), "pii-attempts")
    raise ValueError(f"surrogates still collide after {MAX_ATTEMPTS} draws")


def _filled(raw: Column, signs: Column) -> Column:
    """``raw`` with its letters and digits replaced by ``signs`` in order; those left over follow."""
    chars = F.filter(F.split(raw, ""), lambda c: c != "")
    upto = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
    own = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(signs, upto(i), F.lit(1))).otherwise(c)), "")
    return F.concat(own, F.substr(signs, F.length(F.regexp_replace(raw, "[^A-Za-z0-9]", "")) + 1, F.length(signs)))


def _rendered(m: DataFrame, key: str) -> DataFrame:
    """Mentions (with attempt, gattempt) with new, the surrogate in the mention's own format, and for full names full and cover: the name alone and its surrogate."""
    kind, raw = F.col("kind"), F.col("raw")
    m = m.withColumn("s", surrogate(key, kind, F.col("canon"), F.coalesce("attempt", F.lit(0))))
    m = m.withColumn("g", F.when(F.col("gkind").isNotNull(), surrogate(key, F.col("gkind"), F.col("gcanon"), F.coalesce("gattempt", F.lit(0)))))
    title = F.regexp_extract(raw, rf"^(?:{TITLES})\.? ", 0)
    name = F.concat_ws(" ", "g", "s")
    email = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper("s")).otherwise(F.col("s"))
    new = (F.when(kind.isNull(), raw).when(kind == "email", email).when(kind.isin("ip", "ipv6"), F.col("s"))
           .when(kind.startswith("surname"), F.concat(title, name)).otherwise(_filled(raw, F.regexp_replace("s", "[^A-Za-z0-9]", ""))))
    full = F.when(F.col("g").isNotNull(), F.concat_ws(" ", "gcanon", "canon"))
    return m.select(*KEY, "i", new.alias("new"), kind.isNotNull().alias("entity"), full.alias("full"), F.when(full.isNotNull(), name).alias("cover"))


def _alone(full: Column) -> Column:
    return F.concat(F.lit(r"(?<!\p{L})"), full, F.lit(r"(?!\p{L})"))


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and n_entities."""
    raws = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    read = docs.select("*", *doc_key(text), F.coalesce(raws, F.array().cast("array<string>")).alias("__llm_raw"))
    read = stage(read, "pii-documents")
    hit = read.where(F.size("__llm_raw") > 0)
    found = hit.select(*KEY, F.posexplode("__llm_raw").alias("i", "raw")).distinct()
    found = stage(classified(found), "pii-mentions")
    names = found.where("gkind is not null").select(F.col("gkind").alias("kind"), F.col("gcanon").alias("canon"))
    entities = stage(found.where("kind is not null").select("kind", "canon").unionByName(names).distinct(), "pii-entities")
    other = redrawn(entities, key)
    m = found.join(other, ["kind", "canon"], "left")
    m = m.join(other.select(F.col("kind").alias("gkind"), F.col("canon").alias("gcanon"), F.col("attempt").alias("gattempt")), ["gkind", "gcanon"], "left")
    m = _rendered(m.repartition(shuffle_partitions(docs.sparkSession), *KEY, "i"), key)
    person = F.collect_set(F.when(F.col("full").isNotNull(), F.struct("full", "cover")))
    m = m.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("i", "new"))).alias("__llm_new"), F.sort_array(person).alias("__llm_names"),
                            F.sum(F.col("entity").cast("long")).alias("__llm_n"))
    m = stage(m, "pii-surrogates")
    j = hit.join(m, KEY, "left")
    between, persons = F.split(text, ANY, -1), F.col("__llm_names")

    def covered(p):
        return F.aggregate(persons, p, lambda acc, x: F.regexp_replace(acc, _alone(x["full"]), x["cover"]))

    pieces = F.zip_with(between, F.col("__llm_new"), lambda p, n: F.concat(covered(p), F.coalesce(n["new"], F.lit(""))))
    again = F.when(F.size(persons) > 0, F.aggregate(F.transform(between, lambda p: F.aggregate(
        persons, F.lit(0), lambda acc, x: acc + F.regexp_count(p, _alone(x["full"])))), F.lit(0), lambda a, b: a + b)).otherwise(0)
    done = j.select(*[F.array_join(pieces, "").alias(c) if c == text else F.col(c) for c in docs.columns], (F.col("__llm_n") + again).cast("long").alias("n_entities"))
    return read.where(F.size("__llm_raw") == 0).select(*docs.columns, F.lit(0).cast("long").alias("n_entities")).unionByName(done)


def query(docs: DataFrame, key: str = "surrogate-key") -> DataFrame:
    return replace(docs.select("doc_id", "text"), key).select("doc_id", "n_entities", "text")
