"""Surrogates for personal data, by DataFrame functions only.

One pattern finds e-mail addresses, secrets, bank and card numbers, telephone numbers, network addresses and names. Every
distinct entity of the corpus gets one keyed surrogate, so mentions of it stay the same entity in all documents. The
surrogate matches the kind and the format: digits stand where digits stood, separators and country codes stay, card
numbers keep or fail the Luhn check as before, addresses lie in ranges reserved for examples, names keep their title,
gender, script and case, also where a surname given in full before stands alone. Draws are checked against each other and
against the entities found; where two meet or one is real, all but the first draw again, until surrogates are as distinct
as entities. A format may have fewer surrogates than the corpus has entities, so from the draw ``WIDER_FROM`` on every
further one is a character longer (a network address: from a wider range), and the draws come to an end.

The key is the caller's secret: without it, surrogates tell nothing of what they stand for.

Texts are cut at the mentions and joined with the surrogates by rank, so nothing else changes. Null and empty texts and
texts without mentions pass unchanged; repeated rows get equal texts; all other columns stay as they are. Texts, and entities,
of any length are scanned whole, by patterns that need no recursion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windrose.llm.common import written

#: The draw from which on surrogates grow, and the most draws: by then they have 36 more places.
WIDER_FROM, MOST_DRAWS = 4, 40

# Titles and common given names, by gender.
TITLES = {"m": "Mr Sir Herr Señor Sr Monsieur Господин господин г-н", "f": "Mrs Ms Miss Madam Frau Señora Sra Señorita Madame Mme Mlle Госпожа госпожа г-жа"}
GIVEN = {
    "m": "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Peter Paul Hans Karl Jürgen Klaus Stefan Pierre Jean Jacques Luc François Carlos José Juan Miguel Pedro Luis Иван Пётр Сергей Алексей Дмитрий Николай",
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Maria Emma Julia Sabine Ursula Petra Claudia Marie Sophie Camille Chloé Isabelle Carmen Lucía Sofía Elena Isabel Ana Ольга Мария Анна Елена Наталья Ирина Светлана",
}
#: What syllables of surrogate names are made of, by script.
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou", "nrsl"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу", "нрсл")}

_ANY_TITLE = "|".join(t for x in TITLES.values() for t in x.split())
_GIVEN_NAMES = [n for x in GIVEN.values() for n in x.split()]
_ANY_GIVEN = "|".join(_GIVEN_NAMES)
_TOKEN = r"\p{Lu}[\p{L}'’]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
#: Between the groups of a telephone number; a space never leads into a network address.
_SEP = rf"(?:[.-]?|[ ](?!{_IPV4}))"
_HEAD = r"(?<![\p{L}\p{N}._%+-])"
#: In the order in which they are tried at a place. A repeated group is bounded or possessive: Java matches any other one by
#: recursion, which a long text would exhaust.
PATTERNS = {
    "email": _HEAD + r"[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?<![0-9A-Za-z_-])(?:[0-9a-fA-F]{32,}+|AKIA[0-9A-Z]{16}|(?:ghp_|sk-|xox[abp]-)[0-9A-Za-z-]{16,})(?![0-9A-Za-z])|(?<=[=:\s\"'])(?=[0-9A-Za-z+/_=-]{8})(?<=(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[0-9A-Za-z+/_=-]{8,}",
    #: In full, or with one run of zeros left out and a digit or a full group, as "a::b" is rather a name in a program.
    "ipv6": r"(?<![0-9A-Za-z_:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]{2,39}+)(?=[A-Fa-f:]*(?:\d|(?<=[A-Fa-f]{4})))(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)(?![0-9A-Za-z_:]|\.\d)",
    "mac": r"(?<![0-9A-Fa-f:-])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:-])",
    "ipv4": rf"(?<![\d.]){_IPV4}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    #: Unbroken, or in the groups that issuers print; a fifth group only where the issuer's numbers have 19 digits.
    "card": rf"(?<![\d.-])\d(?:\d{{12,18}}|\d{{3}}(?:(?:[ -]\d{{4}}){{3}}|[ -]\d{{6}}[ -]\d{{4,5}}|(?:[ -]\d{{3}}){{3}}|[ -]\d{{4}}[ -]\d{{5}})|\d{{5}}[ -]\d{{13}})(?:(?<=(?:5[0678]|6[2379])\d\d[ -]\d{{4}}[ -]\d{{4}}[ -]\d{{4}})[ -](?!{_IPV4})\d{{3}})?(?![\d-])",
    #: By format where the country's is known, so that a number that follows stays out; then any groups.
    "phone": rf"(?<![\p{{L}}\d.-])(?:\+(?:33[ .-]?(?:\(0\)[ .-]?)?[1-9](?:[ .-]?\d{{2}}){{4}}|1[ .-]?(?:\(\d{{3}}\)|\d{{3}})[ .-]?\d{{3}}[ .-]?\d{{4}}|\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?(?:\d{{2,4}}[ .-]\d{{5,8}}|\d{{2,4}}(?:{_SEP}\d{{2,4}}){{1,3}}))|\(\d{{2,4}}\)[ .-]?\d{{3,4}}{_SEP}\d{{3,4}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}|0[1-9](?:(?:[ .-]\d{{2}}){{4}}|\d{{0,3}}[ /-]\d{{6,8}}|\d[ -]\d{{4}}[ -]\d{{4}}|\d{{2,3}}[ -]\d{{3}}[ -]\d{{3,4}}))(?![\d-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?=[\p{{Lu}}г])(?:(?:{_ANY_TITLE})\.?\s{_TOKEN}(?:[ -]{_TOKEN}){{0,2}}|(?:{_ANY_GIVEN})(?:[ -](?:{_ANY_GIVEN})(?![\p{{L}}\p{{N}}])){{0,3}}(?:[ -]{_TOKEN}){{0,2}}(?![\p{{L}}\p{{N}}]))",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What only secrets and names can do without: a digit, an at sign, a colon, or the hyphens of a network card's address.
GUARD = r"[0-9@:]|(?:-[A-Fa-f]{2}){5}"
UNGUARDED = "|".join(f"(?:{PATTERNS[k]})" for k in ("secret", "name"))
# Surnames that are verbs before these words, and months after those.
VERBS, SUBJECTS = "Will|May|Can|Do", "I|we|you|he|she|it|they|the|this|that|there|these|those|anyone|anybody|everyone|my|your|his|her|our|their|not"
MONTHS, BEFORE_MONTHS = "March|April|May|June|August", "in|In|of|by|By|since|Since|until|Until|early|late|last|next|this|On|on"
ORDINARY = rf"(?!(?:{VERBS})\s(?:{SUBJECTS})(?!\p{{L}}))(?!(?<=\b(?:{BEFORE_MONTHS})\s)(?:{MONTHS})(?!\p{{L}}))"
#: Stands at both ends of a mention while a text is cut; texts that hold it are cut another way.
MARK = "\x01"
_LATIN, _HEX = "abcdefghijklmnopqrstuvwxyz", "abcdef"


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte, from 0, of a hexadecimal stream of 64."""
    return F.conv(F.substring(stream, 2 * F.pmod(i, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), 1 + F.pmod(number, F.lit(len(letters))), F.lit(1))


def _chars(text: Column, fn) -> Column:  # noqa: ANN001
    """``text`` with every character replaced by fn(character, place from 0)."""
    return F.array_join(F.transform(F.split(text, ""), fn), "")


def _same_kind(letters: str, stream: Column):  # noqa: ANN202
    """Digits to digits, small letters to small letters, capitals to capitals; others stay."""

    def fn(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        small = _pick(letters, n)
        return F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(small)).when(c.rlike(r"\p{L}"), small).otherwise(c)

    return fn


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.element_at(F.array(*map(F.lit, [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0, 2, 4, 6, 8, 1, 3, 5, 7, 9])), 1 + F.substring(digits, -i, F.lit(1)).cast("int") + 10 * F.pmod(i - 1, F.lit(2)).cast("int")))
    return F.pmod(total, F.lit(10))


def _name(script: str, ending: Column, stream: Column, syllables: Column) -> Column:
    """A made-up word of the script: syllables, then the gender's ending."""
    onset, vowel, coda = SYLLABLES[script]
    body = F.array_join(F.transform(F.sequence(F.lit(0), syllables - 1), lambda i: F.concat(_pick(onset, _byte(stream, 2 * i)), _pick(vowel, _byte(stream, 2 * i + 1)))), "")
    last = _byte(stream, F.lit(60))
    end = F.when(ending == "f", F.concat(_pick(onset, last), F.substring(F.lit(vowel), 1, 1))).when(ending == "m", F.concat(_pick(onset, last), F.substring(F.lit(vowel), 4, 1), _pick(coda, last))).otherwise(F.concat(_pick(vowel, last), _pick(coda, last)))
    return F.initcap(F.concat(body, end))


def key_stream(kind: Column, canonical: Column, attempt: int, key: str) -> Column:
    """What a draw takes its bytes from."""
    return F.sha2(F.concat_ws("\x01", F.lit(key), kind, canonical, F.lit(str(attempt))), 512)


def surrogate(kind: Column, canonical: Column, attempt: int, stream: Column, key: str) -> Column:
    """The keyed draw number ``attempt`` for an entity; ``stream`` is its ``key_stream``."""
    more = F.lit("0" * max(0, attempt + 1 - WIDER_FROM))
    wide = F.concat(canonical, more)
    same = _chars(wide, _same_kind(_LATIN, stream))
    as_hex = _chars(wide, _same_kind(_HEX, stream))
    local, domain = F.split_part(canonical, F.lit("@"), F.lit(1)), F.split_part(canonical, F.lit("@"), F.lit(2))
    email = F.concat(_chars(F.concat(local, more), _same_kind(_LATIN, stream)), F.lit("@d"), F.substring(F.sha2(F.concat_ws("\x01", F.lit(key), F.lit("domain"), domain), 256), 1, 10), F.lit(".example"))
    #: The last digit makes the sum right or wrong as it was.
    body = F.substring(same, F.lit(1), F.length(same) - 1)
    check = F.pmod(10 - _luhn(F.concat(body, F.lit("0"))) + F.when(_luhn(canonical) == 0, 0).otherwise(1 + F.pmod(_byte(stream, F.lit(63)), F.lit(9))), F.lit(10))
    first = 240 + F.pmod(_byte(stream, F.lit(0)), F.lit(15)) if attempt < WIDER_FROM else _byte(stream, F.lit(0))
    ipv4 = F.concat_ws(".", first.cast("string"), *(_byte(stream, F.lit(i)).cast("string") for i in (1, 2, 3)))
    for_examples = F.concat(F.lit("2001:db8:"), F.concat_ws(":", *(F.substring(stream, i, 4) for i in (1, 5, 9))), F.lit("::"), F.substring(stream, 13, 4))
    if attempt >= 2 * WIDER_FROM:
        ipv4 = for_examples
    kept = F.when(F.substring(canonical, 1, 1).isin("1", "7"), 1).otherwise(2)
    #: The leading 0 of a national number stays.
    national = F.when(canonical.startswith("0"), F.concat(F.lit("0"), F.substring(same, F.lit(2), F.length(same)))).otherwise(same)
    #: Addresses with zeros left out have too few places for distinct draws; theirs lie in the range for examples.
    ipv6 = F.when(canonical.contains("::"), for_examples).otherwise(as_hex)
    dialled = F.concat(F.substring(canonical, F.lit(1), kept), F.substring(same, kept + 1, F.length(same)))
    iban = F.concat(F.substring(canonical, 1, 2), F.substring(same, F.lit(3), F.length(same)))
    names = F.lit(None).cast("string")
    for script in SYLLABLES:
        for role, ending in (("given_m", "m"), ("given_f", "f"), ("given_n", "n"), ("surname", "n")):
            names = F.when(kind == f"{role}_{script}", _name(script, F.lit(ending), stream, F.lit(min(20, 2 + attempt)))).otherwise(names)
    drawn = F.when(kind == "email", email).when(kind == "ipv6", ipv6).when(kind == "mac", as_hex)
    drawn = drawn.when(kind == "secret", F.when(canonical.rlike("^[0-9a-fA-F]+$"), as_hex).otherwise(same)).when(kind == "ipv4", ipv4).when(kind == "card", F.concat(body, check.cast("string")))
    return drawn.when(kind == "phone_country", dialled).when(kind == "iban", iban).when(kind == "phone", national).when(kind == "ssn", same).otherwise(names)


def marked(inside: Column) -> Column:
    """The text cut at its mentions: texts between mentions at even places, mentions at odd ones."""
    short, whole = (F.regexp_replace(inside, p, f"{MARK}$0{MARK}") for p in (UNGUARDED, PATTERN))
    cut = F.split(F.when(inside.rlike(GUARD), whole).otherwise(short), MARK, -1)
    pieces, matches = F.split(inside, PATTERN, -1), F.regexp_extract_all(inside, F.lit(PATTERN), F.lit(0))
    slow = F.flatten(F.transform(pieces, lambda p, i: F.when(i < F.size(matches), F.array(p, F.get(matches, i))).otherwise(F.array(p))))
    return F.when(inside.contains(MARK), slow).otherwise(cut)


def _every_second(parts: str, first: int) -> Column:
    return F.filter(parts, lambda x, i: F.pmod(i, F.lit(2)) == first)


def _with_surnames(parts: str, surnames: str) -> Column:
    """``parts`` also cut at surnames that stand alone and are no ordinary words there. A mention's ends also end words."""
    alone = F.concat(F.lit(rf"(?<![\p{{L}}\p{{N}}]){ORDINARY}(?:"), F.array_join(surnames, "|"), F.lit(r")(?![\p{L}\p{N}])"))

    def cut(p: Column, i: Column) -> Column:
        pieces, matches = F.split(p, alone, -1), F.regexp_extract_all(p, alone, F.lit(0))
        both = F.flatten(F.transform(pieces, lambda x, k: F.when(k < F.size(matches), F.array(x, F.get(matches, k))).otherwise(F.array(x))))
        return F.when(F.pmod(i, F.lit(2)) == 0, both).otherwise(F.array(p))

    return F.flatten(F.transform(parts, cut))


def mentions(found: DataFrame) -> DataFrame:
    """(uid, at, part, kind, canonical, raw): the parts of every mention; parts without kind stay as they are."""
    raw = F.col("raw")
    #: What only the words before it give away is a secret; a bare name is one that the text also gives in full.
    kind = F.when(raw.rlike(rf"^(?:{PATTERNS['name']})$") | F.array_contains("surnames", raw), "name").otherwise("secret")
    for k in reversed([k for k in PATTERNS if k not in ("name", "secret")]):
        kind = F.when(raw.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(kind)
    rows = found.select("uid", "surnames", F.posexplode("matches").alias("at", "raw")).withColumn("kind", kind)
    digits = F.regexp_replace(raw, "[^0-9]", "")
    plain = F.when(F.col("kind") == "email", F.lower(raw)).when(F.col("kind").isin("ssn", "card", "phone"), digits).when(F.col("kind") == "iban", F.regexp_replace(raw, " ", "")).when(F.col("kind").isin("ipv6", "mac"), F.lower(raw)).otherwise(raw)
    exact = F.when((F.col("kind") == "phone") & raw.startswith("+"), F.lit("phone_country")).otherwise(F.col("kind"))
    single = F.array(F.struct(exact.alias("kind"), plain.alias("canonical"), raw.alias("raw")))

    title = F.regexp_extract(raw, rf"^(?:{_ANY_TITLE})\.?\s", 0)
    words = F.split(F.expr("substring(raw, length(_title) + 1)"), "(?<=[ -])|(?=[ -])")
    gender = F.coalesce(*(F.when(F.regexp_replace("_title", r"[.\s]", "").isin(*TITLES[g].split()), F.lit(g)) for g in TITLES), *(F.when(F.element_at("_words", 1).isin(*GIVEN[g].split()), F.lit(g)) for g in GIVEN), F.lit("n"))
    n_names = F.expr("size(filter(_words, w -> w not in (' ', '-')))")
    #: Of several names the last is the surname, and so are those before it outside the given names, but the first; a single
    #: one is a surname after a title or outside the given names.
    parts = F.transform("_words", lambda w, i: F.struct(
        F.when(w.isin(" ", "-"), F.lit(None)).otherwise(F.concat(F.when((i == F.size("_words") - 1) & ((F.col("_n") > 1) | (F.length("_title") > 0) | (F.col("_gender") == "n")) | (i > 0) & ~w.isin(*_GIVEN_NAMES), F.lit("surname")).otherwise(F.concat(F.lit("given_"), F.col("_gender"))), F.when(w.rlike(r"\p{IsCyrillic}"), F.lit("_cyrillic")).otherwise(F.lit("_latin")))).alias("kind"),
        F.lower(w).alias("canonical"), w.alias("raw")))
    names = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.col("_title").alias("canonical"), F.col("_title").alias("raw"))), parts)
    rows = rows.withColumn("_title", F.when(F.col("kind") == "name", title).otherwise("")).withColumn("_words", words).withColumn("_gender", gender).withColumn("_n", n_names)
    return rows.select("uid", "at", F.posexplode(F.when(F.col("kind") == "name", names).otherwise(single)).alias("part", "x")).select("uid", "at", "part", "x.*")


def entity_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) of distinct entities, surrogates distinct within their kind and never an entity."""
    real = written(entities.select("kind", "canonical"), "entities")
    pending, settled = real, None
    for attempt in range(MOST_DRAWS):
        stream = key_stream(F.col("kind"), F.col("canonical"), attempt, key)
        drawn = pending.withColumn("stream", stream).select("kind", "canonical", surrogate(F.col("kind"), F.col("canonical"), attempt, F.col("stream"), key).alias("surrogate"))
        #: Of those that meet one stays, whatever their number.
        good = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).withColumn("drawn", F.lower("surrogate"))
        good = good.join(real.select("kind", F.lower("canonical").alias("drawn")), ["kind", "drawn"], "left_anti").drop("drawn")
        if settled is not None:
            good = good.join(settled, ["kind", "surrogate"], "left_anti")
        good = written(good.select("kind", "canonical", "surrogate"), "drawn")
        settled = good if settled is None else settled.unionByName(good)
        pending = written(pending.join(good, ["kind", "canonical"], "left_anti"), "pending")
        if pending.isEmpty():
            return settled
    raise RuntimeError(f"surrogates still meet after {MOST_DRAWS} draws")


def _formatted(kind: Column, raw: Column, drawn: Column) -> Column:
    """The surrogate in the mention's own format."""
    spaced = _chars(raw, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(drawn, F.length(F.regexp_replace(F.substring(raw, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c))
    #: What a surrogate has beyond the mention's own places.
    beyond = F.substring(drawn, F.length(F.regexp_replace(raw, "[^0-9A-Za-z]", "")) + 1, F.length(drawn))
    cased = F.when((raw == F.upper(raw)) & (raw != F.lower(raw)) & (F.length(raw) > 1), F.upper(drawn)).otherwise(drawn)
    return F.when(kind.isin("ssn", "card", "phone", "phone_country", "iban"), F.concat(spaced, beyond)).when(kind.isin("secret", "ipv4"), drawn).otherwise(cased)


def replaced(docs: DataFrame, key: str, text: str = "text", count_as: str | None = "n_entities") -> DataFrame:
    """The documents with surrogates in place of personal data; ``count_as`` names a column with the number of mentions."""
    names = docs.columns
    inside = F.col(text).cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), marked(inside).alias("parts"))
    rows = written(rows.withColumn("doc", F.col("doc").withField(text, F.lit(""))), "marked")
    found = rows.filter("size(parts) > 1")
    matches = _every_second("parts", 1)
    called = F.filter("matches", lambda m: m.rlike(rf"^(?:(?:{_ANY_TITLE})\.?\s|(?:{_ANY_GIVEN})[ -])\p{{L}}"))
    said_names = F.transform(called, lambda m: F.split(F.regexp_replace(m, rf"^(?:{_ANY_TITLE})\.?\s", ""), "[ -]"))
    surnames = F.array_distinct(F.flatten(F.transform(said_names, lambda x: F.filter(x, lambda w, i: (i == F.size(x) - 1) | (i > 0) & ~w.isin(*_GIVEN_NAMES)))))
    found = found.withColumn("matches", matches).withColumn("surnames", surnames).withColumn("parts", F.when(F.size("surnames") > 0, _with_surnames("parts", "surnames")).otherwise(F.col("parts")))
    found = written(found.select("uid", "doc", _every_second("parts", 0).alias("pieces"), _every_second("parts", 1).alias("matches"), "surnames"), "found")
    parts = written(mentions(found), "mentions")
    drawn = entity_surrogates(parts.filter("kind IS NOT NULL").select("kind", "canonical").distinct(), key)
    said = parts.filter("kind IS NOT NULL").join(drawn, ["kind", "canonical"]).select("uid", "at", "part", _formatted(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("said")).unionByName(parts.filter("kind IS NULL").select("uid", "at", "part", F.col("raw").alias("said")))
    whole = said.groupBy("uid", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "said"))), lambda x: x["said"]), "").alias("said"))
    lists = whole.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "said"))), lambda x: x["said"]).alias("said"))
    joined = F.array_join(F.zip_with("pieces", "said", lambda p, q: F.concat(p, F.coalesce(q, F.lit("")))), "")
    changed = found.join(lists, "uid").select(F.col("doc").withField(text, joined).alias("doc"), F.size("matches").cast("bigint").alias("n"))
    clean = rows.filter("coalesce(size(parts), 0) <= 1").select(F.col("doc").withField(text, F.get("parts", F.lit(0))).alias("doc"), F.lit(0).cast("bigint").alias("n"))
    out = clean.unionByName(changed)
    return out.select(*(F.col("doc")[c].alias(c) for c in names), *([F.col("n").alias(count_as)] if count_as else []))
