"""PII: format-preserving pseudonyms by a keyed Feistel network, in DataFrame expressions throughout.

One pattern finds candidates, each is validated by its kind, and what is valid is permuted within its format:
card numbers (Luhn) keep length, grouping and first digit and get a right check digit; account numbers (IBAN, mod 97)
keep country, letters and grouping and get right check digits; phone numbers keep their form and country code; North
American ones and social security numbers stay valid where they were; IPv4 addresses and dates (1900 to 2099) stay
addresses and dates. A permutation is a bijection fixed by the key, so equal values stay equal in all documents,
different ones stay different, and the holder of the key can undo it (``undo=True``). Mail addresses and secrets have
no format worth permuting: they become keyed digests of their form. What fails its validation is left as it is.

Each text is handled in its own row, with no shuffle.

Defined cases: null texts stay null with count 0, empty ones empty; texts without a match are returned as they are. No
pattern is tried twice over one run of characters, so texts of any length take time in proportion, with a bounded
stack. Repeated rows give repeated results; ``n_private`` replaces an input column of that name, and other columns may
have any names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
MARK = "\x01"
# Patterns of the candidates (Java syntax).
# A mail address has the lengths of the standard (64 characters, 63 a label, 127 labels). No part of it is tried twice,
# and it starts where a run of its characters does, or 64 of them further on: long runs take time in proportion.
_BOX = r"[A-Za-z0-9._%+\-]"
MAIL = rf"(?:(?<!{_BOX})|(?<={_BOX}{{64}})){_BOX}{{1,64}}+@[A-Za-z0-9\-]{{1,63}}+(?:\.[A-Za-z0-9\-]{{1,63}}+){{1,126}}+"
ACCESS_KEY = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
# A value without a digit counts after an equals sign only: prose has colons.
SECRET = (r"(?i:\b(?:password|passwd|pwd|secret|token|api[_\-]?key)\b)\s{0,3}(?:=\s{0,3}[\"']?|:\s{0,3}[\"']?"
          r"(?=[A-Za-z_\-/+.]{0,64}[0-9]))[A-Za-z0-9_\-/+.]{8,}+[\"']?")
# Country, check digits and up to 30 letters and digits, in one run or in fours.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3}(?![A-Za-z0-9]))?)(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?=[0-9])(?<!(?i:version|release|build|ver|v)[ .]{{0,2}})(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])"
ISO_DATE = r"(?<![0-9\-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9\-])"
US_DATE = r"(?<![0-9/])[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2}(?![0-9/])"
SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
# North American numbers: any ten digits where +1 or brackets mark a phone, else area code and exchange from 200 up.
BARE_PHONE = r"(?<![0-9])(?:1[ .\-]?)?[2-9][0-9]{2}[ .\-][2-9][0-9]{2}[ .\-][0-9]{4}(?![0-9])"
US_PHONE = (r"(?<![0-9])(?:\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}"
            r"|(?:1[ .\-]?)?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4})(?![0-9])|" + BARE_PHONE)
# Numbers of other countries: the code, perhaps a trunk zero in brackets, and at most the digits of the country's plan,
# or else of any plan. A separator before another private value ends them.
COUNTRY = r"(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|5[09]|6[7-9]|8[05789]|9[679])[0-9])"
TRUNK = r"(?:[ .\-]?\(0\))?"
PLANS = {"45|47|65|852": 8, "27|3[1-4]|4[0168]|56|61|66|351|353|380|420|966|971|972": 9,
         "7|20|30|44|5[127]|6[034]|8[124]|9[0-58]": 10, "39|5[45]|86": 11, COUNTRY: 13}
_AFTER = "|".join([MAIL, IPV4, ISO_DATE, US_DATE, SSN, BARE_PHONE])
_STEP = rf"\)?(?:[ .\-](?!{_AFTER}))?\(?[0-9]"
ABROAD = r"(?<![0-9])\+(?:" + "|".join(
    rf"(?:{codes}){TRUNK}(?:{_STEP}){{6,{most}}}(?![0-9])" for codes, most in PLANS.items()) + ")"
PHONE = f"{US_PHONE}|{ABROAD}"
# A whole run of digit groups, in which cards are looked for; a separator before another private value ends it.
CARD = rf"(?<![0-9])[0-9](?:(?:[ \-](?!{_AFTER}))?[0-9]){{12,}}+"
CARD_DIGITS = "^(?:2[2-7]|[3-6])[0-9]{11,17}[0-9]$"
#: The groupings that cards are printed in; others count where none of these is valid.
USUAL = r"^(?:[0-9]{13,19}|[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ \-])[0-9]{6}\2[0-9]{4,5})$"
KINDS = [MAIL, ACCESS_KEY, SECRET, IBAN, IPV4, ISO_DATE, US_DATE, SSN, PHONE, CARD]
ANY = "|".join(KINDS)
#: Every candidate has one of these.
HINT = "[0-9@=]|AKIA|ASIA"
DAYS = (17, 4297)  # 17 * 4297 days from 1900 to 2099
FIRST_DAY = "1900-01-01"


def _keyed(key: str, *parts: Column) -> Column:
    """60 bits of a keyed digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 15), 16, 10).cast("bigint")


def feistel(left: Column, a: Column | int, right: Column, b: Column | int, key: str, tweak: str, undo: bool = False) -> Column:
    """A keyed bijection of pairs (left below ``a``, right below ``b``): a struct of ``l`` and ``r``."""
    a, b = (x if isinstance(x, Column) else F.lit(x).cast("bigint") for x in (a, b))
    sign = -1 if undo else 1

    def turn(s: Column, i: Column) -> Column:
        l2 = F.pmod(s["l"] + sign * F.pmod(_keyed(key, F.lit(tweak), i.cast("string"), s["r"].cast("string")), a), a)
        r2 = F.pmod(s["r"] + sign * F.pmod(_keyed(key, F.lit(tweak), i.cast("string"), s["l"].cast("string")), b), b)
        odd = i % 2 == 1
        return F.struct(F.when(odd, l2).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise(r2).alias("r"))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if undo else F.sequence(F.lit(1), F.lit(ROUNDS))
    return F.aggregate(rounds, F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), turn)


def _zeros(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), n if isinstance(n, Column) else F.lit(n), F.lit("0"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced by those of ``digits``, in order."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("t"))

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct((s["i"] + is_digit.cast("int")).alias("i"),
                        F.concat(s["t"], F.when(is_digit, F.substr(digits, s["i"] + 1, F.lit(1))).otherwise(c)).alias("t"))

    return F.aggregate(F.split(form, ""), start, put)["t"]


def luhn_digit(payload: Column) -> Column:
    """The check digit that closes a string of digits."""
    back = F.reverse(payload)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.pmod(10 - F.pmod(F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add), F.lit(10)), F.lit(10))


def _permuted(d: Column, key: str, tweak: str, undo: bool = False) -> Column:
    """A string of digits permuted among all of its length."""
    half = F.floor(F.length(d) / 2).cast("int")
    other = F.length(d) - half
    p = feistel(F.substr(d, F.lit(1), half), F.pow(F.lit(10.0), half).cast("bigint"),
                F.substr(d, half + 1, other), F.pow(F.lit(10.0), other).cast("bigint"), key, tweak, undo)
    return F.concat(_zeros(p["l"], half), _zeros(p["r"], other))


def card_number(m: Column, key: str, undo: bool = False) -> Column:
    """One card under its pseudonym: the first digit stays (two of those that begin with 2), the check digit is right."""
    d = _digits(m)
    n = F.length(d)
    stay = F.when(d.startswith("2"), 2).otherwise(1)
    new = F.concat(F.substr(d, F.lit(1), stay), _permuted(F.substr(d, stay + 1, n - 1 - stay), key, "card", undo))
    return _refilled(m, F.concat(new, luhn_digit(new).cast("string")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cards(m: Column, key: str) -> Column:
    """A run of digit groups with every card in it under its pseudonym (``t``), and how many there are (``n``).

    A card is made of whole groups. Those of a usual grouping come first, then other ones that hold none of them; of
    several from one group on, the longest.
    """
    def run(groups: Column) -> Column:
        n = F.size(groups)
        text = lambda i, j: F.regexp_replace(F.array_join(F.slice(groups, i, j - i + 1), ""), r"[ \-]$", "")

        def ends(i: Column, usual: bool) -> Column:
            """The last group of each card from group i on (both count from 1), longest first."""
            def is_card(j: Column) -> Column:
                def fits(t: Column) -> Column:
                    d = _digits(t)
                    luhn = luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)).cast("string") == F.right(d, F.lit(1))
                    form = t.rlike(USUAL) if usual else F.lit(True)
                    return F.when(form & d.rlike(CARD_DIGITS), luhn).otherwise(False)

                return _let(text(i, j), fits)

            last = F.least(n, i + (4 if usual else 18))
            return F.reverse(F.filter(F.sequence(i, last), is_card))

        def chosen(known: Column) -> Column:
            """First and last group of each card, none overlapping, in order. The state grows by cards, not by text."""
            def step(s: Column, i: Column) -> Column:
                mine = F.get(known, i - 1)
                free = lambda j: ~F.exists(F.slice(known, i, j - i + 1), lambda e: e > 0)
                end = F.when(i <= s["done"], 0).when(mine > 0, mine).otherwise(
                    F.coalesce(F.get(F.filter(ends(i, False), free), F.lit(0)), F.lit(0)))
                return _let(end, lambda e: F.when(e > 0, F.struct(e.alias("done"), F.array_append(
                    s["cards"], F.struct(i.alias("a"), e.alias("b"))).alias("cards"))).otherwise(s))

            start = F.struct(F.lit(0).alias("done"), F.array().cast("array<struct<a:int,b:int>>").alias("cards"))
            return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["cards"])

        def put(cards: Column) -> Column:
            between = lambda a, b: F.array_join(F.slice(groups, a, F.greatest(b - a + 1, F.lit(0))), "")

            def piece(c: Column, k: Column) -> Column:
                before = F.coalesce(F.get(cards, k - 1)["b"], F.lit(0))
                tail = F.regexp_extract(F.get(groups, c["b"] - 1), r"[ \-]$", 0)
                return F.concat(between(before + 1, c["a"] - 1), _let(text(c["a"], c["b"]), lambda t: card_number(t, key)), tail)

            last = F.coalesce(F.get(cards, F.size(cards) - 1)["b"], F.lit(0))
            whole = F.concat(F.array_join(F.transform(cards, piece), ""), between(last + 1, n))
            return F.struct(whole.alias("t"), F.size(cards).alias("n"))

        first = F.transform(F.sequence(F.lit(1), n), lambda i: F.coalesce(F.get(ends(i, True), F.lit(0)), F.lit(0)))
        return _let(_let(first, chosen), put)

    return _let(F.regexp_extract_all(m, F.lit(r"[0-9]+[ \-]?"), F.lit(0)), run)


def phone(m: Column, key: str, undo: bool = False) -> Column:
    """All ten digits are permuted; area codes and exchanges from 200 up stay so, and those below stay below."""
    d = _digits(m)
    own = F.substr(d, F.length(d) - 9, F.lit(10))
    part = lambda a, n: F.substr(own, F.lit(a), F.lit(n)).cast("bigint")
    least = lambda x: F.when(x < 200, 0).otherwise(200)
    count = lambda x: F.when(x < 200, 200).otherwise(800).cast("bigint")
    area, exchange = part(1, 3), part(4, 3)
    p = feistel(area - least(area), count(area), (exchange - least(exchange)) * 10000 + part(7, 4),
                count(exchange) * 10000, key, "phone", undo)
    new = F.concat(_zeros(p["l"] + least(area), 3), _zeros(F.floor(p["r"] / 10000) + least(exchange), 3),
                   _zeros(p["r"] % 10000, 4))
    return _refilled(m, F.concat(F.substr(d, F.lit(1), F.length(d) - 10), new))


def phone_abroad(m: Column, key: str, undo: bool = False) -> Column:
    """The country code and a trunk zero stay, all other digits are permuted."""
    head = F.regexp_extract(m, rf"^\+{COUNTRY}{TRUNK}", 0)
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    return F.concat(head, _refilled(rest, _permuted(_digits(rest), key, "phone", undo)))


def social_security(m: Column, key: str, undo: bool = False) -> Column:
    area, group, serial = (F.substr(m, F.lit(a), F.lit(n)).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    p = feistel(area - F.when(area > 666, 2).otherwise(1), 898, (group - 1) * 9999 + serial - 1, 99 * 9999, key, "ssn", undo)
    back = p["l"] + F.when(p["l"] >= 665, 2).otherwise(1)
    new = F.concat_ws("-", _zeros(back, 3), _zeros(F.floor(p["r"] / 9999) + 1, 2), _zeros(p["r"] % 9999 + 1, 4))
    return F.when(valid, new).otherwise(m)


def _mod97(text: Column) -> Column:
    """Remainder of letters and digits by 97, a letter being two digits (A is 10)."""
    def step(r: Column, c: Column) -> Column:
        letter = c.rlike("^[A-Z]$")
        return F.when(letter, r * 100 + F.ascii(c) - 55).otherwise(r * 10 + F.ascii(c) - 48) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(step(r, c)).cast("int"))


def iban(m: Column, key: str, undo: bool = False) -> Column:
    """Country and letters stay, the digits of the account are permuted and the check digits are right; null if it is not valid."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    body, country = F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(2))
    valid = (_mod97(F.concat(body, F.substr(plain, F.lit(1), F.lit(4)))) == 1) & F.length(_digits(body)).between(2, 30)

    def renewed(account: Column) -> Column:
        check = _zeros(98 - _mod97(F.concat(F.replace(account, F.lit(" "), F.lit("")), country, F.lit("00"))), 2)
        return F.concat(country, check, account)

    new = _let(_refilled(F.substr(m, F.lit(5), F.length(m)), _long_permuted(_digits(body), key, "iban", undo)), renewed)
    return F.when(valid, new)


def _long_permuted(d: Column, key: str, tweak: str, undo: bool) -> Column:
    """Up to 30 digits: the first 15 and the others permuted by themselves, each under a tweak of its own."""
    head, tail = F.substr(d, F.lit(1), F.lit(15)), F.substr(d, F.lit(16), F.lit(15))
    short = F.length(tail)
    return F.concat(_permuted(head, key, tweak + "1", undo), F.when(short > 1, _permuted(tail, key, tweak + "2", undo)).otherwise(tail))


def address(m: Column, key: str, undo: bool = False) -> Column:
    o = F.split(m, r"\.")
    at = lambda i: F.get(o, F.lit(i)).cast("bigint")
    p = feistel(at(0) * 256 + at(1), 65536, at(2) * 256 + at(3), 65536, key, "ip", undo)
    return F.concat_ws(".", *[x.cast("bigint").cast("string") for s in ("l", "r") for x in (F.floor(p[s] / 256), p[s] % 256)])


def masked_days(day: Column, key: str, undo: bool = False) -> Column:
    """A date from 1900 to 2099 permuted among them."""
    n = F.date_diff(day, F.lit(FIRST_DAY).cast("date")).cast("bigint")
    p = feistel(F.floor(n / DAYS[1]), DAYS[0], n % DAYS[1], DAYS[1], key, "date", undo)
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int"))


def unmasked_days(day: Column, key: str) -> Column:
    return masked_days(day, key, undo=True)


def _date(m: Column, form: str, key: str) -> Column:
    day = F.try_to_timestamp(m, F.lit(form)).cast("date")
    return F.when(day.isNotNull(), F.date_format(masked_days(day, key), form)).otherwise(m)


def pseudonym(m: Column, key: str) -> Column:
    """A struct: one candidate with its values under their pseudonyms, itself where none is valid (``t``), and how many (``n``)."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lower(m)), 256)
    value = F.regexp_extract(m, r"[=:]\s*[\"']?([A-Za-z0-9_\-/+.]+)[\"']?$", 1)
    secret = F.sha2(F.concat_ws("|", F.lit(key), value), 512)
    whole = lambda p: m.rlike(f"^(?:{p})$")
    one = (
        F.when(whole(MAIL), F.concat(F.lit("u"), F.substring(digest, 1, 12), F.lit("@h"), F.substring(digest, 13, 6), F.lit(".invalid")))
        .when(whole(ACCESS_KEY), F.concat(F.substring(m, 1, 4), F.upper(F.substring(digest, 1, 16))))
        .when(whole(SECRET), F.replace(m, value, F.substr(F.repeat(secret, F.ceil(F.length(value) / 128).cast("int")),
                                                         F.lit(1), F.length(value))))
        .when(whole(IBAN), F.coalesce(iban(m, key), m))
        .when(whole(IPV4), address(m, key))
        .when(whole(ISO_DATE), _date(m, "yyyy-MM-dd", key))
        .when(whole(US_DATE), _date(m, "MM/dd/yyyy", key))
        .when(whole(SSN), social_security(m, key))
        .when(whole(US_PHONE), phone(m, key))
        .when(whole(ABROAD), phone_abroad(m, key)))
    return _let(one, lambda t: F.when(t.isNotNull(), F.struct(t.alias("t"), (t != m).cast("int").alias("n")))
                .when(whole(CARD), _cards(m, key)).otherwise(F.struct(m.alias("t"), F.lit(0).alias("n"))))


def session_key(spark: SparkSession) -> str:
    """The key of ``spark.sigloom.pii.key``; where it is unset, a random one that lasts as long as the session."""
    name = "spark.sigloom.pii.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def masked(docs: DataFrame, key: str, count: bool = True) -> DataFrame:
    """``docs`` with every private value of ``text`` under its pseudonym, and ``n_private``, how many were replaced.

    There is no default key: who knows the key can undo the pseudonyms.
    """
    if not key:
        raise ValueError("a key is needed")
    rest = [c for c in docs.columns if not (count and c == "n_private")]
    text = F.col("text")
    hit = F.coalesce(text.rlike(HINT), F.lit(False))
    # one pass marks the candidates, so that they are every other part; a text that holds the mark is searched twice
    gaps = F.split(text, ANY, -1)
    twice = F.flatten(F.zip_with(gaps, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda g, m: F.array(g, m)))
    once = F.split(F.regexp_replace(text, ANY, MARK + "$0" + MARK), MARK, -1)
    parts = F.when(hit, F.when(text.contains(MARK), twice).otherwise(once))
    found = docs.select(F.struct(*rest).alias("_row"), parts.alias("_parts"))
    some = F.coalesce(F.size("_parts") > 1, F.lit(False))

    def renewed(part: Column, i: Column) -> Column:
        return F.when(i % 2 == 1, F.when(part.isNotNull(), pseudonym(part, key))).otherwise(F.struct(part.alias("t"), F.lit(0).alias("n")))

    new = found.withColumn("_new", F.when(some, F.transform("_parts", renewed)))
    before = F.col("_row")["text"]
    after = F.array_join(F.transform("_new", lambda x: x["t"]), "")
    changed = F.aggregate("_new", F.lit(0), lambda n, x: n + F.coalesce(x["n"], F.lit(0)))
    out = {c: F.col("_row")[c].alias(c) for c in rest} | {"text": F.when(some, after).otherwise(before).alias("text")}
    extra = [F.when(some, changed).otherwise(0).cast("long").alias("n_private")] if count else []
    return new.select(*out.values(), *extra)
