"""Format-preserving pseudonyms: personal data is validated and then permuted by a keyed Feistel network.

A value found in a text and valid by its kind's own rules is split in two halves, and each round adds a keyed hash of
one half to the other, modulo the size of that half's range (or place by place, modulo the size of each place's
alphabet).  Every round can be undone, so for any key this is a bijection of all valid values of that format.  So the pseudonym is valid and looks the same, different values stay different,
and equal values stay equal in every document, however they are written.

Kinds: payment cards (13 to 19 digits, unbroken or in the groups of cards, an issuer's first digit, Luhn; the check digit is
recomputed), dates (ISO or day/month/year, a real day of
the years 1800 to 2199, a full Gregorian cycle), IPv4 addresses, telephone numbers (the last seven digits), US social
security numbers, e-mail addresses (letters and digits but those of the last label), access keys, and passwords or
tokens in an assignment.  Strings keep the kind of each place: digit, capital or small letter, or hexadecimal.  What fails
validation, such as an impossible date or a number with a wrong check digit, is left as it is.  Not looked for: passwords
without an assignment, bearer and other tokens outside one, IBANs, IPv6, national telephone numbers without a country code
or the American form, and dates with dots.

Only DataFrame expressions run.  Texts are cut at the matches of one pattern and put together again around the
pseudonyms, so everything else stays byte for byte.

Defined results: a null text stays null, with no finds; a text without finds is unchanged.  Repeated rows are treated
alike.  Extra columns pass through ``pseudonymise``; empty tables give empty results.  Spans count code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .base import free_name, let

KEY = "pseudonym-key-1"  # for trials: pass a secret key of your own, as whoever knows the key can undo the pseudonyms
FORMS = r"^(1[3-9]|4 4 4 4|4 6 5|4 6 4|4 4 4 4 3|4 4 5)$"  # lengths of a card's groups
ISSUERS = "^[2-6]"
ROUNDS = 8
CYCLE_DAYS, FIRST_DAY = 146_097, "1800-01-01"  # 400 Gregorian years, 189 * 773 days

# In order of precedence; no pattern can match the empty text, and none tries again inside a word it has refused.
# Runs of any length are possessive (``+`` behind the count): what follows them never needs a part back, and Java's other
# loops over groups or over characters of two widths take a stack frame a turn, which ends the executor on a long run.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]{0,62}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?i:password|passwd|secret|token|api_key)[ ]?[=:][ ]?(?:\"[^\s\"]{8,}+\"?|'[^\s']{8,}+'?|[^\s\"']{8,}+)",  # to its closing quote or blank
    "access": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "ipv4": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "iso_date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])",
    "day_date": r"(?<![\d/])\d{1,2}/\d{1,2}/\d{4}(?![\d/])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)"
             r"|(?<![\d(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    # a run of digit groups of any length, up to a blank before a value of another kind; _card looks for cards inside
    "card": r"(?<!\d)\d(?:-?\d|[ ](?!\d{3}-\d{2}-\d{4}(?![\d-])|\d{4}-\d{2}-\d{2}(?![\d-])|\d{3}-\d{3}-\d{4}(?![\d-])"
            r"|\d{1,3}\.\d|\d{1,2}/\d)\d){12,}+(?!\d)",
}
FINDER = "|".join(f"(?:{p})" for p in KINDS.values())
HINT = r"[0-9@]|(?i:password|passwd|secret|token|api_key)"


def _drawn(key: str, tag: str, k: Column, other: Column, bits: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), k.cast("string"), other.cast("string")), bits)


def _rounds(start: Column, step, key: str, done) -> Column:
    """Odd rounds change ``l`` by ``r``, even ones ``r`` by ``l``."""
    turns = F.array(*[F.lit(k) for k in range(1, ROUNDS + 1)])
    return F.aggregate(turns, start, lambda s, k: F.when(
        k % 2 == 1, F.struct(step(s["l"], s["r"], k, "l").alias("l"), s["r"].alias("r"))
    ).otherwise(F.struct(s["l"].alias("l"), step(s["r"], s["l"], k, "r").alias("r"))), done)


def permuted_number(l: Column, r: Column, a: int, b: int, tag: str, done, key: str = KEY) -> Column:
    """``done`` of the permuted halves, a struct of ``l`` in 0 .. a - 1 and ``r`` in 0 .. b - 1."""
    def step(half: Column, other: Column, k: Column, side: str) -> Column:
        drawn = F.conv(F.substring(_drawn(key, tag, k, other, 256), 1, 12), 16, 10).cast("long")
        return F.pmod(half + drawn, F.lit(a if side == "l" else b).cast("long"))

    return _rounds(F.struct(l.cast("long").alias("l"), r.cast("long").alias("r")), step, key, done)


def permuted_string(s: Column, tag: str, key: str = KEY) -> Column:
    """Letters and digits permuted, the kind of each place kept; a secret of 16 or more of 0-9a-f stays of these."""
    digits16 = "0123456789abcdef"

    def shifted(c: Column, by: Column, is_hex: Column) -> Column:
        code = F.ascii(c)
        place = lambda base, size: F.char(base + F.pmod(code - base + by, F.lit(size)))
        return (F.when(is_hex, F.substring(F.lit(digits16), F.pmod(F.instr(F.lit(digits16), c) - 1 + by, F.lit(16)) + 1, F.lit(1)))
                .when(c.rlike("^[0-9]$"), place(48, 10)).when(c.rlike("^[a-z]$"), place(97, 26))
                .when(c.rlike("^[A-Z]$"), place(65, 26)).otherwise(c))

    def rounds(is_hex: Column) -> Column:
        def step(half: Column, other: Column, k: Column, side: str) -> Column:
            return let(_drawn(key, tag, k, other, 512), lambda stream: F.array_join(F.transform(
                F.split(half, ""),
                lambda c, i: shifted(c, F.conv(F.substring(stream, (2 * i) % 126 + 1, F.lit(2)), 16, 10).cast("int"), is_hex)), ""))

        size = F.length(s)
        cut = F.floor(size / 2).cast("int")
        start = F.struct(F.substring(s, F.lit(1), cut).alias("l"), F.substring(s, cut + 1, size).alias("r"))
        return _rounds(start, step, key, lambda x: F.concat(x["l"], x["r"]))

    # looked up once a value, not once a place
    return let(s.rlike("^[0-9a-f]{16,}$"), rounds) if tag == "secret" else rounds(F.lit(False))


def luhn_digit(payload: Column) -> Column:
    """The check digit that belongs behind ``payload``, as text."""
    def value(i: Column) -> Column:
        d = F.substring(payload, F.length(payload) - i + 1, F.lit(1)).cast("int") * (1 + i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(payload)), value), F.lit(0), lambda a, x: a + x)
    return ((10 - total % 10) % 10).cast("string")


def refilled(written: Column, digits: Column) -> Column:
    """``written`` with its digits replaced in order by as many ``digits``."""
    return let(F.split(written, r"\d", -1), lambda between: F.concat(between[0], F.array_join(
        F.transform(F.split(digits, ""), lambda c, i: F.concat(c, F.get(between, i + 1))), "")))


def _new_card(d: Column, key: str) -> Column:
    payload = F.substring(d, F.lit(1), F.length(d) - 1)
    return let(F.concat(F.substring(d, F.lit(1), F.lit(1)), permuted_string(F.substring(payload, F.lit(2), F.length(d)), "card", key)),
               lambda p: F.concat(p, luhn_digit(p)))


def _is_card(d: Column) -> Column:
    return F.length(d).between(13, 19) & (luhn_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, F.length(d), F.lit(1)))


def _card(m: Column, key: str) -> Column:
    """Every card that the digit groups of a run make up."""
    return let(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda g: let(_cards_in(g), lambda c: _with_cards(m, g, c, key)))


def _cards_in(groups: Column) -> Column:
    """Valid spans of ``groups`` that don't overlap, the longer first, then the left: unbroken numbers or groups as on cards,
    with the first digit of an issuer.  Other groups, as in tables of numbers, may be valid by chance and aren't cards."""
    def spans(i: Column) -> Column:
        ends = F.sequence(i, F.least(i + 18, F.size(groups) - 1))
        made = F.transform(ends, lambda j: F.struct(i.alias("i"), j.alias("j"), F.slice(groups, i + 1, j - i + 1).alias("g")))
        sized = F.transform(made, lambda s: F.struct(s["i"].alias("i"), s["j"].alias("j"), F.array_join(s["g"], "").alias("d"), F.array_join(
            F.transform(s["g"], lambda x: F.length(x).cast("string")), " ").alias("form")))
        good = F.filter(sized, lambda s: F.when(s["form"].rlike(FORMS) & s["d"].rlike(ISSUERS), _is_card(s["d"])).otherwise(False))
        return F.transform(good, lambda s: F.struct(
            (-F.length(s["d"])).alias("short"), s["i"].alias("i"), s["j"].alias("j"), s["d"].alias("d")))

    found = F.sort_array(F.flatten(F.transform(F.sequence(F.lit(0), F.size(groups) - 1), spans)))
    none = F.filter(found, lambda x: F.lit(False))
    return let(found, lambda f: F.aggregate(f, none, lambda a, x: F.when(
        F.exists(a, lambda y: (y["i"] <= x["j"]) & (x["i"] <= y["j"])), a).otherwise(F.concat(a, F.array(x)))))


def _with_cards(m: Column, groups: Column, cards: Column, key: str) -> Column:
    """``m`` with the groups of each of ``cards`` replaced; blanks and hyphens stay."""
    new = F.transform(cards, lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"), _new_card(c["d"], key).alias("n")))

    def group(g: Column, k: Column, c: Column) -> Column:
        before = F.length(F.array_join(F.slice(groups, c["i"] + 1, k - c["i"]), ""))
        return F.coalesce(F.substring(c["n"], before + 1, F.length(g)), g)

    given = let(new, lambda cs: F.array_join(F.transform(groups, lambda g, k: let(
        F.get(F.filter(cs, lambda c: (c["i"] <= k) & (k <= c["j"])), F.lit(0)), lambda c: F.when(c.isNull(), g).otherwise(group(g, k, c)))), ""))
    return F.when(F.size(cards) > 0, let(given, lambda n: refilled(m, n))).otherwise(m)


def _date(m: Column, key: str, read: str, padded: str) -> Column:
    day = F.try_to_timestamp(m, F.lit(read)).cast("date")
    place = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    new = permuted_number(F.floor(place / 773), place % 773, 189, 773, "date", lambda x: F.date_add(
        F.lit(FIRST_DAY).cast("date"), (x["l"] * 773 + x["r"]).cast("int")), key)
    two = m.rlike(r"^(\d{4}-|\d\d/\d\d/)")
    return F.when(place.between(0, CYCLE_DAYS - 1),
                  F.when(two, F.date_format(new, padded)).otherwise(F.date_format(new, read))).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    o = F.split(m, r"\.")
    octet = lambda k: F.get(o, F.lit(k)).cast("int")
    valid = (octet(0) < 256) & (octet(1) < 256) & (octet(2) < 256) & (octet(3) < 256)
    new = permuted_number(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, "ipv4", lambda x: F.concat_ws(
        ".", *[p.cast("string") for side in "lr" for p in (F.floor(x[side] / 256), x[side] % 256)]), key)
    return F.when(valid, new).otherwise(m)


def _ssn(m: Column, key: str) -> Column:
    part = lambda a, n: F.substring(m, a, n).cast("int")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    new = permuted_number(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn", lambda x: F.concat_ws(
        "-", pad(x["l"] + F.when(x["l"] > 664, 2).otherwise(1), 3), pad(F.floor(x["r"] / 9999) + 1, 2), pad(x["r"] % 9999 + 1, 4)), key)
    return F.when(valid, new).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    d = F.regexp_replace(m, r"\D", "")
    kept = F.length(d) - 7
    new = F.concat(F.substring(d, F.lit(1), kept), permuted_string(F.substring(d, kept + 1, F.lit(7)), "phone", key))
    return F.when(F.length(d).between(10, 15), let(new, lambda n: refilled(m, n))).otherwise(m)


def _email(m: Column, key: str) -> Column:
    name, last = F.regexp_extract(m, r"^(.*)(\.[A-Za-z]+)$", 1), F.regexp_extract(m, r"^(.*)(\.[A-Za-z]+)$", 2)
    return F.concat(permuted_string(name, "email", key), last)


def _secret(m: Column, key: str) -> Column:
    """The value without punctuation after it, so that it gets one pseudonym wherever it stands."""
    pattern = r"^([A-Za-z_]+[ ]?[=:][ ]?[\"']?)((?:[\s\S]*[A-Za-z0-9])?)([\s\S]*)\z"
    head, value, tail = (F.regexp_extract(m, pattern, k) for k in (1, 2, 3))
    return F.concat(head, permuted_string(value, "secret", key), tail)


def _access(m: Column, key: str) -> Column:
    return F.concat(F.substring(m, 1, 4), permuted_string(F.substring(m, 5, 16), "access", key))


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of one match of ``FINDER``; itself where it isn't valid."""
    by_kind = {"email": _email, "secret": _secret, "access": _access, "ipv4": _ipv4,
               "iso_date": lambda x, k: _date(x, k, "yyyy-MM-dd", "yyyy-MM-dd"),
               "day_date": lambda x, k: _date(x, k, "d/M/yyyy", "dd/MM/yyyy"), "ssn": _ssn, "phone": _phone, "card": _card}
    out = m
    for kind in reversed(KINDS):
        out = F.when(m.rlike(f"^(?:{KINDS[kind]})$"), by_kind[kind](m, key)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, text: str = "text", finds: str = "finds", key: str = KEY) -> DataFrame:
    """``docs`` with the text replaced and ``finds``, an array of ``found`` (what was there) and ``given``."""
    content = F.col(text)
    found = F.when(content.rlike(HINT), F.regexp_extract_all(content, F.lit(FINDER), F.lit(0))).otherwise(F.array().cast("array<string>"))
    name = free_name(docs, "_given")
    given = docs.withColumn(name, F.transform(found, lambda m: F.struct(m.alias("found"), pseudonym(m, key).alias("given"))))
    pieces = F.split(content, FINDER, -1)
    joined = let(F.struct(pieces.alias("p"), F.col(name).alias("g")), lambda x: F.concat(x["p"][0], F.array_join(
        F.transform(x["g"], lambda g, i: F.concat(g["given"], F.get(x["p"], i + 1))), "")))
    return given.withColumn(text, F.when(F.size(name) > 0, joined).otherwise(content)).withColumn(
        finds, F.filter(name, lambda g: g["found"] != g["given"])).drop(name)
