"""Format-preserving pseudonyms: a keyed Feistel permutation of validated numbers, dates and addresses in texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltframe.llm.common import documents

ROUNDS = 10
DEMO_KEY = "voltframe demonstration key"

# Candidates in text, by kind; a candidate is replaced only where its kind's validation holds.
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)"
DATE = r"(?<![\w\-/])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w\-/]\d)(?!\d)"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
CARD = r"(?<!\w)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}(?: \d{1,3})?|\d{4}-\d{4}-\d{4}-\d{4}(?:-\d{1,3})?|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\w)"
# Card numbers grouped in any other way; looked for between the candidates, so that it hides none of them.
GROUPED = r"(?<!\w)\d(?:[ \-]?\d){12,18}(?!\w)"
PHONE = r"(?<!\w)(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\w)|(?<!\w)\+\d(?:[ .\-()]{0,2}\d){7,14}(?!\w)"
KEY = r"(?<!\w)(?:AKIA[0-9A-Z]{16}(?!\w)|(?i:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}[\"']?[0-9A-Za-z+/_\-]{8,})"
NUMBERS = {"ipv4": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
# Numbers start with a digit, a bracket or a plus sign; saying so first saves trying each of them at every letter.
CANDIDATE = rf"{EMAIL}|(?=[\d(+])(?:{'|'.join(f'(?:{p})' for p in NUMBERS.values())})|{IBAN}|{KEY}"

# 400 Gregorian years have 146,097 = 189 * 773 days, so a day in such a span is a pair of digits.
SPAN, SPAN_HIGH, SPAN_LOW = 146097, 189, 773
EPOCH = "1800-01-01"
# Days from the epoch: the calendar's first day, the first whole span (year 200) and the span that its end cuts (year 9800). The parts
# of a span before and after have 72,683 = 13 * 5591 and 73,048 = 184 * 397 days.
FIRST_DAY, FIRST_SPAN, LAST_SPAN = -657071, -584388, 2921940
FIRST_PAIR, LAST_PAIR = (13, 5591), (184, 397)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ints(values) -> Column:
    return F.array(*[F.lit(int(v)) for v in values])


def feistel(values: Column, radices: Column, key: Column, tweak: Column | str, inverse: bool = False) -> Column:
    """Keyed permutation of a digit vector, digit ``i`` in ``0 .. radices[i] - 1``.

    The vector is cut in two; in turn each half gets added, digit by digit modulo its radix, a stream derived from
    the other half by SHA-512 under the key. Every round can be undone, so the whole is a permutation of all
    vectors of these radices. One hash serves 32 digits; longer halves take further hashes, numbered from 1.
    """
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    n = F.size(values)
    cut = ((n + 1) / 2).cast("int")

    def stir(half: Column, radix: Column, other: Column, r: Column) -> Column:
        label = F.concat_ws("|", key, tweak, r.cast("string"), n.cast("string"), F.array_join(other.cast("array<string>"), ","))
        sign = F.lit(-1 if inverse else 1)
        more = F.transform(F.sequence(F.lit(1), ((F.size(half) - 1) / 32).cast("int")), lambda k: F.sha2(F.concat_ws("|", label, k.cast("string")), 512))
        return let(
            F.when(F.size(half) <= 32, F.sha2(label, 512)).otherwise(F.concat(F.sha2(label, 512), F.array_join(more, ""))),
            lambda h: F.transform(
                half,
                lambda v, i: F.pmod(v + sign * F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.element_at(radix, i + 1)),
            ),
        )

    def both(x: Column) -> Column:
        return F.struct(F.slice(x, 1, cut).alias("a"), F.slice(x, cut + 1, n - cut).alias("b"))

    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    mixed = let(
        both(radices),
        lambda q: F.aggregate(
            ints(order),
            both(values),
            lambda s, r: F.when(r % 2 == 0, F.struct(stir(s["a"], q["a"], s["b"], r).alias("a"), s["b"].alias("b"))).otherwise(
                F.struct(s["a"].alias("a"), stir(s["b"], q["b"], s["a"], r).alias("b"))
            ),
            lambda s: F.concat(s["a"], s["b"]),
        ),
    )
    return F.when(F.size(values) < 2, values).otherwise(mixed)


def chars(text: Column) -> Column:
    return F.filter(F.split(text, "", -1), lambda c: c != "")


def code(c: Column) -> Column:
    """Place of a character in its class; -1 outside the classes 0-9, a-z, A-Z."""
    return (
        F.when(c.between("0", "9"), F.ascii(c) - 48)
        .when(c.between("a", "z"), F.ascii(c) - 97)
        .when(c.between("A", "Z"), F.ascii(c) - 65)
        .otherwise(F.lit(-1))
    )


def radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(26))


def letter(c: Column, v: Column) -> Column:
    """Character number ``v`` of the class of ``c``."""
    base = F.when(c.between("0", "9"), F.lit(48)).when(c.between("a", "z"), F.lit(97)).otherwise(F.lit(65))
    return F.char(base + v)


def by_class(text: Column, key: Column, tweak: str, inverse: bool, low: int | Column = 0) -> Column:
    """Permute the digits and letters of a text within their classes; what stands between keeps its place."""

    gaps = F.split(text, "[0-9A-Za-z]", -1)

    def fill(free: Column) -> Column:
        moved = feistel(F.transform(free, code), F.transform(free, radix), key, tweak, inverse)
        return F.array_join(F.flatten(F.zip_with(gaps, F.zip_with(free, moved, letter), lambda g, c: F.array(g, F.coalesce(c, F.lit(""))))), "")

    return let(F.filter(chars(text), lambda c: code(c) >= 0), fill)


def refill(shape: Column, digits: Column) -> Column:
    """Put the digits, one by one, in the places of the digits of ``shape``."""
    return F.aggregate(
        chars(shape),
        F.struct(F.lit("").alias("t"), F.lit(1).alias("i")),
        lambda s, c: F.when(
            c.between("0", "9"), F.struct(F.concat(s["t"], F.substring(digits, s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i"))
        ).otherwise(F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i"))),
        lambda s: s["t"],
    )


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def luhn_sum(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum over a digit string, from the right; ``doubled_first``: the last digit is doubled."""
    return F.aggregate(
        F.reverse(chars(digits)),
        F.struct(F.lit(0).alias("s"), F.lit(doubled_first).alias("d")),
        lambda a, c: let(
            F.when(a["d"], c.cast("int") * 2).otherwise(c.cast("int")),
            lambda v: F.struct((a["s"] + F.when(v > 9, v - 9).otherwise(v)).alias("s"), (~a["d"]).alias("d")),
        ),
        lambda a: a["s"],
    )


def mod97(text: Column) -> Column:
    """Value of a string of digits and capital letters (A = 10 .. Z = 35) modulo 97."""
    return F.aggregate(
        chars(text),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97).cast("int"),
    )


def number_parts(text: Column) -> Column:
    return F.split(text, r"\.").cast("array<int>")


# Validation and replacement by kind.


def valid_card(m: Column) -> Column:
    return luhn_sum(digits_of(m), False) % 10 == 0


def mask_card(m: Column, key: Column, inverse: bool) -> Column:
    """All but the first digit and the check digit move; the check digit is made to fit."""

    def build(d: Column) -> Column:
        body = F.transform(chars(F.substring(d, F.lit(2), F.length(d) - 2)), lambda c: c.cast("int"))
        moved = feistel(body, F.transform(body, lambda _: F.lit(10)), key, F.concat(F.lit("card"), F.substring(d, 1, 1)), inverse)
        return let(
            F.concat(F.substring(d, 1, 1), F.array_join(moved.cast("array<string>"), "")),
            lambda p: F.concat(p, ((10 - luhn_sum(p, True) % 10) % 10).cast("string")),
        )

    return refill(m, let(digits_of(m), build))


def card_parts(m: Column) -> tuple[Column, Column]:
    """Four groups of four digits and the short group that may follow them; others are whole."""
    tail = F.regexp_extract(m, r"(?<=^\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4})[ -]\d{1,3}$", 0)
    return F.substring(m, F.lit(1), F.length(m) - F.length(tail)), tail


def mask_card_run(m: Column, key: Column, inverse: bool) -> Column:
    """The whole number where it is a card's, else its first 16 digits, which a short group follows.

    The first 16 digits are moved on while their image would make the whole valid, so that taking it back meets the same case.
    """
    def walk(x: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(40)),
            x["head"],
            lambda h, i: F.when((i == 0) | valid_card(F.concat(h, x["tail"])), let(h, lambda v: mask_card(v, key, inverse))).otherwise(h),
            lambda h: F.concat(h, x["tail"]),
        )

    def build(x: Column) -> Column:
        whole = F.struct(m.alias("head"), F.lit("").alias("tail"))
        return let(F.when(valid_card(m), whole).otherwise(x), lambda y: F.when(y["tail"] == "", mask_card(y["head"], key, inverse)).otherwise(walk(y)))

    head, tail = card_parts(m)
    return let(F.struct(head.alias("head"), tail.alias("tail")), build)


def valid_ipv4(m: Column) -> Column:
    return F.forall(number_parts(m), lambda v: v <= 255)


def mask_ipv4(m: Column, key: Column, inverse: bool) -> Column:
    return F.array_join(feistel(number_parts(m), ints([256] * 4), key, "ipv4", inverse).cast("array<string>"), ".")


def day_of(m: Column) -> Column:
    sep = F.substring(m, 3, 1)
    iso = F.when(sep.isin(".", "/"), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2))).otherwise(m)
    return F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date")


def mask_date(m: Column, key: Column, inverse: bool) -> Column:
    """The day moves inside its span of 400 years from 1800 (at both ends of the calendar 0001 to 9999, inside the part of a span that
    is in it); the written form (ISO, or day first) stays."""

    def build(days: Column) -> Column:
        early, late = days < FIRST_SPAN, days >= LAST_SPAN
        high = F.when(early, FIRST_PAIR[0]).when(late, LAST_PAIR[0]).otherwise(SPAN_HIGH)
        low = F.when(early, FIRST_PAIR[1]).when(late, LAST_PAIR[1]).otherwise(SPAN_LOW)
        start = F.when(early, FIRST_DAY).when(late, LAST_SPAN).otherwise(days - F.pmod(days, F.lit(SPAN)))
        place = days - start
        pair = F.array((place / low).cast("int"), (place % low).cast("int"))
        moved = feistel(pair, F.array(high, low), key, "date", inverse)
        day = let(moved, lambda p: F.date_add(F.to_date(F.lit(EPOCH)), (start + F.element_at(p, 1) * low + F.element_at(p, 2)).cast("int")))
        sep = F.substring(m, 3, 1)
        return let(
            day,
            lambda d: F.when(sep == ".", F.date_format(d, "dd.MM.yyyy")).when(sep == "/", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd")),
        )

    return let(F.datediff(day_of(m), F.to_date(F.lit(EPOCH))), build)


def valid_ssn(m: Column) -> Column:
    area = F.substring(m, 1, 3).cast("int")
    return area.between(1, 899) & (area != 666) & (F.substring(m, 5, 2) != "00") & (F.substring(m, 8, 4) != "0000")


def mask_ssn(m: Column, key: Column, inverse: bool) -> Column:
    area = F.substring(m, 1, 3).cast("int")
    values = F.array(F.when(area < 666, area - 1).otherwise(area - 2), F.substring(m, 5, 2).cast("int") - 1, F.substring(m, 8, 4).cast("int") - 1)
    return let(
        feistel(values, ints([898, 99, 9999]), key, "ssn", inverse),
        lambda v: F.format_string(
            "%03d-%02d-%04d", F.element_at(v, 1) + F.when(F.element_at(v, 1) < 665, 1).otherwise(2), F.element_at(v, 2) + 1, F.element_at(v, 3) + 1
        ),
    )


def valid_iban(m: Column) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    return F.length(flat).between(15, 34) & (mod97(F.concat(F.substring(flat, F.lit(5), F.length(flat)), F.substring(flat, 1, 4))) == 1)


def mask_iban(m: Column, key: Column, inverse: bool) -> Column:
    """The account part moves by class, the check digits are made to fit, spaces stay."""

    def build(flat: Column) -> Column:
        country = F.substring(flat, 1, 2)
        account = by_class(F.substring(flat, F.lit(5), F.length(flat)), key, "iban", inverse)
        return let(
            account, lambda a: F.concat(country, F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)
        )

    def spaced(flat: Column) -> Column:
        return F.aggregate(
            chars(m),
            F.struct(F.lit("").alias("t"), F.lit(1).alias("i")),
            lambda s, c: F.when(c == " ", F.struct(F.concat(s["t"], c).alias("t"), s["i"].alias("i"))).otherwise(
                F.struct(F.concat(s["t"], F.substring(flat, s["i"], F.lit(1))).alias("t"), (s["i"] + 1).alias("i"))
            ),
            lambda s: s["t"],
        )

    return let(let(F.replace(m, F.lit(" "), F.lit("")), build), spaced)


NORTH_AMERICAN = r"^(?:\+?1[ .\-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .\-])[2-9]\d{2}[ .\-]\d{4}$"


def valid_phone(m: Column) -> Column:
    return m.rlike(NORTH_AMERICAN) | (m.startswith("+") & F.length(digits_of(m)).between(8, 15))


def mask_phone(m: Column, key: Column, inverse: bool) -> Column:
    """North American numbers stay such numbers; of others the digits after the country's first two move."""
    low = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0]

    def national(d: Column) -> Column:
        vs = F.zip_with(F.transform(chars(F.right(d, F.lit(10))), lambda c: c.cast("int")), ints(low), lambda a, b: a - b)
        moved = F.zip_with(feistel(vs, ints([10 - x for x in low]), key, "phone1", inverse), ints(low), lambda a, b: a + b)
        return F.concat(F.substring(d, F.lit(1), F.length(d) - 10), F.array_join(moved.cast("array<string>"), ""))

    def abroad(d: Column) -> Column:
        vs = F.transform(chars(F.substring(d, F.lit(3), F.length(d))), lambda c: c.cast("int"))
        moved = feistel(vs, F.transform(vs, lambda _: F.lit(10)), key, "phone", inverse)
        return F.concat(F.substring(d, 1, 2), F.array_join(moved.cast("array<string>"), ""))

    return refill(m, let(digits_of(m), lambda d: F.when(m.rlike(NORTH_AMERICAN), national(d)).otherwise(abroad(d))))


def mask_email(m: Column, key: Column, inverse: bool) -> Column:
    """Everything before the top-level domain moves by class."""
    top = F.substring_index(m, ".", -1)
    body = F.substring(m, F.lit(1), F.length(m) - F.length(top))
    return F.concat(by_class(body, key, "email", inverse), top)


def mask_key(m: Column, key: Column, inverse: bool) -> Column:
    """Access key ids keep their prefix, labelled secrets their label."""
    label = F.regexp_extract(m, r"^(?:AKIA(?=[0-9A-Z]{16}$)|\w+\s{0,3}[=:]\s{0,3}[\"']?)", 0)
    return F.concat(label, by_class(F.substring(m, F.length(label) + 1, F.length(m)), key, "key", inverse))


def pseudonym(m: Column, key: Column, inverse: bool = False) -> Column:
    """The pseudonym of a candidate, or null where no kind's validation holds. ``inverse`` takes it back."""
    whole = {k: rf"^(?:{p})$" for k, p in NUMBERS.items()}
    return (
        F.when(F.contains(m, F.lit("@")), mask_email(m, key, inverse))
        .when(m.rlike(whole["ipv4"]), F.when(valid_ipv4(m), mask_ipv4(m, key, inverse)))
        .when(m.rlike(whole["date"]), F.when(day_of(m).isNotNull(), mask_date(m, key, inverse)))
        .when(m.rlike(whole["ssn"]), F.when(valid_ssn(m), mask_ssn(m, key, inverse)))
        .when(m.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$") & valid_iban(m), mask_iban(m, key, inverse))
        .when(m.rlike(whole["card"]) & (valid_card(m) | valid_card(card_parts(m)[0])), mask_card_run(m, key, inverse))
        .when(m.rlike(whole["phone"]) & valid_phone(m), mask_phone(m, key, inverse))
        .when(m.rlike(rf"^(?:{KEY})$"), mask_key(m, key, inverse))
    )


def glue(gaps: Column, masked: Column) -> Column:
    """Gaps and the values between them, in turn."""
    return F.array_join(F.flatten(F.zip_with(gaps, masked, lambda g, x: F.array(g, F.coalesce(x["p"], x["m"], F.lit(""))))), "")


def grouped_cards(text: Column, key: Column, inverse: bool) -> Column:
    """``t, n``: the text with card numbers in free groups replaced, and their number."""

    def work(g: Column) -> Column:
        found = F.transform(
            F.regexp_extract_all(g, F.lit(GROUPED), F.lit(0)),
            lambda m: F.struct(m.alias("m"), F.when(valid_card(m), mask_card(m, key, inverse)).alias("p")),
        )
        return let(
            found,
            lambda xs: F.struct(glue(F.split(g, GROUPED, -1), xs).alias("t"), F.size(F.filter(xs, lambda x: x["p"].isNotNull())).alias("n")),
        )

    return F.when(text.rlike(GROUPED), work(text)).otherwise(F.struct(text.alias("t"), F.lit(0).alias("n")))


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = DEMO_KEY, inverse: bool = False) -> DataFrame:
    """All columns of ``docs`` plus ``masked_text`` and ``n_values`` (replaced values); one pass, no shuffle.

    Found are e-mail addresses, IPv4 addresses, dates, social security numbers, IBANs, card and phone numbers and
    labelled secrets. A value that passes its kind's check (octets, calendar, area rules, modulo 97, Luhn, numbering
    plan) is replaced by its image under a keyed permutation of all values of its form; the same value has the same
    pseudonym in every document, check digits stay right. Candidates that fail the check stay as they are.
    A card number may be grouped in any way, unless its start reads like a value of another kind. Labels are found in any case.
    ``inverse`` with the same key restores the values. Null text gives null and 0 values.
    Texts without a digit, ``@``, ``=``, ``:`` or ``AKIA`` cannot hold any of them. Empty tables give an empty result.
    """
    text = F.col("_row")[text_col].cast("string")
    secret = F.lit(key)
    rows = docs.select(F.struct("*").alias("_row"))
    found = rows.select(
        "_row", F.when(text.rlike("[0-9@=:]|AKIA"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).alias("_found")
    )
    gaps = F.split(text, CANDIDATE, -1)
    masked = F.transform("_found", lambda m: F.struct(m.alias("m"), pseudonym(m, secret, inverse).alias("p")))
    worked = found.select(
        "_row",
        F.when(F.size("_found") > 0, masked).alias("_masked"),
        F.when(F.col("_found").isNotNull() & text.rlike(GROUPED), F.transform(gaps, lambda g: grouped_cards(g, secret, inverse))).alias("_gaps"),
    )
    glued = glue(F.coalesce(F.col("_gaps.t"), gaps), F.coalesce("_masked", F.array().cast("array<struct<m:string,p:string>>")))
    n_found = F.when(F.col("_masked").isNull(), 0).otherwise(F.size(F.filter("_masked", lambda x: x["p"].isNotNull())))
    n_grouped = F.when(F.col("_gaps").isNull(), 0).otherwise(F.aggregate("_gaps", F.lit(0), lambda n, g: n + g["n"]))
    return worked.select(
        *[F.col("_row")[c].alias(c) for c in docs.columns if c not in ("masked_text", "n_values")],
        F.when(F.col("_masked").isNull() & F.col("_gaps").isNull(), text).otherwise(glued).alias("masked_text"),
        (n_found + n_grouped).alias("n_values"),
    )


def op1_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal values replaced by linked pseudonyms."""
    masked = pseudonymise(documents(spark, sf_dir))
    return masked.select("doc_id", F.col("masked_text").alias("text"), "n_values")
