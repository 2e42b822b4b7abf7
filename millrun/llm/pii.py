"""PII: validated numbers, dates and addresses become pseudonyms of the same format.

Each value is a vector of symbols, each with its own number of choices (a digit 10, a letter 26, a byte of
an address 256, ...). A Feistel network over the two halves of the vector adds to every symbol of one half a
key stream hashed from the other half, modulo that symbol's choices. This permutes the values of a
format, so equal values get equal pseudonyms in all documents and different ones differ, and whoever
has the key can undo it. What makes a value valid (a check digit, the calendar, forbidden groups) holds for the
pseudonym too. All steps are DataFrame expressions within a row; there is no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Days that dates are permuted among: blocks of 2^16 from this day on (1720 to 2258 is accepted).
EPOCH = "1900-01-01"
BLOCK_DAYS = 1 << 16
#: The formats of values that have one length at a place, in order of precedence, and those that may be cut shorter.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9.-]{0,252}[A-Za-z0-9])?\.[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "ssn": r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?!(?!T[0-9])[\w/-]|\.[0-9])",
    "phone": r"(?<![\w+-])(?:\+?1[\u00A0 .-])?(?:\([0-9]{3}\)[\u00A0 ]?|[0-9]{3}[\u00A0 .-])[0-9]{3}[\u00A0 .-][0-9]{4}(?![\w-])",
    "ip": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])",
    "secret": r"(?<!\w)(?:AKIA[A-Z0-9]{16}(?!\w)|(?i:password|passwd|secret|token|api_?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9][A-Za-z0-9+/_-]{7,}={0,2})",
}
GREEDY = {
    "iban": r"(?<!\w)(?:[A-Z]{2}[0-9]{2}(?:[\u00A0 ]?[A-Z0-9]{4}){2,7}(?:[\u00A0 ]?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?:[\u00A0 ]?[a-z0-9]{4}){2,7}(?:[\u00A0 ]?[a-z0-9]{1,3})?)(?!\w)",
    "card": r"(?<![\w-])[0-9](?:[\u00A0 -]?[0-9]){12,18}(?![\w/-]|\.[0-9])",
}
SEPARATORS = "[\u00A0 -]"
#: The groups in which cards are printed. Digits in other groups are a card, too, unless a card in such groups begins among them.
PRINTED = r"^(?:[0-9]{13,19}|[0-9]{4}(S[0-9]{4}){2}S[0-9]{1,4}(S[0-9]{1,3})?|[0-9]{4}S[0-9]{6}S[0-9]{4,5}|[0-9]{6}S[0-9]{7,13})$".replace("S", SEPARATORS)
#: A place where a value may begin, with what each kind of format would take from there.
FIXED = "|".join(f"(?:{p})" for p in FORMATS.values())
STARTS = f"(?={FIXED}|{GREEDY['iban']}|{GREEDY['card']})"
TAKEN = STARTS + "".join(f"(?:(?=({p})))?" for p in (FIXED, *GREEDY.values()))
#: Groups of digits that a card can have, so the most places within it where another may begin.
MOST_GROUPS = 19
#: A text without any of these has no value to replace.
GATE = r"[0-9@=:]|AKIA"


def session_key(spark: SparkSession) -> str:
    """The secret of a deployment, from its session setting; without it one for tests."""
    return spark.conf.get("millrun.pii.key", "corpus-pseudonyms")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def feistel(values: Column, choices: Column, format_name: Column, key: str) -> Column:
    """Permute a vector of bigint ``values``, each in [0, its ``choices``)."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")

    def one_round(acc: Column, r: Column) -> Column:
        left = r % 2 == 0
        other = F.when(left, F.slice(acc, half + 1, n - half)).otherwise(F.slice(acc, F.lit(1), half))
        seen = F.concat_ws(
            "|", F.lit(key), format_name, r.cast("string"), n.cast("string"), F.array_join(other.cast("array<string>"), ",")
        )

        def shifted(fixed: Column) -> Column:
            def stream(i: Column) -> Column:
                block = F.sha2(F.concat_ws("|", fixed, F.floor(i / 4).cast("string")), 256)
                return F.conv(F.substr(block, (i % 4) * 15 + 1, F.lit(15)), 16, 10).cast("bigint")

            return F.transform(
                acc, lambda x, i: F.when((i < half) == left, (x + stream(i)) % F.get(choices, i)).otherwise(x)
            )

        return let(seen, shifted)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, one_round)


def refill(pattern: Column, symbols: Column, kind: str, skip: Column) -> Column:
    """A format's ``pattern`` with its characters of ``kind`` (a class), but for the first ``skip``, replaced by ``symbols`` in turn."""
    chars = F.split(pattern, "")
    place = lambda i: F.char_length(F.regexp_replace(F.substr(pattern, F.lit(1), i + 1), f"[^{kind}]", ""))
    out = F.transform(
        chars,
        lambda c, i: F.when(
            c.rlike(f"^[{kind}]$") & (place(i) > skip), F.substr(symbols, place(i) - skip, F.lit(1))
        ).otherwise(c),
    )
    return F.array_join(out, "")


def luhn_sum(digits: Column) -> Column:
    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda a, x: a + x)


def iban_rest(account: Column, head: Column) -> Column:
    """The number that account, then country and check digits spell, modulo 97."""
    chars = F.split(F.concat(account, head), "")

    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(chars, F.lit(0), step)


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def _kind(t: Column) -> Column:
    """Name of the first fixed format that ``t`` has; null if it isn't valid in it."""
    name = F.coalesce(*(F.when(t.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in FORMATS.items()))

    def checked(k: Column) -> Column:
        bad = (
            F.when(k == "date", F.coalesce(~F.floor(_day(t) / BLOCK_DAYS).between(-1, 1), F.lit(True)))
            .when(k == "ip", F.array_max(F.split(t, r"\.").cast("array<int>")) > 255)
            .otherwise(False)
        )
        return F.when(~bad, k)

    return let(name, checked)


def _flat(t: Column) -> Column:
    """An IBAN without blanks, in capitals."""
    return F.upper(F.regexp_replace(t, "[\u00A0 ]", ""))


def _is_iban(t: Column) -> Column:
    flat = _flat(t)
    return F.char_length(flat).between(13, 35) & (iban_rest(F.substr(flat, F.lit(5), F.lit(31)), F.substr(flat, F.lit(1), F.lit(4))) == 1)


def _is_card(t: Column) -> Column:
    return F.char_length(_digits(t)).between(13, 19) & (luhn_sum(_digits(t)) % 10 == 0)


def _longest(t: Column, valid) -> Column:
    """The longest prefix of ``t`` that ends at its end or before a separator and is ``valid``; null if there is none."""
    spans = F.sequence(F.char_length(t), F.least(F.lit(13), F.char_length(t)), F.lit(-1))
    ends = F.filter(spans, lambda i: (i == F.char_length(t)) | F.substr(t, i + 1, F.lit(1)).rlike(SEPARATORS))
    good = F.filter(ends, lambda i: valid(F.substr(t, F.lit(1), i)))
    return let(F.get(good, F.lit(0)), lambda i: F.substr(t, F.lit(1), i))


def _value(x: Column) -> Column:
    """The value that begins at a place, from what the formats take there: ``t, kind, odd`` (``t`` null if none is valid)."""
    fixed = F.when(x["fixed"] != "", _kind(x["fixed"]))
    iban = F.when(x["iban"] != "", _longest(x["iban"], _is_iban))
    card = F.when(x["card"] != "", _longest(x["card"], _is_card))

    def made(kind: Column) -> Column:
        found = F.struct(x["fixed"].alias("t"), kind.alias("kind"))
        other = let(iban, lambda t: F.when(t.isNotNull(), F.struct(t.alias("t"), F.lit("iban").alias("kind"))))
        last = let(card, lambda t: F.struct(t.alias("t"), F.lit("card").alias("kind")))
        return F.when(kind.isNotNull(), found).otherwise(F.coalesce(other, last))

    def marked(v: Column) -> Column:
        odd = F.coalesce((v["kind"] == "card") & ~v["t"].rlike(PRINTED), F.lit(False))
        return F.struct(v["t"].alias("t"), v["kind"].alias("kind"), odd.alias("odd"), F.coalesce(F.char_length(v["t"]), F.lit(0)).alias("n"))

    return let(let(fixed, made), marked)


def _day(t: Column) -> Column:
    """Days since EPOCH of a date; null if the calendar has no such day."""
    iso = F.when(t.rlike("^[0-9]{4}"), t).otherwise(F.regexp_replace(t, r"^(..).(..).(....)$", "$3-$2-$1"))
    return F.datediff(iso.try_cast("date"), F.lit(EPOCH).cast("date")).cast("bigint")


def _numbers(t: Column, kind: Column) -> tuple[Column, Column]:
    """Values and choices of the formats that are numbers with bounds of their own; null for the others."""

    def longs(*x) -> Column:
        return F.array(*((v if isinstance(v, Column) else F.lit(v)).cast("bigint") for v in x))

    area, group, serial = (F.substr(t, F.lit(a), F.lit(b)).try_cast("bigint") for a, b in ((1, 3), (5, 2), (8, 4)))
    within = F.pmod(_day(t), F.lit(BLOCK_DAYS).cast("bigint"))
    values = (
        F.when(kind == "ip", F.split(t, r"\.").try_cast("array<bigint>"))
        .when(kind == "ssn", longs(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1))
        .when(kind == "date", longs(F.floor(within / 256), within % 256))
    )
    choices = (
        F.when(kind == "ip", longs(256, 256, 256, 256))
        .when(kind == "ssn", longs(898, 99, 9999))
        .when(kind == "date", longs(256, 256))
    )
    return values, choices


def _symbols(t: Column, kind: Column) -> tuple[Column, Column, Column]:
    """The part of a value whose symbols are permuted, and its first and last such place."""
    flat = _flat(t)
    tail = F.regexp_extract(t, r"""^[^=:]*[=:]\s*["']?(.*)$""", 1)
    text = (
        F.when(kind == "iban", F.substr(flat, F.lit(5), F.lit(31)))
        .when(kind == "phone", F.substr(_digits(t), F.char_length(_digits(t)) - 9, F.lit(10)))
        .when(kind == "card", F.substr(_digits(t), F.lit(1), F.char_length(_digits(t)) - 1))
        .when(kind.isin("email", "secret"), t)
    )
    first = (
        F.when(kind == "card", 1)
        .when((kind == "secret") & t.rlike("^AKIA"), 4)
        .when(kind == "secret", F.char_length(t) - F.char_length(tail))
        .otherwise(0)
    )
    last = F.when(kind == "email", F.char_length(t) - F.char_length(F.substring_index(t, ".", -1))).otherwise(1 << 20)
    return text, first, last


def _vector(x: Column) -> tuple[Column, Column]:
    """Values and choices of the characters of ``x.text``: digits among digits, letters among letters of their case."""

    def choice(c: Column, i: Column) -> Column:
        free = (i >= x["first"]) & (i < x["last"])
        return F.when(free & c.rlike("^[0-9]$"), 10).when(free & c.rlike("^[A-Za-z]$"), 26).otherwise(1).cast("bigint")

    def value(c: Column, i: Column) -> Column:
        return F.when(choice(c, i) > 1, F.ascii(c) - _base(c)).otherwise(0).cast("bigint")

    return F.transform(x["chars"], value), F.transform(x["chars"], choice)


def _base(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).otherwise(65)


def _spelled(x: Column) -> Column:
    """The new value in the format of the old one."""
    t, kind, moved, text = x["t"], x["kind"], x["moved"], x["text"]
    flat = _flat(t)
    number = [F.get(moved, F.lit(i)) for i in range(3)]
    area = F.when(number[0] >= 665, number[0] + 2).otherwise(number[0] + 1)
    ssn = F.concat_ws(
        "-", *(F.lpad(v.cast("string"), n, "0") for v, n in ((area, 3), (number[1] + 1, 2), (number[2] + 1, 4)))
    )
    day = F.floor(_day(t) / BLOCK_DAYS) * BLOCK_DAYS + number[0] * 256 + number[1]
    iso = F.date_format(F.date_add(F.lit(EPOCH).cast("date"), day.cast("int")), "yyyy-MM-dd")
    mark = F.substr(t, F.lit(3), F.lit(1))
    year, month, of_month = (F.substr(iso, F.lit(a), F.lit(b)) for a, b in ((1, 4), (6, 2), (9, 2)))
    date = F.when(t.rlike("^[0-9]{4}"), iso).otherwise(F.concat(of_month, mark, month, mark, year))
    card_check = ((10 - luhn_sum(F.concat(text, F.lit("0"))) % 10) % 10).cast("string")
    country = F.substr(flat, F.lit(1), F.lit(2))
    iban_check = F.lpad((98 - iban_rest(text, F.concat(country, F.lit("00")))).cast("string"), 2, "0")
    return (
        F.when(kind == "ip", F.array_join(moved.cast("array<string>"), "."))
        .when(kind == "ssn", ssn)
        .when(kind == "date", date)
        .when(kind == "phone", refill(t, text, "0-9", F.char_length(_digits(t)) - 10))
        .when(kind == "card", refill(t, F.concat(text, card_check), "0-9", F.lit(0)))
        .when((kind == "iban") & (t == F.lower(t)), F.lower(refill(F.upper(t), F.concat(country, iban_check, text), "A-Z0-9", F.lit(0))))
        .when(kind == "iban", refill(t, F.concat(country, iban_check, text), "A-Z0-9", F.lit(0)))
        .when(kind.isin("email", "secret"), text)
    )


def pseudonyms(values: Column, key: str) -> Column:
    """The pseudonym of each of an array of valid values (``t, kind``)."""

    def read(v: Column) -> Column:
        t, kind = v["t"], v["kind"]
        text, first, last = _symbols(t, kind)
        numbers, choices = _numbers(t, kind)
        fields = {"t": t, "kind": kind, "chars": F.split(text, ""), "first": first, "last": last, "values": numbers, "choices": choices}
        return F.struct(*(c.alias(k) for k, c in fields.items()))

    def spread(x: Column) -> Column:
        values, choices = _vector(x)
        fields = {"t": x["t"], "kind": x["kind"], "chars": x["chars"]}
        fields |= {"values": F.coalesce(x["values"], values), "choices": F.coalesce(x["choices"], choices)}
        return F.struct(*(c.alias(k) for k, c in fields.items()))

    def mixed(x: Column) -> Column:
        moved = feistel(x["values"], x["choices"], x["kind"], key)
        return F.struct(x["t"].alias("t"), x["kind"].alias("kind"), x["chars"].alias("chars"), x["choices"].alias("m"), moved.alias("moved"))

    def written(x: Column) -> Column:
        def symbol(c: Column, i: Column) -> Column:
            return F.when(F.get(x["m"], i) > 1, F.char((_base(c) + F.get(x["moved"], i)).cast("bigint"))).otherwise(c)

        text = F.array_join(F.transform(x["chars"], symbol), "")
        return F.struct(x["t"].alias("t"), x["kind"].alias("kind"), x["moved"].alias("moved"), text.alias("text"))

    out = values
    for step in (read, spread, mixed, written, _spelled):
        out = F.transform(out, step)
    return out


def _chosen(starts: str) -> Column:
    """Places (from 0) and lengths of the values that are replaced, by one walk from left to right over ``starts``, the values that
    begin at each place and the characters from it to the next place (``n, odd, gap``).

    A valid value is taken unless one that was taken before reaches into it; the walk resumes where the taken one ends. A card in odd
    groups gives way to a printed one that begins among its digits.
    """

    def printed_within(i: Column, x: Column) -> Column:
        def look(acc: Column, y: Column) -> Column:
            inside = (acc["at"] < x["n"]) & (y["n"] > 0) & ~y["odd"]
            return F.struct((acc["at"] + y["gap"]).alias("at"), (acc["hit"] | inside).alias("hit"))

        later = F.slice(starts, i + 2, F.lit(MOST_GROUPS))
        return F.aggregate(later, F.struct(x["gap"].alias("at"), F.lit(False).alias("hit")), look, lambda acc: acc["hit"])

    kept = F.transform(starts, lambda x, i: F.struct(
        F.when(x["odd"], F.when(printed_within(i, x), 0).otherwise(x["n"])).otherwise(x["n"]).alias("n"), x["gap"].alias("gap"), i.alias("i")))
    none = F.array().cast("array<struct<i:int,n:int>>")

    def step(acc: Column, x: Column) -> Column:
        take = (acc["over"] <= 0) & (x["n"] > 0)
        taken = F.array_append(acc["taken"], F.struct(x["i"].alias("i"), x["n"].alias("n")))
        reach = F.when(take, x["n"]).otherwise(acc["over"])
        return F.struct(F.greatest(reach - x["gap"], F.lit(0)).alias("over"), F.when(take, taken).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(kept, F.struct(F.lit(0).alias("over"), none.alias("taken")), step, lambda acc: acc["taken"])


def _rebuilt(pieces: str, taken: str, new: str) -> Column:
    """The text of ``pieces`` (one before the first place and one for each place) with the taken values replaced by ``new``."""
    head = F.array_join(F.slice(pieces, F.lit(1), F.get(taken, F.lit(0))["i"] + 1), "")
    count = F.size(pieces) - 1

    def part(v: Column, k: Column) -> Column:
        until = F.coalesce(F.get(taken, k + 1)["i"], count)
        return F.concat(F.get(new, k), F.substr(F.array_join(F.slice(pieces, v["i"] + 2, until - v["i"]), ""), v["n"] + 1, F.lit(1 << 30)))

    return F.concat(head, F.array_join(F.transform(taken, part), ""))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs(text, ...)`` with its text rewritten and ``_replaced``, the number of values replaced.

    Every place where a value may begin is tried, cards and IBANs in each length that ends at a separator (the longest valid one
    counts), then one walk takes them from left to right. Values that fail validation, and all else, stay as they are.
    Null text stays null (0 replaced), as does empty text; rows are independent, so repeated rows are rewritten alike; further
    columns pass through and only names that begin with an underscore are reserved. ``key`` is the secret.
    """
    # A line end before the text, so that the piece before the first place is never empty (split would leave it out).
    rows = docs.withColumn("_text", F.when(F.col("text").rlike(GATE), F.concat(F.lit("\n"), F.col("text"))))
    # Of most texts with digits nothing is left here: they are not taken apart.
    rows = rows.withColumn("_text", F.when(F.col("_text").rlike(STARTS), F.col("_text")))
    taken = [F.regexp_extract_all("_text", F.lit(TAKEN), F.lit(i)) for i in (1, 2, 3)]
    rows = rows.withColumn("_pieces", F.split("_text", STARTS, -1))
    zipped = F.arrays_zip(*(c.alias(k) for c, k in zip(taken, ("fixed", "iban", "card"), strict=True)))
    rows = rows.withColumn("_values", F.transform(zipped, _value))
    starts = F.transform("_values", lambda v, i: F.struct(v["n"].alias("n"), v["odd"].alias("odd"), F.char_length(F.get("_pieces", i + 1)).alias("gap")))
    rows = rows.withColumn("_starts", starts)
    rows = rows.withColumn("_taken", _chosen("_starts"))
    rows = rows.withColumn("_new", pseudonyms(F.transform("_taken", lambda x: F.get("_values", x["i"])), key))
    some = F.size("_taken") > 0
    text = F.when(some, F.substr(_rebuilt("_pieces", "_taken", "_new"), F.lit(2), F.lit(1 << 30)))
    columns = [F.coalesce(text, F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return rows.select(*columns, F.when(some, F.size("_taken")).otherwise(0).alias("_replaced"))
