"""Personal data replaced by pseudonyms of the same format: a keyed permutation of valid values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auctionflow.llm.matches import characters, found, gaps

ROUNDS = 8
#: What is looked for, in this order where two start at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": (r"(?<![0-9A-Za-z])(?:\+[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?[0-9]{2,4}|(?<=[0-9][ .-]|\+[0-9]{1,3})[0-9]{2,4}"
              r"|[2-9][0-9]{2}(?=[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])))(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])"),
    "card": r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: A calendar cycle of 400 years, as a product.
FIRST_DAY, WEEKS, DAYS = "1800-01-01", 189, 773
ALL = "|".join(f"(?:{p})" for p in PATTERNS.values())


#: Where a card may start, and the digits of cards of known issuers.
CARD_START = r"(?<![0-9A-Za-z.+-])"
ISSUED = ("^(?:4(?:[0-9]{12}|[0-9]{15}|[0-9]{18})|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[0689][0-9]{12}|"
          "35[0-9]{14}|6[0-9]{15,18})$")


def _symbol(value: Column, size: Column | int, base: Column | int = 0) -> Column:
    """One place of a value: `value` of `size` possible ones, written as character `base` + value."""
    cast = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return F.struct(cast(value).alias("x"), cast(size).alias("m"), cast(base).alias("b"))


def feistel(symbols: Column, key: str, kind: str, forward: bool = True) -> Column:
    """A keyed permutation of the values of `symbols`, an array of places (see `_symbol`).

    Places at even and odd positions are the two halves. Each round adds to every place of one
    half a hash of the key, the round, the place and the whole other half, modulo the place's
    size, which the same rounds in reverse subtract."""
    def step(state: Column, r: Column) -> Column:
        other = F.concat_ws(",", F.transform(F.filter(state, lambda e, i: i % 2 != r % 2), lambda e: e["x"].cast("string")))

        def place(e: Column, i: Column) -> Column:
            digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), i.cast("string"), other).cast("binary"), 256)
            drawn = F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")
            x = F.pmod(e["x"] + drawn, e["m"]) if forward else F.pmod(e["x"] - F.pmod(drawn, e["m"]), e["m"])
            return F.when(i % 2 == r % 2, F.struct(x.alias("x"), e["m"].alias("m"), e["b"].alias("b"))).otherwise(e)

        return F.transform(state, place)

    order = F.sequence(F.lit(0), F.lit(ROUNDS - 1)) if forward else F.sequence(F.lit(ROUNDS - 1), F.lit(0))
    return F.aggregate(order, symbols, step)


def permute(symbols: Column, key: str, kind: str) -> Column:
    """A permutation without fixed points: to the far side, one step on at the first place, and back."""
    moved = F.transform(feistel(symbols, key, kind), lambda e, i: F.struct(
        F.when(i == 0, F.pmod(e["x"] + 1, e["m"])).otherwise(e["x"]).alias("x"), e["m"].alias("m"), e["b"].alias("b")))
    return feistel(moved, key, kind, forward=False)


def _written(symbols: Column) -> Column:
    return F.array_join(F.transform(symbols, lambda e: F.char(e["b"] + e["x"])), "")


def _alphanumeric(text: Column) -> Column:
    """Digits, capitals and small letters as places of 10 and 26."""
    base = lambda c: F.when(c <= "9", 48).when(c <= "Z", 65).otherwise(97)
    return F.transform(characters(text), lambda c: _symbol(F.ascii(c) - base(c), F.when(c <= "9", 10).otherwise(26), base(c)))


def _refill(template: Column, text: Column) -> Column:
    """`template` with its ASCII letters and digits replaced by those of `text`, one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    return F.aggregate(characters(template), start, lambda s, c: F.when(
        c.rlike("[A-Za-z0-9]"), F.struct(F.concat(s["out"], text.substr(s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))
    ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))), lambda s: s["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(body: Column) -> Column:
    """Check digit of a string of digits."""
    total = F.aggregate(F.transform(F.reverse(characters(body)), lambda c, i: F.when(
        i % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int"))),
        F.lit(0), lambda s, x: s + x)
    return ((10 - total % 10) % 10).cast("string")


def mod97(text: Column) -> Column:
    return F.aggregate(characters(text), F.lit(0), lambda s, c: F.when(
        c <= "9", (s * 10 + F.ascii(c) - 48) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97))


def _front(text: Column, n: Column | int) -> Column:
    return text.substr(F.lit(1), n if isinstance(n, Column) else F.lit(n))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    name = F.substring_index(m, "@", 1)
    plain = F.regexp_replace(name, "[^A-Za-z0-9]", "")
    return F.lit(True), F.concat(_refill(name, _written(permute(_alphanumeric(plain), key, "email"))), F.lit("@"), F.substring_index(m, "@", -1))


def _date(m: Column, key: str) -> tuple[Column, Column]:
    form = (F.when(m.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(m.rlike("^[0-9]{4}/"), "yyyy/MM/dd")
            .when(m.contains("."), "dd.MM.yyyy").when(F.substring(m, 1, 2) > "12", "dd/MM/yyyy").otherwise("MM/dd/yyyy"))
    year = F.regexp_extract(m, "[0-9]{4}", 0)
    two = F.when(m.rlike("^[0-9]{4}"), F.substring(m, 6, 5)).otherwise(F.substring(m, 1, 5))
    swapped = form.startswith("dd")
    month = F.when(swapped, F.substring(two, 4, 2)).otherwise(F.substring(two, 1, 2))
    day = F.when(swapped, F.substring(two, 1, 2)).otherwise(F.substring(two, 4, 2))
    date = F.concat_ws("-", year, month, day).try_cast("date")
    at = F.datediff(date, F.lit(FIRST_DAY).cast("date"))
    new = permute(F.array(_symbol(F.floor(at / DAYS), WEEKS), _symbol(at % DAYS, DAYS)), key, "date")
    then = F.date_add(F.lit(FIRST_DAY).cast("date"), (new[0]["x"] * DAYS + new[1]["x"]).cast("int")).cast("string")
    y, mo, d = F.substring(then, 1, 4), F.substring(then, 6, 2), F.substring(then, 9, 2)
    text = (F.when(form == "yyyy-MM-dd", then).when(form == "yyyy/MM/dd", F.concat_ws("/", y, mo, d))
            .when(form == "dd.MM.yyyy", F.concat_ws(".", d, mo, y)).when(form == "dd/MM/yyyy", F.concat_ws("/", d, mo, y))
            .otherwise(F.concat_ws("/", mo, d, y)))
    return F.coalesce((at >= 0) & (at < WEEKS * DAYS), F.lit(False)), text


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    parts = F.split(m, r"\.")
    new = permute(F.transform(parts, lambda o: _symbol(o, 256)), key, "ip")
    return (F.forall(parts, lambda o: (o.cast("int") <= 255) & (o == o.cast("int").cast("string"))),
            F.array_join(F.transform(new, lambda e: e["x"].cast("string")), "."))


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.split(m, "-")[i].cast("int") for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    new = permute(F.array(_symbol(area - F.when(area > 666, 2).otherwise(1), 898), _symbol(serial - 1, 9999), _symbol(group - 1, 99)), key, "ssn")
    first = new[0]["x"] + F.when(new[0]["x"] >= 665, 2).otherwise(1)
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return valid, F.concat_ws("-", pad(first, 3), pad(new[2]["x"] + 1, 2), pad(new[1]["x"] + 1, 4))


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, body = _front(plain, 2), plain.substr(F.lit(5), F.lit(64))
    new = _written(permute(_alphanumeric(body), key, "iban"))
    check = F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return mod97(F.concat(body, _front(plain, 4))) == 1, _refill(m, F.concat(country, check, new))


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(m)
    n = F.char_length(digits)
    american = ((n == 11) & m.startswith("+1")) | ((n == 10) & ~m.startswith("+"))
    kept = F.when(~m.startswith("+"), 0).when(american, 1).otherwise(
        F.least(F.char_length(F.regexp_extract(m, r"^\+([0-9]{1,3})", 1)), F.lit(3)))
    # the first digits of American areas and exchanges stay within 2 to 9, or 0 and 1
    lead = lambda i: american & i.isin(0, 3)
    places = F.transform(characters(digits.substr(kept + 1, n)), lambda c, i: _symbol(
        F.ascii(c) - F.when(lead(i) & (c >= "2"), 50).otherwise(48),
        F.when(lead(i), F.when(c >= "2", 8).otherwise(2)).otherwise(10), F.when(lead(i) & (c >= "2"), 50).otherwise(48)))
    return n.between(8, 15), _refill(m, F.concat(_front(digits, kept), _written(permute(places, key, "phone"))))


def _card(m: Column, key: str) -> tuple[Column, Column]:
    digits = _digits(m)
    body = _front(digits, F.char_length(digits) - 1)
    new = F.concat(_front(body, 1), _written(permute(_alphanumeric(body.substr(F.lit(2), F.lit(32))), key, "card")))
    return F.endswith(digits, luhn(body)), _refill(m, F.concat(new, luhn(new)))


KINDS = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "iban": _iban, "phone": _phone, "card": _card}


def _pseudonym(m: Column, key: str) -> Column:
    """kind and new value of a match; an invalid one keeps its value and has no kind."""
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    for kind, rule in reversed(KINDS.items()):
        valid, value = rule(m, key)
        mine = m.rlike(f"^(?:{PATTERNS[kind]})$")
        out = F.when(mine & valid, F.struct(F.lit(kind).alias("kind"), value.alias("value"))).otherwise(out)
    return out


def _numbers(text: Column, start: str, unit: str, after: str, sizes: range, least: str) -> Column:
    """Every string of one of the numbers of units after `start`, from all places, the longest first."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(f"{start}(?=({least}(?:{unit}){{{n}}}){after})"), F.lit(1)) for n in reversed(sizes)])


def _valid_numbers(text: Column, key: str, issued: bool) -> Column:
    """The valid account numbers and cards of known issuers in `text`, or all its other valid cards."""
    cards = F.filter(_numbers(text, CARD_START, "[ -]?[0-9]", "(?![0-9A-Za-z])", range(12, 19), "[0-9]"),
                     lambda c: (_digits(c).rlike(ISSUED) == F.lit(issued)) & _card(c, key)[0])
    if not issued:
        return F.array_distinct(cards)
    ibans = F.filter(_numbers(text, "(?<![A-Za-z0-9])", " ?[A-Z0-9]", "(?![A-Za-z0-9])", range(8, 31), "[A-Z]{2}[0-9]{2}"),
                     lambda c: _iban(c, key)[0])
    return F.array_distinct(F.concat(ibans, cards))


def _looked_over(piece: Column, key: str, issued: bool) -> Column:
    """A piece as pieces: a clear one is cut at the valid numbers in it."""
    def cut(numbers: Column) -> Column:
        # of two that start at one place the longer is first
        pattern = F.concat(F.lit("(?<![0-9A-Za-z])(?:"), F.array_join(numbers, "|"), F.lit(")(?![0-9A-Za-z])"))

        def new(m: Column) -> Column:
            mine = m.rlike("^[A-Z]")
            return F.struct(F.when(mine, _iban(m, key)[1]).otherwise(_card(m, key)[1]).alias("value"),
                            F.when(mine, "iban").otherwise("card").alias("kind"))

        hidden = F.transform(F.regexp_extract_all(piece["value"], pattern, F.lit(0)), new)
        return F.flatten(F.zip_with(F.split(piece["value"], pattern, -1), hidden, lambda g, p: F.filter(
            F.array(_clear(g), p), lambda x: x.isNotNull())))

    # one element, so that the numbers are found once
    numbers = F.array(_valid_numbers(piece["value"], key, issued))
    return F.when(piece["kind"].isNotNull(), F.array(piece)).otherwise(F.flatten(F.transform(
        numbers, lambda n: F.when(F.size(n) > 0, cut(n)).otherwise(F.array(piece)))))


def _clear(text: Column) -> Column:
    return F.struct(text.alias("value"), F.lit(None).cast("string").alias("kind"))


def _second_look(between: Column, places: Column, key: str) -> Column:
    """The pieces (value, kind) of a text, with the valid numbers that its invalid matches had swallowed."""
    empty = F.expr("CAST(array() AS array<struct<value: string, kind: string>>)")

    def add(s: Column, x: Column) -> Column:
        more = F.concat(s["open"], x["g"])
        return F.when(x["p"]["kind"].isNull(), F.struct(s["done"].alias("done"), F.concat(more, F.coalesce(x["p"]["value"], F.lit(""))).alias("open"))
                      ).otherwise(F.struct(F.concat(s["done"], F.array(_clear(more), F.struct(x["p"]["value"].alias("value"), x["p"]["kind"].alias("kind")))
                                                    ).alias("done"), F.lit("").alias("open")))

    both = F.zip_with(between, places, lambda g, p: F.struct(g.alias("g"), p.alias("p")))
    pieces = F.aggregate(both, F.struct(empty.alias("done"), F.lit("").alias("open")), add,
                         lambda s: F.concat(s["done"], F.array(_clear(s["open"]))))
    for issued in (True, False):
        pieces = F.flatten(F.transform(pieces, lambda p: _looked_over(p, key, issued)))  # noqa: B023
    return pieces


def pseudonymise(docs: DataFrame, key: str = "corpus", text_col: str = "text") -> DataFrame:
    """`docs` with its text's personal data replaced, and n_private, kinds (of the replaced values in
    order) added; columns of these names are replaced.

    E-mail names, IPv4 addresses, dates, phone, card, account and social security numbers are found
    in the whole text and validated: octets, calendar, length, Luhn and mod-97 checks, issued ranges.
    Each is permuted within its format by a Feistel network keyed with `key`: punctuation, length,
    letter case, country codes and mail domains stay, check digits are made anew, and a value is
    never its own pseudonym. Equal values have equal pseudonyms in all documents, dates also across
    notations. Values that fail validation stay as they are, but for the valid card and account numbers
    that stand in them beside other digits or capitals: those of known issuers first, then the longest. A NULL text stays NULL, an empty one
    empty, with 0 and no kinds; repeated rows and empty tables need nothing special. No shuffle.
    """
    text = F.col(f"`{text_col}`")
    likely = text.rlike("[0-9@]") & text.rlike(ALL)
    none = F.expr("CAST(array() AS array<struct<kind: string, value: string>>)")
    at = "__found"
    out = docs.drop("n_private", "kinds").withColumn(
        at, F.when(likely, F.transform(found(text, ALL), lambda m: _pseudonym(m, key))).otherwise(none))
    again = F.exists(at, lambda p: p["kind"].isNull() & (F.char_length(p["value"]) >= 8))
    simple = F.zip_with(gaps(text, ALL), F.col(at), lambda g, p: F.struct(
        F.concat(g, F.coalesce(p["value"], F.lit(""))).alias("value"), p["kind"].alias("kind")))
    pieces = "__pieces"
    out = out.withColumn(pieces, F.when(F.size(at) > 0, F.when(again, _second_look(gaps(text, ALL), F.col(at), key)).otherwise(simple)))
    written = F.array_join(F.transform(pieces, lambda p: p["value"]), "")
    return out.withColumn(text_col, F.when(F.size(at) > 0, written).otherwise(text)).withColumn(
        "kinds", F.when(F.size(at) > 0, F.filter(F.transform(pieces, lambda p: p["kind"]), lambda k: k.isNotNull())).otherwise(
            F.expr("CAST(array() AS array<string>)"))).withColumn("n_private", F.size("kinds").cast("long")).drop(at, pieces)
