"""Personal data to format-preserving Feistel pseudonyms, in DataFrame functions only.

Validated values are permuted within their own format under a key: card numbers with a valid check
digit stay such, calendar dates stay dates, North American telephone numbers, social security
numbers and IPv4 addresses stay valid ones, and separators stay where they are.  Telephone numbers
with +1 or brackets may have any area code and exchange; those that start with 0 or 1 are a class of
their own, permuted within it.  The permutations are bijections, so equal values get equal pseudonyms
in every document, different values different ones, and the key's holder can undo them.  What doesn't
validate is left alone.

Numbers are of Z_a x Z_b; rounds add a keyed hash of one half to the other, modulo its size.  Letters
and digits of an e-mail address's local part are two halves, too; rounds turn every place of one half,
within small letters, capitals or digits, by its own part of a keyed hash of the other half.  The domain
stays.  A date is permuted as a day, so one date keeps its pseudonym in all of its written forms, but
for day/month/year with a day over 12, which are permuted among themselves: others are month/day/year.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

KINDS = ("email", "card", "phone", "ssn", "ip", "date")
ROUNDS = 8
_octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_year, _month, _day = "(?:18|19|20|21)[0-9]{2}", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
_name = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "date": "|".join([
        rf"(?<![0-9-]){_year}-{_month}-{_day}(?![0-9-])",
        rf"(?<![0-9/.])(?:{_year}/{_month}/{_day}|{_year}\.{_month}\.{_day}|{_day}\.{_month}\.{_year}|{_day}/{_day}/{_year})(?![0-9]|[/.][0-9])",
        rf"(?<![A-Za-z0-9]){_name} [0-9]{{1,2}}, {_year}(?![0-9])",
        rf"(?<![0-9])[0-9]{{1,2}} {_name} {_year}(?![0-9])",
    ]),
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.]){_octet}(?:\.{_octet}){{3}}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])(?:(?:\+1[ .-]?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])|\([0-9]{3}\) ?)[0-9]{3}|[2-9][0-9]{2}[ .-][2-9][0-9]{2})[ .-][0-9]{4}(?![0-9])",
}
#: A run of digit groups of 13 digits or more, up to a group where another kind starts; cards are sought in it.
PATTERNS["card"] = rf"(?<![0-9])(?=[0-9](?:[ -]?[0-9]){{12}})[0-9]++(?:[ -](?!{'|'.join(PATTERNS.values())})[0-9]++)*+"
#: Written forms of a date, told apart by how they begin; the first that fits holds.
DATES = {
    "[0-9]{4}-": "yyyy-MM-dd", "[0-9]{4}/": "yyyy/MM/dd", "[0-9]{4}[.]": "yyyy.MM.dd", "[0-9]{2}[.]": "dd.MM.yyyy",
    f"{_month}/": "MM/dd/yyyy", "[0-9]{2}/": "dd/MM/yyyy",
    "[A-Za-z]{3} ": "MMM d, yyyy", "[A-Za-z]+ ": "MMMM d, yyyy", "[0-9]+ [A-Za-z]{3} ": "d MMM yyyy", "[0-9]+ ": "d MMMM yyyy",
}
#: What a text must hold for any kind but e-mail to be in it; all of them have digits in such places.
_possible = r"[0-9]{4}|[0-9]\.[0-9]|(?:[0-9][ -]?){12}"


def _hash(key: str, *parts: Column) -> Column:
    """60 bits of a keyed hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def _div(p: Column, q: Column) -> Column:
    """Whole division of numbers that aren't negative."""
    return ((p - F.pmod(p, q)) / q).cast("long")


def feistel(value: Column, a: Column, b: Column, key: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1."""
    start = F.struct(_div(value, b).alias("x"), F.pmod(value, b).alias("y"))

    def step(s: Column, i: Column) -> Column:
        left = F.struct(F.pmod(s["x"] + F.pmod(_hash(key, i, s["y"]), a), a).alias("x"), s["y"].alias("y"))
        right = F.struct(s["x"].alias("x"), F.pmod(s["y"] + F.pmod(_hash(key, i, s["x"]), b), b).alias("y"))
        return F.when(i % 2 == 1, left).otherwise(right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["x"] * b + s["y"])


def _number(a: int | Column, b: int | Column) -> tuple[Column, Column]:
    return tuple((F.lit(x) if isinstance(x, int) else x).cast("long") for x in (a, b))


def _padded(value: Column, n: int | Column) -> Column:
    return F.lpad(value.cast("string"), n, "0")


def _only_digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _poured(x: Column, new: Column, kind: str = "[0-9]") -> Column:
    """The characters of ``new`` in place of those of a kind in ``x``; the others stay."""

    def take(s: Column, c: Column) -> Column:
        one = F.struct((s["i"] + 1).alias("i"), F.concat(s["out"], F.substring(new, s["i"], F.lit(1))).alias("out"))
        return F.when(c.rlike(kind), one).otherwise(F.struct(s["i"].alias("i"), F.concat(s["out"], c).alias("out")))

    return F.aggregate(F.split(x, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), take, lambda s: s["out"])


def luhn_sum(digits: Column) -> Column:
    """The check sum's weighted total; a number is valid when it is a multiple of ten."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, c: s + c)


def _card(x: Column, key: str) -> Column:
    """The first digit and the length stay, the check digit is made anew."""
    d = _only_digits(x)
    n = F.length(d) - 2
    high, low = F.floor(n / 2), n - F.floor(n / 2)
    body = F.substring(d, F.lit(2), n)
    power = lambda e: F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(1, 11)]), e.cast("int"))
    moved = F.concat(F.substring(d, 1, 1), _padded(feistel(body.cast("long"), power(high), power(low), f"{key}|card"), n.cast("int")))
    return _poured(x, F.concat(moved, F.pmod(10 - luhn_sum(F.concat(moved, F.lit("0"))) % 10, F.lit(10)).cast("string")))


def _phone(x: Column, key: str) -> Column:
    d = _only_digits(x)
    lead = F.substring(d, F.lit(1), F.length(d) - 10)
    d = F.substring(d, -10, 10)
    part = lambda i, n: F.substring(d, i, n).cast("long")
    area, exchange = part(1, 3), part(4, 3)
    valid = (area >= 200) & (exchange >= 200)
    # The 360,000 other pairs: area codes under 200 with any exchange, then the others with exchanges under 200.
    pair = F.when(valid, (area - 200) * 800 + exchange - 200).when(area < 200, area * 1000 + exchange).otherwise(200_000 + (area - 200) * 200 + exchange)
    side = F.when(valid, 80_000).otherwise(60_000).cast("long")
    v = feistel(pair * 10_000 + part(7, 4), side, side, f"{key}|phone")
    div = lambda p, q: _div(p, F.lit(q).cast("long"))
    new = div(v, 10_000)
    area = F.when(valid, div(new, 800) + 200).when(new < 200_000, div(new, 1000)).otherwise(div(new - 200_000, 200) + 200)
    exchange = F.when(valid, new % 800 + 200).when(new < 200_000, new % 1000).otherwise((new - 200_000) % 200)
    return _poured(x, F.concat(lead, _padded(area, 3), _padded(exchange, 3), _padded(v % 10_000, 4)))


def _ssn(x: Column, key: str) -> Column:
    part = lambda i, n: F.substring(x, i, n).cast("long")
    area = part(1, 3)
    v = feistel(((area - F.when(area > 666, 2).otherwise(1)) * 99 + part(5, 2) - 1) * 9_999 + part(8, 4) - 1, *_number(898 * 99, 9_999), f"{key}|ssn")
    div = lambda p, q: _div(p, F.lit(q).cast("long"))
    new = div(v, 99 * 9_999)
    return F.concat_ws("-", _padded(new + F.when(new >= 665, 2).otherwise(1), 3), _padded(div(v, 9_999) % 99 + 1, 2), _padded(v % 9_999 + 1, 4))


def _ip(x: Column, key: str) -> Column:
    octets = F.transform(F.split(x, r"\."), lambda o: o.cast("long"))
    v = feistel(F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o), *_number(65_536, 65_536), f"{key}|ip")
    return F.concat_ws(".", *[F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def _each_date(x: Column, use) -> Column:
    """``use(pattern)`` for the written form that ``x`` has."""
    out = None
    for begin, form in DATES.items():
        fits = x.rlike(f"^{begin}")
        out = F.when(fits, use(form)) if out is None else out.when(fits, use(form))
    return out


def _is_date(x: Column) -> Column:
    return _each_date(x, lambda form: F.try_to_date(x, form)).isNotNull()


def _date(x: Column, key: str) -> Column:
    """The 400 years from 1800 hold 146,097 = 189 * 773 days."""
    first = F.lit("1800-01-01").cast("date")
    at = lambda n: F.date_add(first, n.cast("int"))
    move = lambda n: feistel(n, *_number(189, 773), f"{key}|date")

    def late(n: Column) -> Column:
        """Moved until the day is over 12 again: of the days 61 % are, so 128 moves are more than ever needed."""
        step = lambda s, i: F.when((i > 1) & (F.dayofmonth(at(s)) > 12), s).otherwise(move(s))
        return F.aggregate(F.sequence(F.lit(1), F.lit(128)), n, step)

    def new(form: str) -> Column:
        n = F.datediff(F.try_to_date(x, form), first).cast("long")
        return F.date_format(at(late(n) if form == "dd/MM/yyyy" else move(n)), form)

    return _each_date(x, new)


def _turned(part: Column, other: Column, key: str, i: Column) -> Column:
    """Each place of ``part`` turned within its class by 16 bits of its own from a keyed hash of ``other``."""
    blocks = F.greatest(F.ceil(F.length(part) / 32), F.lit(1))  # 512 bits are 32 places
    bits = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda b: F.sha2(F.concat_ws("|", F.lit(key), i.cast("string"), b.cast("string"), other).cast("binary"), 512))

    def turn(c: Column, by: Column) -> Column:
        moved = lambda first, size: F.char(F.pmod(F.ascii(c) - first + by, F.lit(size)) + first)
        return F.when(c.between("a", "z"), moved(97, 26)).when(c.between("A", "Z"), moved(65, 26)).when(c.between("0", "9"), moved(48, 10)).otherwise(c)

    by = lambda h, j: F.conv(F.substring(h, 4 * j + 1, F.lit(4)), 16, 10).cast("long")
    whole = F.transform(F.array(F.array_join(bits, "")), lambda h: F.array_join(F.transform(F.split(part, ""), lambda c, j: turn(c, by(h, j))), ""))
    return F.element_at(whole, 1)  # one hash for all places, bound by the outer function


def _email(x: Column, key: str) -> Column:
    """The local part's letters and digits are permuted, what is between them stays."""
    key = f"{key}|email"
    at = F.instr(x, "@")
    local = F.substring(x, F.lit(1), at - 1)
    chars = F.regexp_replace(local, "[^A-Za-z0-9]", "")
    half = F.floor(F.length(chars) / 2).cast("int")
    start = F.struct(F.substring(chars, F.lit(1), half).alias("x"), F.substring(chars, half + 1, F.length(chars)).alias("y"))

    def step(s: Column, i: Column) -> Column:
        left = F.struct(_turned(s["x"], s["y"], key, i).alias("x"), s["y"].alias("y"))
        return F.when(i % 2 == 1, left).otherwise(F.struct(s["x"].alias("x"), _turned(s["y"], s["x"], key, i).alias("y")))

    def single(first: int, size: int) -> Column:  # one character alone has no other half: a number of Z_2 x Z_(size / 2)
        return F.char(feistel((F.ascii(chars) - first).cast("long"), *_number(2, size // 2), key) + first)

    alone = F.when(chars.between("a", "z"), single(97, 26)).when(chars.between("A", "Z"), single(65, 26)).otherwise(single(48, 10))
    many = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["x"], s["y"]))
    new = F.when(F.length(chars) == 1, alone).when(F.length(chars) > 1, many).otherwise(chars)
    return F.concat(_poured(local, new, "[A-Za-z0-9]"), F.substring(x, at, F.length(x)))


def _kind(x: Column) -> Column:
    """The kind of a found value, or null when it doesn't validate."""
    whole = lambda k: x.rlike(f"^(?:{PATTERNS[k]})$")
    return (
        F.when(whole("email"), F.lit("email"))
        .when(whole("date"), F.when(_is_date(x), F.lit("date")))
        .when(whole("ssn"), F.lit("ssn"))
        .when(whole("ip"), F.lit("ip"))
        .when(whole("phone"), F.lit("phone"))
    )


def _cards(x: Column, mark: str) -> Column:
    """A run as parts: from each group on, the longest run of whole groups with 13 to 19 digits and a valid check digit is a card."""
    groups = F.split(x, "(?<=[ -])")
    joined = lambda i, n: F.array_join(F.slice(groups, i, n), "")

    def valid(d: Column) -> Column:
        return F.when(F.length(d).between(13, 19), luhn_sum(d) % 10 == 0).otherwise(False)

    def longest(i: Column) -> Column:
        sizes = F.sequence(F.least(F.lit(19), F.size(groups) - i + 1), F.lit(1), F.lit(-1))
        return F.get(F.filter(sizes, lambda n: valid(_only_digits(joined(i, n)))), F.lit(0))

    def step(s: Column, n: Column, i: Column) -> Column:
        plain = F.struct((i + 1).alias("free"), F.concat(s["out"], joined(i, F.lit(1))).alias("out"))
        card = F.struct((i + n).alias("free"), F.concat(s["out"], F.lit(mark), joined(i, n), F.lit(mark)).alias("out"))
        return F.when(i < s["free"], s).when(n == 0, plain).otherwise(card)

    sizes = F.transform(F.sequence(F.lit(1), F.size(groups)), lambda i: F.struct(i.alias("i"), F.coalesce(longest(i), F.lit(0)).alias("n")))
    marked = F.aggregate(sizes, F.struct(F.lit(1).alias("free"), F.lit("").alias("out")), lambda s, g: step(s, g["n"], g["i"]), lambda s: s["out"])
    return F.transform(F.split(marked, mark), lambda y, i: F.struct(F.when(i % 2 == 1, F.lit("card")).alias("kind"), y.alias("x")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_email`` .. ``n_date`` and ``n_pii`` (long) counting the values replaced.

    Whoever knows ``key`` can undo the pseudonyms, so it is a secret.  All rows stay, repeated ones
    too.  Null and empty texts stay as they are, with counts of 0.  Values at one place are told apart
    in the order of PATTERNS.  Cards are sought at the group boundaries of a run of digits.  Columns of
    ``docs`` that are named like one of the counts are replaced.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    mark, escape, held = "\x01", "\x02", free_name(docs, "parts")
    text = F.coalesce(F.col("text"), F.lit(""))
    safe = F.replace(F.replace(text, F.lit(escape), F.lit(escape + "\x03")), F.lit(mark), F.lit(escape + "\x04"))  # no character of a value
    marked = lambda kinds: F.regexp_replace(safe, "|".join(PATTERNS[k] for k in kinds), f"{mark}$0{mark}")
    mail = F.contains(text, F.lit("@"))
    found = F.split(F.when(mail, marked(PATTERNS)).otherwise(marked([k for k in PATTERNS if k != "email"])), mark)

    def told(x: Column, i: Column) -> Column:
        one = F.array(F.struct(F.when(i % 2 == 1, _kind(x)).alias("kind"), x.alias("x")))
        return F.when((i % 2 == 1) & x.rlike(f"^(?:{PATTERNS['card']})$"), _cards(x, mark)).otherwise(one)

    parts = F.when(mail | text.rlike(_possible), F.flatten(F.transform(found, told)))
    change = {"email": _email, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date}

    def new(p: Column) -> Column:
        out = p["x"]
        for kind in KINDS:
            out = F.when(p["kind"] == kind, change[kind](p["x"], key)).otherwise(out)
        return F.when(p["kind"].isNull(), p["x"]).otherwise(out)

    counts = {f"n_{k}": k for k in KINDS}
    names = [c for c in docs.columns if c.lower() not in ("n_pii", *counts)]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], parts.alias(held))
    joined = F.array_join(F.transform(held, new), "")
    joined = F.replace(F.replace(joined, F.lit(escape + "\x04"), F.lit(mark)), F.lit(escape + "\x03"), F.lit(escape))
    some = F.col(held).isNotNull() & F.exists(held, lambda p: p["kind"].isNotNull())
    count = lambda k: F.when(F.col(held).isNull(), 0).otherwise(F.size(F.filter(held, lambda p: p["kind"] == k))).cast("long")
    out = rows.select(
        *[F.when(some, joined).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
        *[count(k).alias(n) for n, k in counts.items()],
    )
    return out.withColumn("n_pii", sum((F.col(n) for n in counts), F.lit(0).cast("long")))


#: The key's name in the session's settings, and what the query uses where there is none: known to all, so for trials only.
KEY, TRIAL_KEY = "spark.cairn.pii.key", "a key known to all"


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole ``documents`` with pseudonyms, under the key in the session's ``spark.cairn.pii.key``."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(KEY, None) or TRIAL_KEY)
