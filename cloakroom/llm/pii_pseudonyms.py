"""Format-preserving pseudonyms for personal numbers and dates, in Spark's expressions alone.

Valid card numbers (Luhn), IBANs (mod 97), US social security numbers, telephone
numbers, IPv4 addresses and calendar dates are permuted within their format by a keyed
Feistel network over two residue rings, so equal values stay linked across documents
and ``restore`` gives the originals back. Check digits are made anew; separators,
lengths, a card's first digit and a number's country stay. Slash dates with a day above
12 in the second place are read as mm/dd/yyyy and stay such dates of their century; all
other slash dates are read as dd/mm/yyyy. E-mail addresses keep their
domain and have each letter and digit of the local part shifted by a keyed amount that
depends on the whole address (linked, but not restorable).
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Days of a date's span, counted from 1900-01-01; the product of the two rings.
SPAN = (250, 146)
#: Month-first dates of a century are those with a day above 12: 221 a year (months begin
#: at ``US_MONTHS``) and each 29 February, 22,124 or 22,125; the rings have 22,126 places.
US_MONTHS = (0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202)
US_SPAN = (74, 299)

#: Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TD TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_KNOWN = " ".join(IBAN_LENGTHS.values()).replace(" ", "|")
#: Other countries' IBANs are taken at any length, as far as no known one begins.
_IBANS = "|".join([*(_iban_of(n, c) for n, c in IBAN_LENGTHS.items()), rf"(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?: ?(?!(?<= )(?:{_KNOWN})[0-9]{{2}})[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"])
_DATE = r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
_SSN = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_CARD = r"(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4} [0-9]{6} [0-9]{5}|[0-9]{4}-[0-9]{6}-[0-9]{5})(?![0-9A-Za-z])"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBANS})(?![A-Za-z0-9])",
    "date": rf"(?<![0-9]){_DATE}",
    "ssn": rf"(?<![0-9-]){_SSN}",
    "ip": rf"(?<![0-9.]){_IP}",
    # behind +1, ten digits with separators anywhere; else by the usual separators
    "phone": r"(?<![0-9])(?:\+1[ .-]?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9](?:[ .-]?[0-9]){9})|(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4})(?![0-9])",
    # up to 15 digits, as far as no other value begins behind a space
    "intl": rf"(?<![0-9])\+(?!1[^0-9]|1[0-9]{{10}}(?![0-9]))[1-9](?:(?: (?!{_DATE}|{_SSN}|{_IP}|{_CARD})|[.-])?[0-9]){{7,14}}(?![0-9])",
    "card": rf"(?<![0-9A-Za-z]){_CARD}",
}
ANY = "|".join(PATTERNS.values())


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def _if(test: Column, yes: Column, no: Column) -> Column:
    return F.when(test, yes).otherwise(no)


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b))


def _part(x: Column, at: Column | int, n: Column | int | None = None) -> Column:
    """The characters of ``x`` from place ``at`` (the first is 1), ``n`` of them at most."""
    return F.substr(x, F.lit(at)) if n is None else F.substr(x, F.lit(at), F.lit(n))


def _pair(left: Column, right: Column) -> Column:
    return F.struct(left.alias("l"), right.alias("r"))


class _Expressions:
    """The transformations of one matched string ``x``, as columns.

    They are put together here, not written as SQL text: what Spark's parser keeps of one long
    text of nested lambdas stays in the driver's memory as long as the driver lives.
    """

    def __init__(self, key: str, back: bool):
        self.key, self.back = key, back

    def feistel(self, tag: str, left: Column, right: Column, a: Column | int, b: Column | int) -> Column:
        """struct(l, r) after all rounds: l in Z_a, r in Z_b."""
        a, b = F.lit(a), F.lit(b)
        rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if self.back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

        def digest(i: Column, half: Column) -> Column:
            text = F.concat_ws("|", F.lit(self.key), F.lit(tag), a, b, i, half)
            return F.conv(_part(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")

        def turned(half: Column, by: Column, size: Column) -> Column:
            return F.pmod(half - by if self.back else half + by, size)

        def step(s: Column, i: Column) -> Column:
            left, right = s["l"], s["r"]
            return _if(i % 2 == 0, _pair(turned(left, digest(i, right), a), right), _pair(left, turned(right, digest(i, left), b)))

        return F.aggregate(rounds, _pair(left.cast("bigint"), right.cast("bigint")), step)

    def permuted_digits(self, tag: str, digits: Column) -> Column:
        """A string of digits permuted among those of its length (up to 36 digits)."""
        n = F.length(digits)
        u, v = _div(n, 2).cast("int"), (n - _div(n, 2)).cast("int")
        ten = [F.rpad(F.lit("1"), k + 1, "0").cast("bigint") for k in (u, v)]
        moved = self.feistel(tag, _part(digits, 1, u), _part(digits, u + 1), *ten)
        return _let(moved, lambda h: _if(n < 2, digits, F.concat(F.lpad(h["l"].cast("string"), u, "0"), F.lpad(h["r"].cast("string"), v, "0"))))

    @staticmethod
    def digits(x: Column) -> Column:
        return F.regexp_replace(x, "[^0-9]", "")

    @staticmethod
    def refill(x: Column, new: Column) -> Column:
        """``x`` with its digits replaced, in turn, by those of ``new``."""

        def state(o: Column, k: Column) -> Column:
            return F.struct(o.alias("o"), k.alias("k"))

        def step(s: Column, c: Column) -> Column:
            return _if(c.between("0", "9"), state(F.concat(s["o"], _part(new, s["k"], 1)), s["k"] + 1), state(F.concat(s["o"], c), s["k"]))

        return F.aggregate(F.split(x, ""), state(F.lit(""), F.lit(1)), step, lambda s: s["o"])

    @staticmethod
    def luhn(digits: Column) -> Column:
        """Luhn sum of a digit string, its last digit not doubled."""

        def step(t: Column, j: Column) -> Column:
            d = _part(digits, j, 1).cast("int")
            return t + _if((F.length(digits) - j) % 2 == 1, 2 * d - _if(d > 4, F.lit(9), F.lit(0)), d)

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)

    @staticmethod
    def mod97(text: Column) -> Column:
        """ISO 7064 remainder of letters and digits."""

        def step(t: Column, c: Column) -> Column:
            return _if(c.between("0", "9"), (t * 10 + c.cast("int")) % 97, _if(c == "", t, (t * 100 + F.ascii(c) - 55) % 97))

        return F.aggregate(F.split(text, ""), F.lit(0), step)

    def card(self, x: Column) -> Column:
        def moved(d: Column) -> Column:
            # all but the first and the check digit are permuted
            body = F.concat(_part(d, 1, 1), self.permuted_digits("card", _part(d, 2, F.length(d) - 2)))
            full = _let(body, lambda e: F.concat(e, F.pmod(-self.luhn(F.concat(e, F.lit("0"))), F.lit(10)).cast("string")))
            return _if((self.luhn(d) % 10 == 0) & d.rlike("[1-9]"), _let(full, lambda n: self.refill(x, n)), x)

        return _let(self.digits(x), moved)

    def iban(self, x: Column) -> Column:
        def bare(v: Column) -> Column:
            return F.replace(v, F.lit(" "), F.lit(""))

        def valid(w: Column) -> Column:
            return F.length(w).between(15, 34) & (self.mod97(F.concat(_part(w, 5), _part(w, 1, 4))) == 1)

        def moved(w: Column) -> Column:
            digits = _let(self.digits(_part(w, 5)), lambda z: self.permuted_digits("iban", z))
            bban = _let(digits, lambda p: self.refill(_part(w, 5), p))
            new = _let(bban, lambda y: F.concat(F.lpad((98 - self.mod97(F.concat(y, _part(w, 1, 2), F.lit("00")))).cast("string"), 2, "0"), y))
            return _let(new, lambda m: self.refill(x, self.digits(m)))

        # what is no IBAN may hold a card; its replacement must not make an IBAN, else it is replaced again
        def turn(v: Column, k: Column) -> Column:
            return _let(bare(v), lambda w: _if((k == 1) | valid(w), _replaced_matches(v, PATTERNS["card"], self.card), v))

        cards = F.aggregate(F.sequence(F.lit(1), F.lit(6)), x, turn)
        return _let(bare(x), lambda w: _if(valid(w), moved(w), cards))

    def date(self, x: Column) -> Column:
        iso = _part(x, 5, 1).isin("-", "/")
        year = _if(iso, _part(x, 1, 4), _part(x, 7, 4)).cast("int")
        one, two = _if(iso, _part(x, 6, 2), _part(x, 4, 2)).cast("int"), _if(iso, _part(x, 9, 2), _part(x, 1, 2)).cast("int")
        us = (_part(x, 3, 1) == "/") & (one > 12)
        text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(_if(us, two, one), 2, "0"), F.lpad(_if(us, one, two), 2, "0"))
        a, b = SPAN
        first, span = F.lit(datetime.date(1900, 1, 1)), F.lit(a * b)
        mark = _part(x, _if(iso, F.lit(5), F.lit(3)), 1)

        def shown(g: Column) -> Column:
            text = _if(iso, F.date_format(g, "yyyy-MM-dd"), F.date_format(g, "dd.MM.yyyy"))
            return F.call_function("translate", text, F.lit("-."), F.concat(mark, mark))

        def moved(t: Column) -> Column:
            days = F.datediff(t, first)
            place = F.pmod(days, span)
            new = _let(self.feistel("date", _div(place, b), place % b, a, b), lambda h: F.date_add(first, (days - place + h["l"] * b + h["r"]).cast("int")))
            return _if(t.isNull() | ~F.year(t).between(1600, 2399), x, _if(us, self.us_date(t), _let(new, shown)))

        return _let(F.call_function("try_to_date", text, F.lit("yyyy-MM-dd")), moved)

    def us_date(self, t: Column) -> Column:
        """The date ``t`` as mm/dd/yyyy with a day above 12, permuted among those of its century.

        A place that is no date is permuted again. There are two at most, so three turns do.
        """
        a, b = US_SPAN
        months = F.array(*[F.lit(m) for m in US_MONTHS])
        year, month, day = F.year(t), F.month(t), F.day(t)
        since = _if(_div(year, 100) % 4 == 0, F.lit(0), F.lit(1))  # the century's first leap year, divided by 4
        place = _if((month == 2) & (day == 29), 22100 + _div(year % 100, 4) - since, year % 100 * 221 + months[month - 1] + day - 13)

        def turn(w: Column) -> Column:
            return _let(self.feistel("us date", _div(w, b), w % b, a, b), lambda h: h["l"] * b + h["r"])

        walked = F.aggregate(F.sequence(F.lit(1), F.lit(3)), place.cast("bigint"), lambda w, k: _if((k == 1) | (w >= 22125 - since), turn(w), w))

        def shown(p: Column) -> Column:
            leap = F.concat(F.lit("02/29/"), F.lpad(_div(year, 100) * 100 + (p - 22100 + since) * 4, 4, "0"))
            which = F.size(F.filter(months, lambda v: v <= p % 221))
            common = _let(which, lambda m: F.concat_ws("/", F.lpad(m, 2, "0"), F.lpad(p % 221 - months[m - 1] + 13, 2, "0"), F.lpad(_div(year, 100) * 100 + _div(p, 221), 4, "0")))
            return _if(p >= 22100, leap, common)

        return _let(walked, shown)

    def ssn(self, x: Column) -> Column:
        area = _part(x, 1, 3).cast("int")
        place = (area - _if(area > 666, F.lit(2), F.lit(1))) * 99 + _part(x, 5, 2).cast("int") - 1
        moved = self.feistel("ssn", place, _part(x, 8, 4).cast("int") - 1, 88902, 9999)

        def shown(h: Column) -> Column:
            number = _div(h["l"], 99) + _if(_div(h["l"], 99) >= 665, F.lit(2), F.lit(1))
            return F.concat_ws("-", *[F.lpad(c.cast("string"), n, "0") for c, n in ((number, 3), (h["l"] % 99 + 1, 2), (h["r"] + 1, 4))])

        return _let(moved, shown)

    def ip(self, x: Column) -> Column:
        o = [F.split(x, "[.]")[i].cast("bigint") for i in range(4)]
        moved = self.feistel("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return _let(moved, lambda h: F.concat_ws(".", _div(h["l"], 256), h["l"] % 256, _div(h["r"], 256), h["r"] % 256))

    def phone(self, x: Column) -> Column:
        """North American numbers by their shape: the ten digits behind the country code."""
        code = _if(F.length(self.digits(x)) > 10, F.lit("1"), F.lit(""))
        return _let(F.right(self.digits(x), F.lit(10)), lambda d: _let(self.permuted_digits("phone", d), lambda m: self.refill(x, F.concat(code, m))))

    def intl(self, x: Column) -> Column:
        def moved(d: Column) -> Column:
            body = F.concat(_part(d, 1, 3), self.permuted_digits("intl", _part(d, 4)))
            return _if(F.length(d).between(8, 15), _let(body, lambda n: self.refill(x, n)), x)

        return _let(self.digits(x), moved)

    def email(self, x: Column) -> Column:
        if self.back:
            return x
        at = F.instr(x, "@")

        def shifted(g: Column) -> Column:
            def moved(j: Column) -> Column:
                shift = F.conv(_part(g, 1 + (2 * j) % 62, 2), 16, 10).cast("int")
                c = _part(x, j + 1, 1)
                out = F.when(c.between("a", "z"), F.char(97 + (F.ascii(c) - 97 + 1 + shift % 25) % 26))
                out = out.when(c.between("A", "Z"), F.char(65 + (F.ascii(c) - 65 + 1 + shift % 25) % 26))
                return out.when(c.between("0", "9"), F.char(48 + (F.ascii(c) - 48 + 1 + shift % 9) % 10)).otherwise(c)

            return F.concat(F.array_join(F.transform(F.sequence(F.lit(0), at - 2), moved), ""), _part(x, at))

        return _let(F.sha2(F.concat_ws("|", F.lit(self.key), F.lit("email"), x), 256), shifted)

    def any(self, x: Column) -> Column:
        """The replacement of a match: the first kind whose whole pattern it is."""
        cases = F
        for kind, test in _KINDS:
            cases = cases.when(test(x), getattr(self, kind)(x))
        return cases.otherwise(x)


#: How a match is told apart (the alternatives of ``ANY`` exclude each other on whole matches).
_KINDS = [
    ("email", lambda x: x.contains("@")),
    ("iban", lambda x: x.between("A", "[")),
    ("date", lambda x: x.rlike("^([0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$")),
    ("ssn", lambda x: x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
    ("ip", lambda x: x.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$")),
    ("phone", lambda x: x.rlike("^(?:" + PATTERNS["phone"] + ")$")),
    ("intl", lambda x: x.startswith("+")),
    ("card", lambda x: F.lit(True)),
]


def _replaced_matches(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """``text`` with each match of the pattern replaced by ``new`` of it."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rest = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(rest, F.transform(matches, new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _replaced(text: Column, key: str, back: bool) -> Column:
    return _if(text.rlike("[0-9@]"), _replaced_matches(text, ANY, _Expressions(key, back).any), text)


def session_key(spark: SparkSession) -> str:
    """The secret of the pseudonyms: the session's ``spark.cloakroom.pii.key`` (set one in production)."""
    return spark.conf.get("spark.cloakroom.pii.key", "example key")


def pseudonymize(text: str, key: str) -> Column:
    """The text column named ``text`` with personal values replaced; null stays null."""
    return _replaced(F.col(f"`{text}`"), key, False)


def restore(text: str, key: str) -> Column:
    """Undo ``pseudonymize`` for all kinds but e-mail addresses."""
    return _replaced(F.col(f"`{text}`"), key, True)


def count_values(text: str) -> Column:
    """How many values of the handled formats the text holds (valid or not)."""
    whole = F.col(f"`{text}`")
    return _if(whole.rlike("[0-9@]"), F.regexp_count(whole, F.lit(ANY)), F.lit(0))


def pseudonymize_documents(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_values`` of every row: the whole text with pseudonyms, and how many values were looked at.

    Null texts stay null (no values), empty ones empty. Numbers that fail their check
    (Luhn, mod 97, calendar, ranges) and everything else stay as they are. Repeated rows
    get equal results; other columns are not read. One scan without a shuffle.
    """
    return docs.select(F.col(id_col).alias("doc_id"), pseudonymize(text_col, key).alias("text"), F.coalesce(count_values(text_col), F.lit(0)).alias("n_values"))
