"""Normalizers: a text column to a struct of value and warning. All are native column expressions.

A null gives null without a warning. A value that isn't understood is kept, with a warning code.
Deviations that are intended: a date must be whole, year, month and day; two-digit years are 1970 to 2069;
a leading decimal point keeps its value; dates that begin with the year are never read day-first; phones are checked for
the regions in ``refdata`` only; e-mail syntax is a stated pattern; of a country's subdivisions nothing is known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import refdata
from .exprs import blank_to_null, full_match, let, lookup, normalized, strip, text

Normalizer = Callable[..., Column]


def trim(c: Column) -> Column:
    """Strip, and white space inside as one space; empty is null."""
    return blank_to_null(F.regexp_replace(strip(c), r"(?U)\s+", " "))


def null_tokens(c: Column, extra: tuple[str, ...] = ()) -> Column:
    """Tokens that stand for nothing become null; other values stay as they are."""
    tokens = [*refdata.NULL_TOKENS, *(t.lower() for t in extra)]
    return F.when(F.lower(strip(c)).isin(*tokens), text()).otherwise(c)


def case(c: Column, mode: str) -> Column:
    """upper, lower, or title (each word at single spaces); any other mode changes nothing."""
    return {"upper": F.upper, "lower": F.lower, "title": F.initcap}.get(mode, lambda x: x)(c)


def replace_values(c: Column, table: dict[str, str]) -> Column:
    return F.coalesce(lookup(table, c), c) if table else c


def default_value(c: Column, value: str | None) -> Column:
    return F.coalesce(blank_to_null(c), text(value))


_ATOM = r"[\p{L}\p{N}!#$%&'*+/=?^_`{|}~-]+"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,61}[\p{L}\p{N}])?"
EMAIL = rf"(?=.{{1,254}}\z)(?=[^@]{{1,64}}@){_ATOM}(?:\.{_ATOM})*@(?:{_LABEL}\.)+\p{{L}}(?:[\p{{L}}\p{{N}}-]{{0,61}}[\p{{L}}\p{{N}}])"


def email(c: Column) -> Column:
    def check(v: Column) -> Column:
        lowered = F.concat(F.regexp_extract(v, r"(?s)\A(.*@)[^@]*\z", 1), F.lower(F.regexp_extract(v, r"(?s)@([^@]*)\z", 1)))
        return F.when(~v.contains("@"), normalized(v, F.lit("email_invalid"))).otherwise(let(lowered, lambda e: normalized(e, F.when(~full_match(e, EMAIL), F.lit("email_invalid")))))

    return F.when(c.isNull(), normalized(c)).otherwise(let(strip(c), check))


def _by_calling(of) -> dict[str, str]:
    """For each calling code what ``of`` (trunk, national numbers) gives; the numbers of all regions that share it."""
    shared: dict[str, tuple[str, str]] = {}
    for _, calling, trunk, national in refdata.PHONE_REGIONS:
        held = shared.get(calling)
        shared[calling] = (trunk, national if held is None or held[1] == national else f"{held[1]}|{national}")
    return {calling: of(calling, *x) for calling, x in shared.items()}


_NATIONAL = _by_calling(lambda calling, trunk, national: national)
_WITH_PLUS = _by_calling(lambda calling, trunk, national: f"^{calling}(?:{trunk})?({national})$")
_AT_HOME = {region: f"^(?:{calling}|{trunk})?({national})$" if trunk else f"^(?:{calling})?({national})$" for region, calling, trunk, national in refdata.PHONE_REGIONS}
_CALLING = {region: calling for region, calling, _, _ in refdata.PHONE_REGIONS}
_REGION = {calling: region for region, calling, _, _ in reversed(refdata.PHONE_REGIONS)}
_TWO = [c for c in _NATIONAL if len(c) == 2]


def calling_code(digits: Column) -> Column:
    """The calling code with which an international number begins; no code begins another, so its first digits tell its length."""
    one, two = F.substring(digits, 1, 1), F.substring(digits, 1, 2)
    return F.when(one.isin("1", "7"), one).when(two.isin(*_TWO), two).otherwise(F.substring(digits, 1, 3))


def phone(c: Column, region: Column | str | None = None, code: Column | None = None) -> Column:
    """E.164 of a number valid in its region; ``region`` is a code or a country's name, and ``code`` what ``dimension.country_codes`` found for it."""
    if isinstance(region, str):
        given = region.strip()
        code = text(given.upper() if len(given) == 2 else refdata.country_keys().get(refdata.name_key(given)))
    else:
        given = text() if region is None else strip(region)
        code = F.when(F.length(given) == 2, F.upper(given)).when(F.length(given) > 0, country(given)["value"] if code is None else code)

    def parse(x: Column) -> Column:
        raw, digits, where = x["raw"], F.regexp_replace(x["raw"], r"[^0-9]", ""), x["region"]
        plus, calling = raw.startswith("+"), calling_code(digits)
        told = F.when(plus, F.struct(calling.alias("calling"), lookup(_WITH_PLUS, calling).alias("pattern"))).otherwise(F.struct(lookup(_CALLING, where).alias("calling"), lookup(_AT_HOME, where).alias("pattern")))

        def number(t: Column) -> Column:
            found = F.call_function("regexp_extract", digits, t["pattern"], F.lit(1))
            return F.when(found != "", F.concat(F.lit("+"), t["calling"], found))

        e164 = let(told, number)
        bad = (F.length(digits) < 6) | raw.rlike("[A-Za-z]")
        return F.when(bad, normalized(raw, F.lit("phone_invalid"))).otherwise(let(e164, lambda e: normalized(F.coalesce(e, raw), F.when(e.isNull(), F.lit("phone_unparseable")))))

    return F.when(c.isNull(), normalized(c)).otherwise(let(F.struct(strip(c).alias("raw"), code.alias("region")), parse))


def phone_region(c: Column) -> Column:
    """The region of an E.164 number, or null. Of calling code 1, Canada is told by its area codes."""
    digits = F.substr(c, F.lit(2))
    calling = calling_code(digits)
    matches = F.call_function("regexp_extract", c, F.concat(F.lit(r"^\+"), calling, F.lit("("), lookup(_NATIONAL, calling), F.lit(")$")), F.lit(1)) != ""
    region = F.when((calling == "1") & F.substring(c, 3, 3).isin(*refdata.CANADIAN_AREAS), "CA").when((calling == "7") & F.substring(c, 3, 1).isin("6", "7"), "KZ").otherwise(lookup(_REGION, calling))
    return F.when(matches, region)


def country(c: Column, code: Column | None = None) -> Column:
    """``code``: what ``dimension.country_codes`` found for the value. Without it, in an expression alone, codes, names and aliases are looked up, and no parts of names."""

    def answer(v: Column) -> Column:
        return normalized(F.coalesce(v, strip(c)), F.when(v.isNull(), F.lit("country_unknown")))

    if code is not None:
        return F.when(c.isNull(), normalized(c)).otherwise(answer(code))
    key = F.regexp_replace(F.lower(strip(c)), r"^[. ]+|[. ]+$", "")
    found = F.coalesce(lookup(refdata.countries(), key), lookup(refdata.countries(), F.lower(strip(c))))
    return F.when(c.isNull(), normalized(c)).otherwise(let(found, answer))


def currency(c: Column, code: Column | None = None) -> Column:
    """``code``: what ``dimension.currency_codes`` found for the value; without it the lookup is part of the expression."""

    def answer(v: Column) -> Column:
        return normalized(F.coalesce(blank_to_null(v), strip(c)), F.when(v.isNull(), F.lit("currency_unknown")).when(v == "", F.lit("currency_ambiguous")))

    return F.when(c.isNull(), normalized(c)).otherwise(answer(code) if code is not None else let(lookup(refdata.currencies(), F.lower(strip(c))), answer))


def boolean(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.when(c.isNull(), normalized(c)).when(low.isin(*refdata.TRUE_TOKENS), normalized(F.lit("true"))).when(low.isin(*refdata.FALSE_TOKENS), normalized(F.lit("false"))).otherwise(normalized(c, F.lit("boolean_invalid")))


def decimal(c: Column) -> Column:
    """Plain notation with the scale as written, by text alone. Of two kinds of separators the last is the decimal one; ``1,299`` is ambiguous."""

    def parts(raw: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(raw, r"^[^\d\-+(.]+|^\.(?!\d)[^\d\-+(]*|[^\d)]+$", ""), "[ \u00a0]", "")
        inside = F.when(bare.rlike(r"^\(.*\)$"), F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
        return F.struct(raw.alias("raw"), (bare.rlike(r"^\(.*\)$") | inside.startswith("-")).alias("minus"), F.regexp_replace(F.regexp_replace(inside, r"^-", ""), r"^\++", "").alias("s"))

    def plain(x: Column) -> Column:
        s = x["s"]
        dots, commas = F.size(F.split(s, r"\.")) - 1, F.size(F.split(s, ",")) - 1
        last_dot, last_comma = F.length(s) - F.locate(".", F.reverse(s)), F.length(s) - F.locate(",", F.reverse(s))
        no_commas, no_dots = F.regexp_replace(s, ",", ""), F.regexp_replace(s, r"\.", "")
        both = F.when(last_dot > last_comma, no_commas).otherwise(F.regexp_replace(no_dots, ",", "."))
        only_commas = F.when((commas > 1) | s.rlike(r",\d{3}$"), no_commas).otherwise(F.regexp_replace(s, ",", "."))
        only_dots = F.when(dots <= 1, s).when(s.rlike(r"^[^.]*(\.\d{3})+$"), no_dots)
        number = F.when((dots > 0) & (commas > 0), both).when(commas > 0, only_commas).when(dots > 0, only_dots).otherwise(s)
        ambiguous = s.rlike(r"^\d{0,3},\d{3}$")
        valid = s.rlike(r"^[\d.,]+$")
        # ".5" is written with its zero, "5." without its point, and zeros before a number go
        tidy = F.regexp_replace(F.regexp_replace(F.regexp_replace(number, r"^\.", "0."), r"\.$", ""), r"^0+(?=\d)", "")
        ok = valid & number.isNotNull() & number.rlike(r"^(\d+\.?\d*|\.\d+)$")
        return F.when(valid & ambiguous, normalized(x["raw"], F.lit("decimal_ambiguous"))).when(F.coalesce(ok, F.lit(False)), normalized(F.concat(F.when(x["minus"], F.lit("-")).otherwise(F.lit("")), tidy))).otherwise(normalized(x["raw"], F.lit("decimal_invalid")))

    return F.when(c.isNull(), normalized(c)).otherwise(let(let(strip(c), parts), plain))


def integer(c: Column) -> Column:
    def read(raw: Column) -> Column:
        digits = F.regexp_replace(F.regexp_replace(raw, r"\.0+$", ""), r"^\+", "")
        tidy = F.regexp_replace(F.regexp_replace(digits, r"^(-?)0+(?=\d)", "$1"), r"^-0$", "0")
        return F.when(raw.rlike(r"^[+-]?\d+(\.0+)?$"), normalized(tidy)).otherwise(normalized(c, F.lit("integer_invalid")))

    return F.when(c.isNull(), normalized(c)).otherwise(let(F.regexp_replace(strip(c), " ", ""), read))


SLASHED = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4}|\d{2})$"


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _number(c: Column) -> Column:
    return c.try_cast("int")


def _year(y: Column) -> Column:
    """Four digits of a year of two or four."""
    return F.when(F.length(y) == 4, y).when(F.length(y) == 2, F.concat(F.when(_number(y) < 70, F.lit("20")).otherwise(F.lit("19")), y))


def _numbers(a: Column, b: Column, y: Column, dayfirst: Column) -> Column:
    """Day and month in either order, which gives way where only the other is possible, and the year."""
    day_leads = F.when((_number(a) > 12) & (_number(b) <= 12), True).when((_number(b) > 12) & (_number(a) <= 12), False).otherwise(dayfirst)
    return F.when(day_leads, _date(_year(y), b, a)).otherwise(_date(_year(y), a, b))


#: A date is written of numbers and words in any of these orders: m a month's word, n a number, y one that must be a year as it has
#: more than two digits or exceeds 31. For each the places of year, month and day.
ORDERS = {"mny": (3, 1, 2), "mnn": (3, 1, 2), "myn": (2, 1, 3), "nmy": (3, 2, 1), "nmn": (3, 2, 1), "ymn": (1, 2, 3), "nym": (2, 3, 1), "nnm": (1, 3, 2), "ynm": (1, 3, 2), "ynn": (1, 2, 3)}


def written_date(raw: Column, dayfirst: Column) -> Column:
    """The date of numbers and words, or null. Between them stand spaces, commas, points, slashes or hyphens; names of days, ``on``, ``of`` and endings as in 3rd say nothing. Eight digits are year, month and day."""
    low = F.regexp_replace(F.lower(raw), r"(?<=\d)(st|nd|rd|th)\b", "")
    well = low.rlike(r"^(?:(?:\d{1,4}|[a-z]+)(?:[\s,.;/-]+|(?<=\d)(?=[a-z])|(?<=[a-z])(?=\d)|$)){3,6}$")
    tokens = F.filter(F.regexp_extract_all(low, F.lit(r"\d+|[a-z]+"), F.lit(0)), lambda t: ~t.isin(*refdata.DATE_FILLERS))

    def resolve(t: Column) -> Column:
        kinds = F.array_join(F.transform(t, lambda x: F.when(x.isin(*refdata.MONTH_WORDS), "m").when(x.rlike("^[a-z]"), "?").when((F.length(x) > 2) | (_number(x) > 31), "y").otherwise("n")), "")
        part = lambda i: F.get(t, F.lit(i - 1))
        out = F.when(kinds.isin("nnn", "nny"), _numbers(part(1), part(2), part(3), dayfirst))
        for order, (y, m, d) in ORDERS.items():
            month = lookup(refdata.MONTH_WORDS, part(m)) if order[m - 1] == "m" else part(m)
            out = out.when(kinds == order, _date(_year(part(y)), month, part(d)))
        return out

    digits = F.when(raw.rlike(r"^\d{8}$"), F.try_to_date(raw, "yyyyMMdd"))
    return F.when(well, let(tokens, resolve)).otherwise(digits)


def date_of(raw: Column, dayfirst: Column) -> Column:
    """The date of a stripped text, or null: ISO, slashed, or as ``written_date`` reads it."""
    part = lambda i: F.regexp_extract(raw, SLASHED, i)
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(raw, "yyyy-MM-dd"))
    parts = F.struct(part(1).alias("a"), part(2).alias("b"), part(3).alias("y"))
    return iso.when(raw.rlike(SLASHED), let(parts, lambda p: _numbers(p["a"], p["b"], p["y"], dayfirst))).otherwise(written_date(raw, dayfirst))


#: The day, then hour, minute, second, half of the day and zone: an offset, Z, UTC or GMT, or a word of capitals that says nothing.
_CLOCK = r"^(.*?)(?:(?:[ T,]| at )+(\d{1,2})(?::(\d{2}))?(?::(\d{2})(?:[.,]\d+)?)? ?([AaPp]\.?[Mm]\.?)?)? ?\(?(Z|[+-]\d{2}(?::?\d{2})?|[A-Z]{3,5})?\)?$"
#: Only with one of these there's a clock: an hour and a minute, or an hour of a half day.
_HAS_CLOCK = r"\d:\d{2}|\d ?[AaPp]\.?[Mm]\b"
_COMPACT = r"^(\d{8})T?(\d{2})(\d{2})(\d{2})?(Z?)$"


def _split_clock(raw: Column) -> Column:
    """Day, hour, minute, second and zone of a text; what it's told by is looked for once."""
    return let(F.struct(raw.alias("raw"), raw.rlike(_COMPACT).alias("compact"), raw.rlike(_HAS_CLOCK).alias("clock")), _clock_parts)


def _clock_parts(x: Column) -> Column:
    raw, compact, clock = x["raw"], x["compact"], x["clock"]
    part = lambda i: F.regexp_extract(raw, _CLOCK, i)
    packed = lambda i: F.regexp_extract(raw, _COMPACT, i)
    pick = lambda i, j, other: F.when(compact, packed(i)).when(clock, part(j)).otherwise(other)
    nothing = F.lit("")
    half = F.when(clock & ~compact, F.lower(F.substring(part(5), 1, 1))).otherwise(nothing)
    hour = pick(2, 2, nothing)
    hour = F.when(half == "p", F.when(_number(hour).between(1, 11), (_number(hour) + 12).cast("string")).when(_number(hour) == 12, hour).otherwise(F.lit("99"))).when(half == "a", F.when(_number(hour) == 12, F.lit("0")).when(_number(hour).between(1, 11), hour).otherwise(F.lit("99"))).otherwise(hour)
    return F.struct(raw.alias("raw"), pick(1, 1, raw).alias("day"), hour.alias("h"), pick(3, 3, nothing).alias("m"), pick(4, 4, nothing).alias("s"), pick(5, 6, nothing).alias("zone"))


def _clock_valid(x: Column) -> Column:
    low = lambda n, most: F.coalesce(_number(blank_to_null(x[n])), F.lit(0)) < most
    return (x["h"] == "") | (low("h", 24) & low("m", 60) & low("s", 60))


def date(c: Column, dayfirst: Column | bool | None = None) -> Column:
    """ISO date. Without ``dayfirst`` (or where it's null) a slashed date that could be read both ways is read day-first, with a warning, and other numbers are month-first."""
    forced = (F.lit(dayfirst) if dayfirst is None or isinstance(dayfirst, bool) else dayfirst).cast("boolean")

    def read(x: Column) -> Column:
        a, b = F.regexp_extract(x["day"], SLASHED, 1), F.regexp_extract(x["day"], SLASHED, 2)
        doubtful = forced.isNull() & x["day"].rlike(SLASHED) & (x["h"] == "") & (_number(a) != _number(b)) & (_number(a) <= 12) & (_number(b) <= 12)
        found = F.when(_clock_valid(x), date_of(x["day"], F.coalesce(forced, x["day"].rlike(SLASHED))))
        return let(found, lambda d: F.when(d.isNull(), normalized(x["raw"], F.lit("date_invalid"))).otherwise(normalized(F.date_format(d, "yyyy-MM-dd"), F.when(doubtful, F.lit("date_ambiguous")))))

    return F.when(c.isNull(), normalized(c)).otherwise(let(let(strip(c), _split_clock), read))


def datetime(c: Column, dayfirst: Column | bool | None = None) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` with the offset as written (Z as +00:00); slashed dates are month-first unless ``dayfirst``."""
    forced = (F.lit(dayfirst) if dayfirst is None or isinstance(dayfirst, bool) else dayfirst).cast("boolean")

    def read(x: Column) -> Column:
        found = F.when(_clock_valid(x), date_of(x["day"], F.coalesce(forced, F.lit(False))))
        two = lambda n: F.lpad(F.when(x[n] == "", F.lit("0")).otherwise(x[n]), 2, "0")
        offset = F.regexp_replace(F.regexp_replace(x["zone"], r"^(...)(\d\d)$", "$1:$2"), r"^([+-]\d\d)$", "$1:00")
        zone = F.when(x["zone"].isin("Z", "UTC", "GMT"), F.lit("+00:00")).when(x["zone"].rlike("^[A-Z]"), F.lit("")).otherwise(offset)
        return let(found, lambda d: F.when(d.isNull(), normalized(x["raw"], F.lit("datetime_invalid"))).otherwise(normalized(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" "), two("h"), F.lit(":"), two("m"), F.lit(":"), two("s"), zone))))

    return F.when(c.isNull(), normalized(c)).otherwise(let(let(strip(c), _split_clock), read))


def url(c: Column) -> Column:
    def read(raw: Column) -> Column:
        valid = raw.rlike(r"(?iU)^(https?://)?([\w-]+\.)+[\w-]{2,}(/\S*)?\z")
        return F.when(~valid, normalized(raw, F.lit("url_invalid"))).otherwise(normalized(F.when(F.lower(raw).rlike("^https?://"), raw).otherwise(F.concat(F.lit("https://"), raw))))

    return F.when(c.isNull(), normalized(c)).otherwise(let(strip(c), read))


#: The normalizer of each typed field.
BY_TYPE: dict[str, Normalizer] = {"email": email, "phone": phone, "country": country, "currency": currency, "boolean": boolean, "decimal": decimal, "integer": integer, "date": date, "datetime": datetime, "url": url}


# What of the cells that begin as a formula does is a number or a phone number.
NUMBERS = r"[+-]?(\d+([.,]\d+)?|[.,]\d+)([eE][+-]?\d+)?|\+\d[\d\s\-()]{5,}"


def guard(c: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula; numbers and phone numbers stay."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~strip(c).rlike(f"^({NUMBERS})$"), F.concat(F.lit("'"), c)).otherwise(c)


def mask(c: Column) -> Column:
    """A shape that tells nothing: first letters of an e-mail, 9 for digits, two characters of long texts."""
    mail = r"^([^@\s])[^@\s]*@([^@\s.])[^@\s.]*(\.[^@\s]+)$"
    v = strip(c)
    return F.when(v.rlike(mail), F.regexp_replace(v, mail, "$1***@$2***$3")).when(v.rlike(r"\d"), F.regexp_replace(v, r"\d", "9")).when(F.length(v) > 12, F.concat(F.substring(v, 1, 2), F.lit("***"))).otherwise(v)
