"""Reference values. ISO countries and currencies come from the JVM; what isn't there is stated here."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import SparkSession

# Tokens for empty cells, and for booleans.
NULL_TOKENS = ("", "n/a", "na", "null", "none", "nil", "-", "--", "—", "?", "#n/a", "nan")
TRUE_TOKENS = ("true", "yes", "y", "1", "t", "on", "да")
FALSE_TOKENS = ("false", "no", "n", "0", "f", "off", "нет")

# Names of countries beside the ISO ones.
COUNTRY_ALIASES = {
    "uk": "GB", "great britain": "GB", "england": "GB", "usa": "US", "u.s.a.": "US", "u.s.": "US", "america": "US",
    "united states of america": "US", "uae": "AE", "u.a.e.": "AE", "emirates": "AE", "russia": "RU", "россия": "RU",
    "ישראל": "IL", "israel": "IL", "holland": "NL", "the netherlands": "NL", "south korea": "KR", "korea": "KR",
    "czechia": "CZ", "czech republic": "CZ", "türkiye": "TR", "turkey": "TR", "vietnam": "VN", "iran": "IR", "syria": "SY",
    "laos": "LA", "bolivia": "BO", "venezuela": "VE", "tanzania": "TZ", "moldova": "MD", "macedonia": "MK",
    "north macedonia": "MK", "ivory coast": "CI", "palestine": "PS", "kosovo": "XK", "hong kong": "HK", "macau": "MO",
    "taiwan": "TW", "brunei": "BN", "cape verde": "CV", "swaziland": "SZ", "burma": "MM", "myanmar": "MM",
    "deutschland": "DE", "españa": "ES", "italia": "IT", "österreich": "AT", "schweiz": "CH", "polska": "PL",
    "sverige": "SE", "norge": "NO", "danmark": "DK", "suomi": "FI", "eesti": "EE", "latvija": "LV", "lietuva": "LT",
    "magyarország": "HU", "românia": "RO", "ελλάδα": "GR", "україна": "UA", "беларусь": "BY", "қазақстан": "KZ",
    "казахстан": "KZ", "мексика": "MX", "brasil": "BR", "nederland": "NL", "belgië": "BE", "belgique": "BE",
    "الإمارات": "AE", "مصر": "EG", "السعودية": "SA", "saudi arabia": "SA", "ksa": "SA",
}
# Symbols and words for currencies; an empty code is ambiguous.
CURRENCY_WORDS = {
    "€": "EUR", "£": "GBP", "₪": "ILS", "¥": "", "$": "", "₽": "RUB", "₹": "INR", "₩": "KRW", "₺": "TRY", "₴": "UAH",
    "د.إ": "AED", "aed": "AED", "dirham": "AED", "us dollar": "USD", "us dollars": "USD", "dollar": "", "euro": "EUR",
    "euros": "EUR", "pound": "GBP", "pounds": "GBP", "sterling": "GBP", "shekel": "ILS", "shekels": "ILS", "nis": "ILS",
    "ruble": "RUB", "rouble": "RUB", "yen": "JPY", "yuan": "CNY", "rmb": "CNY",
}
# Region, calling code, trunk prefix, national numbers: from the national numbering plans that the ITU publishes (E.164), by
# leading digits and lengths of geographic and mobile numbers, without special services. Other regions aren't covered. Of
# regions with one calling code the first is told where nothing else decides.
PHONE_REGIONS = (
    ("AE", "971", "0", r"5[024568]\d{7}|[2-4679]\d{7}"),
    ("AT", "43", "0", r"[1-9]\d{5,12}"),
    ("AU", "61", "0", r"[2-478]\d{8}"),
    ("BE", "32", "0", r"4\d{8}|[1-9]\d{7}"),
    ("BG", "359", "0", r"[2-9]\d{6,8}"),
    ("BH", "973", "", r"[136]\d{7}"),
    ("BR", "55", "0", r"[1-9][1-9]9\d{8}|[1-9][1-9][2-5]\d{7}"),
    ("CH", "41", "0", r"[2-9]\d{8}"),
    ("CL", "56", "", r"[2-9]\d{8}"),
    ("CN", "86", "0", r"1[3-9]\d{9}|10\d{8}|2\d{9}|[3-9]\d{9,10}"),
    ("CO", "57", "", r"3\d{9}|60\d{8}"),
    ("CY", "357", "", r"[29]\d{7}"),
    ("CZ", "420", "", r"[2-7]\d{8}"),
    ("DE", "49", "0", r"1[567]\d{8,9}|[2-9]\d{6,10}"),
    ("DK", "45", "", r"[2-9]\d{7}"),
    ("EE", "372", "", r"5\d{6,7}|[3467]\d{6}"),
    ("EG", "20", "0", r"1[0125]\d{8}|[2-9]\d{7,8}"),
    ("ES", "34", "", r"[6-9]\d{8}"),
    ("FI", "358", "0", r"[1-9]\d{4,10}"),
    ("FR", "33", "0", r"[1-9]\d{8}"),
    ("GB", "44", "0", r"7[1-57-9]\d{8}|[1-3]\d{9}|8\d{9}"),
    ("GR", "30", "", r"2\d{9}|69\d{8}"),
    ("HK", "852", "", r"[2-9]\d{7}"),
    ("HR", "385", "0", r"[1-9]\d{6,8}"),
    ("HU", "36", "06", r"[1-9]\d{7,8}"),
    ("ID", "62", "0", r"8\d{8,11}|[2-79]\d{7,10}"),
    ("IE", "353", "0", r"8[35-9]\d{7}|[1-79]\d{6,8}"),
    ("IL", "972", "0", r"5\d{8}|7\d{8}|[23489]\d{7}"),
    ("IN", "91", "0", r"[1-9]\d{9}"),
    ("IS", "354", "", r"[4-8]\d{6}"),
    ("IT", "39", "", r"3\d{8,9}|0\d{5,10}"),
    ("JO", "962", "0", r"7\d{8}|[2-6]\d{7}"),
    ("JP", "81", "0", r"[789]0\d{8}|[1-9]\d{8}"),
    ("KR", "82", "0", r"1\d{8,9}|[2-6]\d{7,9}"),
    ("KW", "965", "", r"[24569]\d{7}"),
    ("LT", "370", "0", r"[3-6]\d{7}"),
    ("LU", "352", "", r"[2-9]\d{4,10}"),
    ("LV", "371", "", r"[26]\d{7}"),
    ("MX", "52", "", r"[2-9]\d{9}"),
    ("MY", "60", "0", r"1\d{8,9}|[3-9]\d{7,8}"),
    ("NL", "31", "0", r"[1-9]\d{8}"),
    ("NO", "47", "", r"[2-9]\d{7}"),
    ("NZ", "64", "0", r"2\d{7,9}|[3-9]\d{7}"),
    ("OM", "968", "", r"[279]\d{7}"),
    ("PE", "51", "0", r"9\d{8}|[1-8]\d{7}"),
    ("PH", "63", "0", r"9\d{9}|[2-8]\d{7,9}"),
    ("PL", "48", "", r"[1-9]\d{8}"),
    ("PT", "351", "", r"[239]\d{8}"),
    ("QA", "974", "", r"[3-7]\d{7}"),
    ("RO", "40", "0", r"[237]\d{8}"),
    ("RS", "381", "0", r"[1-9]\d{6,9}"),
    ("RU", "7", "8", r"[3489]\d{9}"),
    ("KZ", "7", "8", r"[67]\d{9}"),
    ("SA", "966", "0", r"5\d{8}|1\d{8}"),
    ("SE", "46", "0", r"[1-9]\d{6,8}"),
    ("SG", "65", "", r"[3689]\d{7}"),
    ("SI", "386", "0", r"[1-7]\d{7}"),
    ("SK", "421", "0", r"[2-59]\d{8}"),
    ("TH", "66", "0", r"[689]\d{8}|[2-7]\d{7}"),
    ("TR", "90", "0", r"[2-5]\d{9}"),
    ("TW", "886", "0", r"9\d{8}|[2-8]\d{7,8}"),
    ("UA", "380", "0", r"[3-9]\d{8}"),
    ("US", "1", "1", r"[2-9]\d{2}[2-9]\d{6}"),
    ("CA", "1", "1", r"[2-9]\d{2}[2-9]\d{6}"),
    ("VN", "84", "0", r"[35789]\d{8}|2\d{9}"),
    ("ZA", "27", "0", r"[1-8]\d{8}"),
)
# Canadian area codes; others of calling code 1 count as US.
CANADIAN_AREAS = "204 226 236 249 250 263 289 306 343 354 365 367 368 382 403 416 418 428 431 437 438 450 468 474 506 514 519 548 579 581 584 587 604 613 639 647 672 683 705 709 742 753 778 780 782 807 819 825 867 873 879 902 905".split()
MONTHS = "january february march april may june july august september october november december".split()


#: A month's name, its first three letters, and sept, to its number.
MONTH_WORDS = {w: str(i) for i, name in enumerate(MONTHS, 1) for w in (name, name[:3])} | {"sept": "9"}
#: Words in dates that say nothing: days of the week in full and by their first letters, and these two.
DATE_FILLERS = tuple(w for name in "monday tuesday wednesday thursday friday saturday sunday".split() for w in (name, name[:3])) + ("tues", "thur", "thurs", "on", "of")


@lru_cache(maxsize=1)
def _jvm_names() -> tuple[dict[str, str], dict[str, str]]:
    locale = SparkSession.active()._jvm.java.util.Locale
    countries: dict[str, str] = {}
    for code in locale.getISOCountries():
        one = locale("", code)
        countries |= {code.lower(): code, one.getISO3Country().lower(): code, one.getDisplayCountry(locale.ENGLISH).lower(): code}
    currencies: dict[str, str] = {}
    every = SparkSession.active()._jvm.java.util.Currency.getAvailableCurrencies().toArray()
    for c in every:
        currencies |= {c.getCurrencyCode().lower(): c.getCurrencyCode(), c.getDisplayName(locale.ENGLISH).lower(): c.getCurrencyCode()}
    return countries, currencies


def countries() -> dict[str, str]:
    """Lower-case name or code to alpha-2; the aliases win."""
    return _jvm_names()[0] | COUNTRY_ALIASES


def country_names() -> dict[str, str]:
    """Lower-case name or alias to alpha-2, without the codes of the standard."""
    names, _ = _jvm_names()
    return {n: c for n, c in names.items() if n != c.lower() and len(n) > 3} | COUNTRY_ALIASES


#: Letters with a mark, by their decomposition, and beside them those letters without it.
PLAIN_LETTERS = {c: b for c in map(chr, range(0xC0, 0x250)) if c == c.lower() and (b := unicodedata.normalize("NFD", c)[0]) != c} | {"’": "'"}
#: The shortest part of a name that may tell a country.
LEAST_PART = 4


def name_key(name: str) -> str:
    """Lower case without marks on Latin letters, white space around, and points and spaces at the ends."""
    return name.strip().lower().translate(str.maketrans(PLAIN_LETTERS)).strip(". ")


@lru_cache(maxsize=1)
def country_keys() -> dict[str, str]:
    """Key to alpha-2: of every code, name and alias, where an alias wins; and every part of LEAST_PART letters or more that the names of just one country hold."""
    keys = {name_key(n): c for n, c in countries().items()}
    holders: dict[str, set[str]] = {}
    for name, code in country_names().items():
        key = name_key(name)
        for i in range(len(key)):
            for j in range(i + LEAST_PART, len(key) + 1):
                if key[i] != " " and key[j - 1] != " ":
                    holders.setdefault(key[i:j], set()).add(code)
    return {part: min(codes) for part, codes in holders.items() if len(codes) == 1} | keys


def currencies() -> dict[str, str]:
    """Lower-case name, code or symbol to alpha-3; empty where ambiguous."""
    return _jvm_names()[1] | CURRENCY_WORDS
