"""Golden pairs of the normalizers."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltworks import refdata
from siltworks.functions import normalize as N


def V(value):
    return (value, None)


W = "2019-10-30"
CASES = [
    (N.trim, [("\tred   kite ", "red kite"), (" \n ", None), ("\u00a0q\u00a0 r", "q r"), (None, None)]),
    (N.null_tokens, [(t, None) for t in ["#N/A", "--", "Nil", "NaN", "  NA", "?"]] + [(" nada ", " nada ")]),
    (N.email, [("\tMax.Berg@Mail.Example.NET", V("Max.Berg@mail.example.net")), ("max berg", ("max berg", "email_invalid")), ("max@@example.net", ("max@@example.net", "email_invalid")), ("max.@example.net", ("max.@example.net", "email_invalid")), ("max@nodot", ("max@nodot", "email_invalid")), (None, V(None))]),
    (lambda c: N.phone(c, F.lit("DE")), [("0171 8765432", V("+491718765432")), ("0171-KUNDE", ("0171-KUNDE", "phone_invalid")), ("0171", ("0171", "phone_invalid")), ("+33 6 45 67 89 10", V("+33645678910"))]),
    (lambda c: N.phone(c, F.lit("GB")), [("(07700) 900 461", V("+447700900461"))]),
    (lambda c: N.phone(c, F.lit("Spain")), [("612 34 56 78", V("+34612345678"))]),
    (N.phone, [("0645678910", ("0645678910", "phone_unparseable"))]),
    (N.country, [("Norway", V("NO")), ("no", V("NO")), ("NOR", V("NO")), ("Suomi", V("FI")), ("Great Britain", V("GB")), ("K.S.A", ("K.S.A", "country_unknown")), ("Burma", V("MM")), ("Atlantis", ("Atlantis", "country_unknown")), (" brasil. ", V("BR"))]),
    (N.currency, [("chf", V("CHF")), ("Swiss Franc", V("CHF")), ("¥", ("¥", "currency_ambiguous")), ("Galleon", ("Galleon", "currency_unknown")), ("₹", V("INR"))]),
    (N.boolean, [(t, V("true")) for t in ("on", "T", "Да", " yes ")] + [(t, V("false")) for t in ("OFF", "f", "нет")] + [("perhaps", ("perhaps", "boolean_invalid"))]),
    (N.decimal, [("8,765,432.10", V("8765432.10")), ("8.765.432,10", V("8765432.10")), ("64,25", V("64.25")), ("£ 7,310.05", V("7310.05")), ("(82.5)", V("-82.5")), ("9 870,5", V("9870.5")), ("3,210", ("3,210", "decimal_ambiguous")), ("n.a.", ("n.a.", "decimal_invalid")), ("4.3.2", ("4.3.2", "decimal_invalid")), ("6.125", V("6.125")), ("1,2,3", V("123")), ("0,125", ("0,125", "decimal_ambiguous")), ("-€8", ("-€8", "decimal_invalid")), ("€-8", V("-8")), ("12.5%", V("12.5")), ("31 kg", V("31")), ("(-4)", V("-4")), (".75", V("0.75")), ("00061", V("61")), ("7.654.321", V("7654321"))]),
    (N.integer, [("318", V("318")), ("318.00", V("318")), ("3 18", V("318")), ("31.8", ("31.8", "integer_invalid")), ("-0031", V("-31")), ("+9", V("9")), ("-0", V("0"))]),
    (N.date, [(t, V(W)) for t in ("30/10/2019", "Oct 30 2019", "30 Oct 2019", "30.10.2019", "October 30, 2019", "2019-10-30", "2019-10-30T06:07:08", "2019-10-30 6:07", "10-30-2019")] + [("07/08/2019", ("2019-08-07", "date_ambiguous")), ("30/02/2019", ("30/02/2019", "date_invalid")), ("next week", ("next week", "date_invalid")), ("08/08/2019", V("2019-08-08")), ("2019-11-31", ("2019-11-31", "date_invalid")), ("7/8/69", ("2069-08-07", "date_ambiguous"))]),
    (lambda c: N.date(c, True), [("07/08/2019", V("2019-08-07")), ("08/30/2019", V("2019-08-30"))]),
    (lambda c: N.date(c, False), [("07/08/2019", V("2019-07-08"))]),
    (N.datetime, [("2019-10-30T06:07:08Z", V("2019-10-30 06:07:08+00:00")), (W, V("2019-10-30 00:00:00")), ("07/08/2019 6:07", V("2019-07-08 06:07:00")), ("noon", ("noon", "datetime_invalid")), ("2019-10-30 06:07:08.5-0330", V("2019-10-30 06:07:08-03:30")), ("2019-10-30 06:61", ("2019-10-30 06:61", "datetime_invalid"))]),
    (N.date, [(x, V("2019-10-30")) for x in ("Oct 30, 2019", "October 30 2019", "30 Oct 2019", "30-Oct-2019", "30/oct/19", "2019-Oct-30", "2019 October 30", "Oct-2019-30", "30 2019 Oct", "Wed, 30 Oct 2019", "Wednesday, October 30th, 2019", "30th of October 2019", "on 30 October, 2019", "2019/10/30", "2019.10.30", "20191030", "30Oct2019", "10 30 2019", "30 10 2019", "Oct. 30, 2019", "20191030T0607", "Wed Oct 30 2019", "19 30 Oct")]),
    (N.date, [(x, (x, "date_invalid")) for x in ("Oct 2019", "30 Oct", "2019", "Octo 30 2019", "30 Oct Nov 2019", "31 Sept 2019", "the 30 Oct 2019", "30 Oct 2019 x", "2019-13-01", "Oct 30 20190", "20191330", "30--", "-", "x")]),
    (N.date, [("03 04 2019", V("2019-03-04")), ("03/04/2019", ("2019-04-03", "date_ambiguous")), ("Sept 3 45", V("2045-09-03")), ("3 Sep 70", V("1970-09-03")), ("45-Sep-03", V("2045-09-03"))]),
    (N.datetime, [("Oct 30, 2019 6:07 PM", V("2019-10-30 18:07:00")), ("30 Oct 2019 at 12:05 am", V("2019-10-30 00:05:00")), ("2019-10-30 12 p.m.", V("2019-10-30 12:00:00")), ("Wed, 30 Oct 2019 06:07:08 GMT", V("2019-10-30 06:07:08+00:00")), ("20191030T060708Z", V("2019-10-30 06:07:08+00:00")), ("201910300607", V("2019-10-30 06:07:00")), ("2019-10-30 06:07 EST", V("2019-10-30 06:07:00")), ("2019-10-30 06:07+02", V("2019-10-30 06:07:00+02:00")), ("2019-10-30 13:07 pm", ("2019-10-30 13:07 pm", "datetime_invalid")), ("2019-10-30 6", ("2019-10-30 6", "datetime_invalid"))]),
    (N.url, [("docs.example.org/a?b", V("https://docs.example.org/a?b")), ("two words", ("two words", "url_invalid")), ("Https://x.yz", V("Https://x.yz"))]),
    (N.guard, [("=A1", "'=A1"), ("+A1", "'+A1"), ("-A1", "'-A1"), ("@A1", "'@A1"), ("\rA1", "'\rA1"), ("-17", "-17"), ("+2,25", "+2,25"), ("-4E7", "-4E7"), ("+44 (0) 7700-900461", "+44 (0) 7700-900461"), (" @x", " @x")]),
    (N.mask, [("max.berg@mail.example.net", "m***@m***.example.net"), ("Gate 12-B", "Gate 99-B"), ("Nordlandstrasse", "No***"), ("short", "short")]),
    (lambda c: N.case(c, "title"), [("la rEINE mARGOT", "La Reine Margot"), ("jean-paul", "Jean-paul")]),
    (lambda c: N.phone(c, F.lit("PL")), [("+7 701 234 56 78", V("+77012345678")), ("+7 (912) 345-67-89", V("+79123456789")), ("512 345 678", V("+48512345678")), ("+353 86 123 4567", V("+353861234567")), ("+39 06 1234567", V("+39061234567")), ("+99 512 345 678", ("+99 512 345 678", "phone_unparseable")), ("+852 2123 4567", V("+85221234567")), ("+386 (0)1 234 56 78", V("+38612345678"))]),
    (lambda c: N.phone(c, F.lit("Hungary")), [("06 20 123 4567", V("+36201234567")), ("0036", ("0036", "phone_invalid"))]),
    (N.phone_region, [("+77012345678", "KZ"), ("+79123456789", "RU"), ("+85221234567", "HK"), ("+4812", None), ("48512345678", None), ("+491718765432", "DE"), ("+13105550177", "US"), ("+15145550177", "CA"), ("0171", None), (None, None)]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_golden(spark, case):
    fn, pairs = CASES[case]
    df = spark.createDataFrame([(i, p[0]) for i, p in enumerate(pairs)], "i int, c string")
    for r in df.select("i", fn(F.col("c")).alias("r")).collect():
        got = tuple(r.r) if not isinstance(r.r, (str, type(None))) else r.r
        assert got == pairs[r.i][1], pairs[r.i][0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(max_size=30), min_size=1, max_size=40))
def test_total_and_idempotent(spark, texts):
    """No text fails, and a normalized value is its own normal form."""
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for kind in ("email", "decimal", "integer", "boolean", "url", "date", "currency"):
        once = df.select(N.BY_TYPE[kind](F.col("c")).alias("r")).where("r.warning is null").select(F.col("r.value").alias("v"))
        twice = once.select("v", N.BY_TYPE[kind](F.col("v")).alias("r")).where("r.value <> v or r.warning is not null")
        assert twice.isEmpty(), (kind, twice.collect())


def test_phone_plans():
    """Calling codes are prefix-free, and a region stands once."""
    codes = {c for _, c, _, _ in refdata.PHONE_REGIONS}
    assert len(refdata.PHONE_REGIONS) >= 60 and len({r for r, *_ in refdata.PHONE_REGIONS}) == len(refdata.PHONE_REGIONS)
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert all(len(c) == (1 if c in "17" else 2 if len(c) == 2 else 3) for c in codes)


def test_strip_takes_unicode_white_space(spark):
    """As the pattern did, for every character but surrogates."""
    from siltworks.functions.exprs import strip

    c = F.expr("char_of")
    chars = spark.createDataFrame([(chr(i) + "x" + chr(i),) for i in range(0x3100) if i != 0], "char_of string")
    assert chars.where(strip(c) != F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")).count() == 0
    assert chars.where(strip(c) == "x").count() == 25


def test_patterns_are_tried_once(spark):
    """A date's clock was looked for at each of its sixteen uses, a bound's digits at each of seven; lines were read in as many tasks as the file has splits."""
    from siltworks import queries as Q
    from siltworks.operators.validate import compared

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([("02/01/2024",)], "d string")
    spark.conf.set("spark.sql.maxPlanStringLength", "10000000")
    assert plan(rows.select(N.date(F.col("d"), True).alias("x"))).count(r"\d:\d{2}|\d ?[AaPp]") == 1
    assert plan(rows.select(compared(F.col("d"), "50000").alias("x"))).count(r"0*(\d*)") == 1
    for name in ("conform_lines", "places_issues"):
        assert "RoundRobinPartitioning(12)" in plan(Q.QUERIES[name](spark, "/root/testdata/sf0.001"))
