"""Files to conformed rows and back, review, streams."""

import csv
import io
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from siltworks.errors import ContractError, FileError, MappingError, NotFoundError, TooLargeError
from siltworks.model import TransformSpec, make_contract, next_version, samples, suggest_transforms
from siltworks.operators import assemble, export, mapping, profile, quality, review, similarity, validate
from siltworks.plans.conform import Job, conform
from siltworks.sources.delimited import delimiter_of, encoding_of, headers_of, read_csv
from siltworks.sources.tables import written
from siltworks.sources.xlsx import read_xlsx, sheet_names, workbook, workbooks
from siltworks.streaming import conform_stream
from tests import slow_similarity

TEXT = '﻿Client;E-mail Address;Mobile No.;Country Name;Joined;Extra;Extra\r\n  Dana  Levi ;Dana@EXAMPLE.com;052-555-1234;Israel;21/09/2024;=1+1;x\r\n;bad;123;Isreal;31/02/2025;;\r\n"Q ""a""\nb";dana@example.com;+44 7911 123456;IL;13/01/2024;;\r\n\r\nLast;dana@example.com;(212) 555-0123;USA;03/04/2024;;;;\r\n'


@pytest.fixture(scope="module")
def job(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("in") / "a.csv"
    path.write_bytes(TEXT.encode())
    job = Job(spark, str(path))
    suggested = job.suggest_mapping(samples()["Subscriber"])
    job.confirm({r["source"]: r["target"] for r in suggested.collect()})
    return job


def test_read(job):
    assert job.meta["delimiter"] == ";" and job.meta["columns"][-2:] == ["Extra", "Extra (2)"]
    rows = job.rows.orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == [0, 1, 2, 3]
    assert rows[2]["Client"] == 'Q "a"\nb' and rows[1]["Client"] is None


@pytest.mark.parametrize("size", [40, 300, 1 << 20])
@pytest.mark.parametrize("encoding", ["utf-8", "cp1252"])
def test_records_over_line_ends(spark, tmp_path, size, encoding):
    """Files in splits of a few bytes, with quotes and line ends anywhere, against Python's reader."""
    rng = random.Random(size)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        for k in range(5):
            cells = lambda: [rng.choice(["a", "", " ", "é", "x y", 'q"r', '"a\nb"', '"a\r\n\r\nb,"', '"c,""d"" "', '"e"f', '"' + "long\n" * rng.randint(0, 30) + '"', '""', 'z""', "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16") if encoding == "utf-8" else "ü"]) for _ in range(rng.randint(1, 5))]  # noqa: B023
            text = "h1,h2,h3" + "".join(rng.choice(["\n", "\r\n", "\n\n", "\r" if k == 4 else "\n"]) + ",".join(cells()) for _ in range(60)) + rng.choice(["", "\n", ',"never\nclosed'])
            path = tmp_path / f"{k}.csv"
            path.write_bytes((b"\xef\xbb\xbf" if encoding == "utf-8" and k % 2 else b"") + text.encode(encoding))
            want = [[*(c or None for c in r[:3]), *[None] * (3 - len(r))] for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r)][1:]
            rows, meta = read_csv(spark, str(path))
            got = sorted(rows.collect(), key=lambda r: r["row_index"])
            assert meta["columns"] == ["h1", "h2", "h3"] and [r["row_index"] for r in got] == list(range(len(want)))
            assert [list(r)[1:] for r in got] == want
            if size == 40 and k == 0:
                assert rows.rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_mapping_and_status(job):
    assert job.mapping["Mobile No."] == "mobile" and job.mapping["Extra"] is None
    got = {r["row_index"]: r["row_status"] for r in job.validated().collect()}
    assert got == {0: "ready", 1: "error", 2: "error", 3: "error"}
    codes = {(r["row_index"], r["code"]) for r in job.issues().collect()}
    assert {(1, "required_missing"), (1, "email_invalid"), (1, "phone_invalid"), (1, "date_invalid"), (1, "country_unknown"), (2, "duplicate"), (2, "cross_field"), (3, "duplicate")} == codes
    assert job.summary().first()["ready_pct"] == 25.0


def test_date_order_is_inferred(job):
    assert job.validated().where("row_index = 3").first()["joined_on"] == "2024-04-03"


def test_edit_and_undo(job):
    job.edit(2, "mail", "q@example.com")
    assert job.validated().where("row_index = 3").first()["row_status"] == "ready"
    job.edits = review.undo_last(job.edits)
    assert job.validated().where("row_index = 3").first()["row_status"] == "error"
    job.edits = None


def test_template_replaces_transformations(spark, tmp_path):
    """A template's pairs by header key, an ignored source, and its transformations; the report and the workbook tell of them."""
    (tmp_path / "t.csv").write_text("E-mail Address,Client,Lives in,Other\n A@X.com ,dana levi,Israel,=1+1\nb@y.com,No One,Spain,z\n")
    job = Job(spark, str(tmp_path / "t.csv"))
    suggested = job.suggest_mapping(samples()["Subscriber"])
    assert all(r["confirmed"] == (r["confidence"] == "HIGH") for r in suggested.collect())
    pairs = spark.createDataFrame([("emailaddress", "mail"), ("livesin", None), ("absent", "plan")], "key string, target string")
    merged = {r["source"]: (r["target"], r["confidence"], r["method"], r["confirmed"]) for r in job.apply_template(suggested, pairs, [TransformSpec("trim"), TransformSpec("case", "full_name", {"mode": "upper"}, label="Shout")], "mine").collect()}
    assert merged["E-mail Address"] == ("mail", "HIGH", "template", True) and merged["Lives in"] == (None, "UNMAPPED", "template", True) and merged["Client"][0] == "full_name" and merged["Other"][0] is None
    assert [(r["mail"], r["full_name"], r["residence"]) for r in job.validated().orderBy("row_index").collect()] == [("A@X.com", "DANA LEVI", None), ("b@y.com", "NO ONE", None)]
    told = job.report("all").first()
    assert (told["template"], told["exported"], told["rows"], [t["kind"] for t in told["transformations"]]) == ("mine", 2, 2, ["trim", "case"]) and told["mapping"][0].asDict() == {"source": "E-mail Address", "target": "mail"}
    lines = export.report_rows(told)
    assert ("Source file", "t.csv") in lines and ("Mapping", "") in lines and ("case", "Shout") in lines and ("Lives in", "(ignored)") in lines
    book = job.workbooks("all").first()["content"]
    (tmp_path / "b.xlsx").write_bytes(book)
    sheet, _ = read_xlsx(spark, str(tmp_path / "b.xlsx"), "Import Report")
    assert ["Template", "mine"] in [list(r)[1:] for r in sheet.collect()]


def test_ten_edits(spark, job):
    """Edits give what a full run gives, and their plans don't grow."""
    sizes = []
    for k in range(10):
        job.edit(k % 4, "mail" if k % 3 else "full_name", ["dana@example.com", "new@example.com", "bad", None, "last@example.com"][k % 5])
        sizes.append(len(job.validated()._jdf.queryExecution().analyzed().toString()))
    pick = lambda d: sorted((r["row_index"], r["row_status"], r["mail"], r["full_name"], [i["code"] for i in r["issues"]]) for r in d.collect())
    quick = pick(job.validated())
    full = conform(job.rows, job.contract, job.mapping, job.specs, edits=job.edits)
    assert quick == pick(full) and max(sizes[2:]) <= 1.1 * sizes[1]
    with pytest.raises(NotFoundError):
        job.edit(99, "mail", "x")
    job.edits = None


def test_exports(spark, job, tmp_path):
    v = job.validated()
    errors = {r["_row"]: r["_issues"] for r in export.error_rows(v, job.contract.names).collect()}
    assert errors[4] == "mail: Duplicate value" and set(errors) == {3, 4, 5}
    export.write_csv(export.scope(v, "ready"), ["full_name", "mail"], str(tmp_path / "out"))
    text = "".join(p.read_text(newline="") for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.endswith("Dana Levi,Dana@example.com\r\n")
    (tmp_path / "b.xlsx").write_bytes(workbooks(v, job.contract.names, [("rows", "4")]).first()["content"])
    back, meta = read_xlsx(spark, str(tmp_path / "b.xlsx"))
    assert meta["sheet_names"] == ["Data", "Import Report"]
    assert [r["mail"] for r in back.orderBy("row_index").collect()] == [r["mail"] for r in v.orderBy("row_index").collect()]
    report = export.report(v, validate.issue_rows(v), "Customer", "a.csv").first()
    assert report["rows"] == 4 and report["top_issues"][0]["code"] == "duplicate"


def test_xlsx_trailing_columns_and_sheets(spark, tmp_path):
    data = workbook(["a", "", ""], [["1", None, None], [None, None, None], ["2", "x", None]])
    (tmp_path / "c.xlsx").write_bytes(data)
    back, meta = read_xlsx(spark, str(tmp_path / "c.xlsx"))
    assert meta["columns"] == ["a", "Column 2"] and back.count() == 2
    assert sheet_names(data) == ["Data", "Import Report"]
    with pytest.raises(Exception, match="no sheet named"):
        read_xlsx(spark, str(tmp_path / "c.xlsx"), "None such")


def test_file_guards(spark, tmp_path):
    assert encoding_of("é".encode()) == "utf-8" and encoding_of(b"caf\xe9 " * 3 + b"x" * 200) == "windows-1252"
    assert delimiter_of("a|b\n1|2\n") == "|"
    assert headers_of(["Email", "Email", ""]) == ["Email", "Email (2)", "Column 3"]
    (tmp_path / "e.csv").write_bytes(b"")
    (tmp_path / "n.csv").write_bytes(b"a,b\n\0,1\n")
    (tmp_path / "w.csv").write_bytes(b"name,x\ncaf\xe9," + b"y" * 100 + b"\n")
    for name, error in (("e.csv", FileError), ("n.csv", FileError)):
        with pytest.raises(error):
            read_csv(spark, str(tmp_path / name))
    with pytest.raises(TooLargeError):
        read_csv(spark, str(tmp_path / "w.csv"), max_bytes=5)
    rows, meta = read_csv(spark, str(tmp_path / "w.csv"))
    assert meta["encoding"] == "windows-1252" and rows.first()["name"] == "café"


@pytest.fixture
def small_splits(spark):
    """Splits of 4 kB, and binaryFile refuses to load more than 1 kB, as it does from 2 GB on otherwise."""
    held = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0", "spark.sql.sources.binaryFile.maxLength": "1000"}
    old = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("encoding", "end"), [("utf-8-sig", "\n"), ("utf-8", "\r\n"), ("cp1252", "\n")])
def test_csv_in_splits(spark, tmp_path, small_splits, encoding, end):
    names = [f'"Dana ""{i}"", é"' if i % 3 else f"name {i}" for i in range(3000)]
    lines = ["", "id,name,note", *[line for i, n in enumerate(names) for line in ([f'{i},{n},""', ",,"] if i % 50 == 0 else [f"{i},{n},x"])]]
    (tmp_path / "s.csv").write_bytes((end.join(lines) + end).encode(encoding))
    rows, meta = read_csv(spark, str(tmp_path / "s.csv"))
    assert meta["columns"] == ["id", "name", "note"] and rows.rdd.getNumPartitions() > 5
    got = [tuple(r) for r in rows.orderBy("row_index").collect()]
    assert got == [(i, str(i), f'Dana "{i}", é' if i % 3 else f"name {i}", None if i % 50 == 0 else "x") for i in range(3000)]


@pytest.mark.parametrize("cell", ['"two\nlines"', '"a, ""b\nc"" d"', '"a\n""\nb"', '"cr\rinside"'])
def test_csv_records_over_lines(spark, tmp_path, small_splits, cell):
    """One record over a line end, far beyond the head, keeps the file whole."""
    lines = ["id,name", *[f"{i},plain" for i in range(25000)], f"25000,{cell}", *[f"{i},after" for i in range(25001, 25010)]]
    (tmp_path / "m.csv").write_bytes("\n".join(lines).encode())
    rows, _ = read_csv(spark, str(tmp_path / "m.csv"))
    got = [tuple(r) for r in rows.where("row_index >= 24999").orderBy("row_index").collect()]
    want = [(24999, "24999", "plain"), (25000, "25000", cell[1:-1].replace('""', '"')), *[(i, str(i), "after") for i in range(25001, 25010)]]
    assert got == want


def test_contracts():
    with pytest.raises(ContractError):
        make_contract("x", [{"name": "1a"}])
    with pytest.raises(ContractError):
        make_contract("x", [{"name": "a", "type": "enum"}])
    c = make_contract("x", [{"name": "first_name", "aliases": "a, b"}])
    assert c.fields[0].display_name == "First name" and c.fields[0].aliases == ("a", "b")
    assert next_version(c, [{"name": "z"}]).version == 2
    kinds = [(s.kind, s.target) for s in suggest_transforms(samples()["Subscriber"], {"a": "mobile", "b": "residence"})]
    assert kinds == [("trim", None), ("null_normalize", None), ("country", "residence"), ("phone", "mobile"), ("default", "plan")]


def test_structure_and_notes(spark):
    rows = spark.createDataFrame([(0, "Dana Levi Cohen", "Main", "5", "03/04/2026"), (1, None, None, None, None)], "row_index long, Name string, Street string, House string, D string")
    contract = make_contract("x", [{"name": "first"}, {"name": "rest"}, {"name": "address"}, {"name": "d", "type": "date"}])
    specs = [TransformSpec("split", None, {"source": "Name", "into": ["first", "rest"]}), TransformSpec("combine", "address", {"template": "{Street} {House},"}), TransformSpec("date", "d"), TransformSpec("case", "first", {"mode": "upper"}, enabled=False)]
    v = conform(rows, contract, {"D": "d"}, specs).orderBy("row_index").collect()
    assert v[0][1:5] == ("Dana", "Levi Cohen", "Main 5", "2026-04-03")
    assert [i["code"] for i in v[0]["issues"]] == ["date_ambiguous"] and v[0]["row_status"] == "warning"
    assert v[1][1:5] == (None, None, None, None)


def test_rule_clauses(spark):
    df = spark.createDataFrame([("2024-05-01 09:00:00", "2024-05-01 08:00:00", None, "5")], "a string, b string, c string, n string")
    holds = lambda **k: df.select(validate.clause(k, F.col)).first()[0]
    assert holds(field="a", op="gte_field", value="b") and holds(field="c", op="eq", value="None") and holds(field="a", op="gt", value="3")
    assert holds(field="c", op="empty") and holds(field="n", op="lt", value=10) and not holds(field="n", op="in", value=["6"]) and holds(field="n", op="what")


def test_ladder_and_conflicts(spark):
    contract = samples()["Subscriber"]
    sources = spark.createDataFrame([("Ful Nme", 0, "string"), ("Zzz", 1, "phone"), ("E-Mail", 2, "email"), ("Qqq", 3, "string")], "source string, ordinal int, detected string")
    got = {r["source"]: (r["target"], r["confidence"], r["method"]) for r in mapping.suggest(sources, contract, provider=lambda s, t: {"Qqq": ("employer", "high"), "Zzz": ("nope", "high")}).collect()}
    assert got["Ful Nme"][0] == "full_name" and got["Ful Nme"][2] == "fuzzy"
    assert got["Zzz"] == ("mobile", "LOW", "type") and got["E-Mail"] == ("mail", "HIGH", "alias") and got["Qqq"] == ("employer", "MEDIUM", "ai")
    pairs = spark.createDataFrame([("a", None, "UNMAPPED", "none", 0), ("b", "mail", "HIGH", "exact", 1)], "source string, target string, confidence string, method string, ordinal int")
    with pytest.raises(MappingError):
        mapping.confirm(pairs, {"a": "mail"}, contract)
    assert {r["source"]: r["method"] for r in mapping.confirm(pairs, {"a": "mobile"}, contract).collect()} == {"a": "manual", "b": "exact"}


def _some_names(rng, n):
    words = ["united", "states", "of", "korea", "republic", "the", "a", "israel", "new", "zealand", "saint"]

    def name():
        kind = rng.random()
        if kind < 0.5:
            return " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))
        if kind < 0.55:
            return "".join(rng.choice("abé日 ") for _ in range(rng.randint(60, 90)))
        w = list(f"{rng.choice(words)} {rng.choice(words)}")
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice("abcdefg ")
        return "".join(w)

    return [name() for _ in range(n)]


def test_similarity_as_defined():
    rng = random.Random(3)
    a, b = _some_names(rng, 3_000) + ["", None, "x", "a" * 64, "ab" * 32, "a" * 65], _some_names(rng, 3_000) + ["", "x", None, "a" * 64, "ba" * 40, "a" * 64]
    for got, want in ((similarity.scores(pd.Series(a), pd.Series(b)), slow_similarity.weighted_ratio), (similarity.scores(pd.Series(a), pd.Series(b), sets=True), slow_similarity.best_score)):
        assert all(abs(g - want(x or "", y or "")) < 1e-9 for g, x, y in zip(got, a, b, strict=True))


def test_nearest_name_as_by_all_pairs(spark):
    """The index of grams misses no name, for values near and far, short, long, null and empty."""
    rng = random.Random(4)
    countries = {r["name"]: r["code"] for r in quality.country_names(spark).collect()}
    values = {None, "", "uk", "unk", "b", "uxk", "usaa", "kas", "x" * 500, "of the", "United  Kingdom", *_some_names(rng, 20)}
    for name in rng.sample(sorted(countries), 40):
        w = list(name.upper() if rng.random() < 0.3 else name)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = rng.choice(["", "x", "e", " "])
        values.add("".join(w) if rng.random() < 0.8 else " ".join(reversed("".join(w).split())))
    for least in (80, 90):
        want = {}
        for v in (v for v in values if v and len(v) > 1):
            best = max((slow_similarity.weighted_ratio(v.lower(), n), n) for n in countries)
            if best[0] >= least:
                want[v] = countries[best[1]]
        df = spark.createDataFrame([(v,) for v in values], "value string")
        assert {r["value"]: r["code"] for r in similarity.nearest_names(df, quality.country_names(spark), least).collect()} == want
    assert similarity.nearest_names(df.limit(0), quality.country_names(spark)).count() == 0 == similarity.nearest_names(df, quality.country_names(spark).limit(0)).count()
    with pytest.raises(ValueError):
        similarity.nearest_names(df, quality.country_names(spark), 70)


def test_plans_do_not_repeat_chains(spark):
    """Filters on issues, status and values stay above the normalizers."""
    contract = make_contract("x", [{"name": "country", "type": "country"}, {"name": "currency", "type": "currency"}, {"name": "phone", "type": "phone"}, {"name": "day", "type": "date"}, {"name": "mail", "type": "email", "unique": True}])
    rows = spark.createDataFrame([(0, "Israel", "usd", "052-1234567", "01/02/2024", "a@example.com"), (1, "Germ", "$", "1", "x", "b")], "row_index long, country string, currency string, phone string, day string, mail string")
    v = conform(rows, contract, {n: n for n in contract.names})
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    whole = size(v)
    views = {"issues": validate.issue_rows(v), "ready": export.scope(v, "ready"), "search": review.search(v, contract.names, "isr"), "errors": export.error_rows(v, contract.names), "held": review.rows_with_issue(v, "phone"), "status": review.rows_by_status(v, "issues"), "value": v.where("country = 'IL' and day > '2024'")}
    for name, df in views.items():
        assert size(df) < 2 * whole, name
    assert [r["row_index"] for r in views["ready"].collect()] == [0] and views["search"].count() == 1 and views["value"].count() == 1
    assert [r["country"] for r in v.orderBy("row_index").collect()] == ["IL", "DE"]


def test_parts_of_country_names(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(["Germ", "united", "Türkiye", "turkiye", " Deutsch. ", "Ger", "Cote d'Ivoire", "u.s.a.", None, "", "Atlantis", "niger"])], "row_index long, country string")
    contract = make_contract("x", [{"name": "country", "type": "country"}])
    got = [r["country"] for r in conform(rows, contract, {"country": "country"}).orderBy("row_index").collect()]
    assert got == ["DE", "united", "TR", "TR", "DE", "Ger", "CI", "US", None, None, "Atlantis", "NE"]


def test_fixes_and_profile(spark):
    contract = make_contract("x", [{"name": "email", "type": "email"}, {"name": "country", "type": "country"}])
    rows = spark.createDataFrame([(0, "a b@example.com", "Isreal"), (1, "a b@example.com", "Isreal"), (2, "ok@example.com", "France")], "row_index long, email string, country string")
    v = conform(rows, contract, {"email": "email", "country": "country"})
    names = spark.createDataFrame([("Israel", "IL"), ("France", "FR")], "name string, code string")
    got = {(r["field"], r["value"]): (r["fixed"], r["n"]) for r in quality.bulk_fixes(v, contract.names, names).collect()}
    assert got == {("email", "a b@example.com"): ("ab@example.com", 2), ("country", "Isreal"): ("IL", 2)}
    p = {r["column"]: r for r in profile.profile(rows, ["email", "country"]).collect()}
    assert p["email"]["distinct_count"] == 2 and p["country"]["examples"] == ["Isreal", "France"]
    none = profile.profile(rows.limit(0), ["email"]).first()
    assert none["empty_pct"] == 100.0 and none["detected_type"] == "empty"


def test_countries_are_all_compared(spark):
    wrong = {"Portugl": "PT", "AUSTRALA": "AU", "swedne": "SE", "Isreal": "IL", "Thailnd": "TH", "Qqqqqq": None}
    values = spark.createDataFrame([(v,) for v in wrong], "value string")
    got = {r["value"]: r["code"] for r in similarity.nearest_names(values, quality.country_names(spark)).collect()}
    assert got == {v: c for v, c in wrong.items() if c}
    contract = make_contract("x", [{"name": "country", "type": "country"}])
    v = conform(spark.createDataFrame([(0, "Portugl"), (1, "AUSTRALA")], "row_index long, country string"), contract, {"country": "country"})
    assert {(r["value"], r["fixed"]) for r in quality.bulk_fixes(v, contract.names).collect()} == {("Portugl", "PT"), ("AUSTRALA", "AU")}


def test_incremental_is_a_full_run(spark):
    contract = make_contract("x", [{"name": "id", "unique": True}, {"name": "n", "type": "integer"}])
    rows = spark.createDataFrame([(i, f"k{i // 2}", str(i) if i % 3 else "x") for i in range(20)], "row_index long, id string, n string")
    mapped = {"id": "id", "n": "n"}
    before = conform(rows, contract, mapped)
    edits = review.edit_cell(before, 1, 4, "id", "new").union(review.edit_cell(before, 1, 9, "id", "k0"))
    full = conform(rows, contract, mapped, edits=edits)
    changed = assemble.transform(rows, contract, mapped, suggest_transforms(contract, mapped), overrides=review.overrides(edits))
    counts = review.Counts.of(before, contract)
    edited = changed.join(edits.select("row_index").distinct(), "row_index", "left_semi")
    fresh, counts = review.revalidated(before, counts, edited, contract, {"id", "n"})
    merged = review.merge(before, fresh)
    pick = lambda d: sorted((r["row_index"], r["row_status"], [i["code"] for i in r["issues"]]) for r in d.collect())
    assert pick(merged) == pick(full) and fresh.count() < 20


def test_batches_of_edits_are_full_runs(spark):
    """Values of two unique fields that become many, few, single and empty, batch after batch, on kept counts."""
    rng = random.Random(12)
    contract = make_contract("x", [{"name": "a", "unique": True}, {"name": "b", "unique": True, "type": "email"}, {"name": "c", "required": True}])
    rows = spark.createDataFrame([(i, f"v{i % 7}", f"u{i % 11}@x.com" if i % 4 else None, None if i % 9 == 0 else "c") for i in range(30)], "row_index long, a string, b string, c string")
    mapped = {n: n for n in "abc"}
    view = written(conform(rows, contract, mapped))
    counts = review.Counts.of(view, contract)
    pick = lambda d: sorted((r["row_index"], r["a"], r["b"], r["c"], r["row_status"], [i["code"] for i in r["issues"]]) for r in d.collect())
    edits = spark.createDataFrame([], review.EDITS)
    for batch in range(4):
        events = {(rng.randrange(30), rng.choice("abc")): rng.choice(["v0", "v1", "new", f"n{batch}", "u1@x.com", "u2@x.com", None]) for _ in range([1, 12, 3, 1][batch])}
        edits = written(edits.union(spark.createDataFrame([(batch, "edit", r, f, None, v) for (r, f), v in events.items()], review.EDITS)))
        now = assemble.transform(rows, contract, mapped, suggest_transforms(contract, mapped), overrides=review.overrides(edits))
        touched = spark.createDataFrame([(r,) for r in {r for r, _ in events}], "row_index long")
        fresh, counts = review.revalidated(view, counts, now.join(touched, "row_index", "left_semi"), contract, set(mapped))
        view = written(review.merge(view, fresh))
        assert pick(view) == pick(conform(rows, contract, mapped, edits=edits))


def test_stream(spark, tmp_path):
    source = tmp_path / "s"
    spark.createDataFrame([(0, " a@B.com "), (1, "bad")], "row_index long, mail string").write.parquet(str(source))
    contract = make_contract("x", [{"name": "email", "type": "email", "unique": True}])
    stream = spark.readStream.schema("row_index long, mail string").parquet(str(source))
    out = conform_stream(stream, contract, {"mail": "email"}, suggest_transforms(contract, {"mail": "email"}))
    run = out.select("row_index", "email", "row_status").writeStream.format("memory").queryName("conformed").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {tuple(r) for r in spark.table("conformed").collect()} == {(0, "a@b.com", "ready"), (1, "bad", "error")}


@pytest.mark.parametrize("bound", ["-12.50", "0", "0.000", "50000", "1e21", "0.5"])
def test_bounds_of_any_size(spark, bound):
    """Texts compare with a bound as their numbers do, with more digits than a decimal holds."""
    from decimal import Decimal

    texts = ["0", "-0.0", "7", "-12.5", "-12.51", "-12.49", "49999.99999999999999999999999", "50000.000", "50000.0000000000000000000000001", "9" * 25, "-" + "9" * 25, "1" + "0" * 21, ".5", "0.50", "0.4999", "007"]
    got = spark.createDataFrame([(t,) for t in texts], "v string").select("v", validate.compared(F.col("v"), bound).alias("c")).collect()
    assert {r["v"]: r["c"] for r in got} == {t: (Decimal(t) > Decimal(bound)) - (Decimal(t) < Decimal(bound)) for t in texts}
    assert spark.createDataFrame([("x",), (None,)], "v string").select(validate.compared(F.col("v"), bound).alias("c")).where("c is not null").isEmpty()
