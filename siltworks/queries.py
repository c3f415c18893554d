"""The registered queries of the conformance operators, each over whole tables, with the SQL that each is held against.

The driver's tables are clean, so dirty text is derived from their keys by the same arithmetic in both languages.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import normalize as N
from .functions.dimension import country_names
from .functions.exprs import text
from .model import Contract, TransformSpec, make_contract, suggest_transforms
from .operators import assemble, catalog, export, mapping, profile, quality, review, similarity, validate
from .plans.conform import conform
from .sources.delimited import read_csv
from .sources.tables import shared_folder, spread, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# One recipe in both languages: k is c_custkey.
_RECIPE = {
    "raw_id": "'C-' || cast(k - case when k % 50 = 0 and k > 0 then 1 else 0 end as {s})",
    "raw_name": "case when k % 17 = 0 then 'N/A' when k % 19 = 0 then '' when k % 5 = 0 then '  ' || c_name || '  ' else c_name end",
    "raw_email": "case when k % 23 = 0 then 'not-an-email' when k % 29 = 0 then 'user ' || cast(k as {s}) || '@example.com' else 'User' || cast(k as {s}) || '@Example.COM' end",
    "raw_phone": "case k % 4 when 0 then '052-' || lpad(cast(k % 10000000 as {s}), 7, '0') when 1 then '+97252' || lpad(cast(k % 10000000 as {s}), 7, '0') when 2 then '(212) 555-' || lpad(cast(k % 10000 as {s}), 4, '0') else '05012ABC' end",
    "raw_country": "case c_nationkey % 8 when 0 then 'Israel' when 1 then 'IL' when 2 then 'ISR' when 3 then 'UK' when 4 then 'Deutschland' when 5 then 'USA' when 6 then 'Isreal' else '' end",
    "raw_amount": "case k % 6 when 0 then cast(cents as {s}) || '.25' when 1 then '₪' || cast(cents as {s}) || ',250.50' when 2 then cast(cents as {s}) || '.250,75' when 3 then '(' || cast(cents as {s}) || '.00)' when 4 then cast(cents % 900 + 1 as {s}) || ',299' else 'abc' end",
    "raw_bool": "case k % 7 when 0 then 'Yes' when 1 then 'n' when 2 then 'TRUE' when 3 then '0' when 4 then 'off' when 5 then 'maybe' else ' T ' end",
    "raw_ccy": "case k % 6 when 0 then 'usd' when 1 then '$' when 2 then 'euro' when 3 then '₪' when 4 then 'GBP' else 'Zorkmid' end",
    "raw_int": "case k % 5 when 0 then cast(k as {s}) || '.0' when 1 then '00' || cast(k as {s}) when 2 then '-' || cast(k as {s}) when 3 then '+' || cast(k as {s}) else cast(k as {s}) || '.5' end",
    "raw_url": "case k % 4 when 0 then 'example.com/' || cast(k as {s}) when 1 then 'HTTP://shop.example.org' when 2 then 'not a url' else 'https://a-b.example.net/x?y=' || cast(k as {s}) end",
}


def _recipe(string: str) -> str:
    return ", ".join(f"{sql.format(s=string)} AS {name}" for name, sql in _RECIPE.items())


_DATES = {
    "spark": "case k % 5 when 0 then date_format(d, 'yyyy-MM-dd') when 1 then date_format(d, 'dd/MM/yyyy') when 2 then date_format(d, 'dd.MM.yyyy') when 3 then date_format(d, 'MMM d yyyy') else '31/02/2025' end AS raw_date",
    "duck": "case k % 5 when 0 then strftime(d, '%Y-%m-%d') when 1 then strftime(d, '%d/%m/%Y') when 2 then strftime(d, '%d.%m.%Y') when 3 then strftime(d, '%b %-d %Y') else '31/02/2025' end AS raw_date",
}


def dirty_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").selectExpr("c_custkey AS k", "c_name", "c_nationkey", "c_custkey % 90000 AS cents", "date_add(date '2020-01-01', cast(c_custkey % 2000 as int)) AS d")
    return base.selectExpr("k AS row_index", *[f"{sql.format(s='string')} AS {name}" for name, sql in _RECIPE.items()], _DATES["spark"])


DC = f"""base AS (SELECT c_custkey AS k, c_name, c_nationkey, c_custkey % 90000 AS cents, date '2020-01-01' + cast(c_custkey % 2000 AS integer) AS d FROM customer),
dc AS (SELECT k AS row_index, {_recipe("varchar")}, {_DATES["duck"]} FROM base)"""

# ---- twins of the normalizers in SQL, written for the recipe's values
TRIM = "nullif(regexp_replace(trim({0}, ' '), ' +', ' ', 'g'), '')"
CLEAN = f"CASE WHEN lower(trim(coalesce({TRIM}, ''))) IN ('', 'n/a', 'na', 'null', 'none', 'nil', '-', '--', '—', '?', '#n/a', 'nan') THEN NULL ELSE {TRIM} END"
EMAIL_OK = r"regexp_full_match({0}, '[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~-]+(\.[A-Za-z0-9!#$%&''*+/=?^_`{{|}}~-]+)*@([a-z0-9]([a-z0-9-]*[a-z0-9])?\.)+[a-z][a-z0-9-]*[a-z0-9]')"
MAIL = "CASE WHEN contains({0}, '@') THEN regexp_extract({0}, '^(.*)@', 1) || '@' || lower(regexp_extract({0}, '@([^@]*)$', 1)) ELSE {0} END"
ISO = "CASE WHEN regexp_full_match(raw_date, '\\d{4}-\\d{2}-\\d{2}') THEN try_strptime(raw_date, '%Y-%m-%d') WHEN regexp_full_match(raw_date, '\\d{2}[/.]\\d{2}[/.]\\d{4}') THEN try_strptime(replace(raw_date, '.', '/'), '%d/%m/%Y') ELSE try_strptime(raw_date, '%b %-d %Y') END"


def normalized(spark: SparkSession, sf_dir: str, column: str, fn) -> DataFrame:
    raw = dirty_customer(spark, sf_dir).select("row_index", F.col(column).alias("raw"))
    return raw.withColumn("r", fn(F.col("raw"))).select("row_index", "raw", "r.value", "r.warning")


# ---- flagship
MAPPING = {"raw_id": "customer_id", "raw_name": "customer_name", "raw_email": "email"}


def flagship_contract() -> Contract:
    return make_contract("Customer", [
        {"name": "customer_id", "unique": True},
        {"name": "customer_name", "required": True, "rules": {"min_length": 2, "max_length": 120}},
        {"name": "email", "type": "email", "required": True, "unique": True},
    ])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conform(dirty_customer(spark, sf_dir).select("row_index", *MAPPING), flagship_contract(), MAPPING)


CHECKED = f"""{DC}, t AS (SELECT row_index, raw_id, raw_name, raw_email, {CLEAN.format("raw_id")} AS customer_id, {CLEAN.format("raw_name")} AS customer_name, {MAIL.format("(" + CLEAN.format("raw_email") + ")")} AS email FROM dc),
i AS (
  SELECT row_index, 1 AS seq, 'customer_id' AS field, 'ERROR' AS severity, 'duplicate' AS code, 'Duplicate value' AS message, raw_id AS original_value FROM t WHERE customer_id IN (SELECT customer_id FROM t GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT row_index, 12, 'customer_name', 'ERROR', 'required_missing', 'Missing required value', raw_name FROM t WHERE customer_name IS NULL
  UNION ALL SELECT row_index, 15, 'customer_name', 'ERROR', 'min_length', 'Shorter than 2 characters', raw_name FROM t WHERE length(customer_name) < 2
  UNION ALL SELECT row_index, 16, 'customer_name', 'ERROR', 'max_length', 'Longer than 120 characters', raw_name FROM t WHERE length(customer_name) > 120
  UNION ALL SELECT row_index, 24, 'email', 'ERROR', 'required_missing', 'Missing required value', raw_email FROM t WHERE email IS NULL
  UNION ALL SELECT row_index, 25, 'email', 'ERROR', 'duplicate', 'Duplicate value', raw_email FROM t WHERE email IN (SELECT email FROM t WHERE email IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT row_index, 26, 'email', 'ERROR', 'email_invalid', 'Invalid email', raw_email FROM t WHERE email IS NOT NULL AND NOT {EMAIL_OK.format("email")}),
st AS (SELECT t.row_index, CASE WHEN count(i.row_index) > 0 THEN 'error' ELSE 'ready' END AS row_status FROM t LEFT JOIN i USING (row_index) GROUP BY 1)"""


@query(f"""WITH {CHECKED}
SELECT count(*) AS rows, count(*) FILTER (row_status = 'ready') AS ready, CAST(0 AS BIGINT) AS warning, count(*) FILTER (row_status = 'error') AS error,
  (SELECT count(*) FROM i) AS n_error, CAST(0 AS BIGINT) AS n_warning, CAST(0 AS BIGINT) AS n_info, count(*) FILTER (row_status = 'ready') AS importable,
  round(100.0 * count(*) FILTER (row_status = 'ready') / count(*), 1) AS ready_pct FROM st""")
def flagship_quality_summary(spark, sf_dir):
    return quality.summary(flagship(spark, sf_dir))


@query(f"WITH {CHECKED} SELECT row_index, seq, field, severity, code, message, original_value FROM i")
def issues_long(spark, sf_dir):
    return validate.issue_rows(flagship(spark, sf_dir))


@query(f"WITH {CHECKED} SELECT row_index, row_status FROM st")
def row_status(spark, sf_dir):
    return flagship(spark, sf_dir).select("row_index", "row_status")


@query(f"WITH {CHECKED} SELECT row_status, count(*) AS n FROM st GROUP BY 1")
def status_counts(spark, sf_dir):
    return quality.status_counts(flagship(spark, sf_dir))


@query(f"WITH {CHECKED} SELECT severity, count(*) AS n FROM i GROUP BY 1")
def issue_counts(spark, sf_dir):
    return quality.issue_counts(validate.issue_rows(flagship(spark, sf_dir)))


@query(f"WITH {CHECKED} SELECT code, severity, field, count(*) AS n FROM i GROUP BY 1, 2, 3 ORDER BY n DESC, min(row_index * 1000 + seq) LIMIT 8")
def top_issues(spark, sf_dir):
    return quality.top_issues(validate.issue_rows(flagship(spark, sf_dir)))


@query(f"WITH {CHECKED} SELECT row_index, row_status FROM st WHERE row_status <> 'ready'")
def rows_by_status(spark, sf_dir):
    return review.rows_by_status(flagship(spark, sf_dir), "issues").select("row_index", "row_status")


@query(f"WITH {CHECKED} SELECT DISTINCT row_index FROM i WHERE field = 'email' AND code = 'email_invalid'")
def rows_with_issue(spark, sf_dir):
    return review.rows_with_issue(flagship(spark, sf_dir), "email", "email_invalid").select("row_index")


@query(f"WITH {CHECKED} SELECT row_index FROM t WHERE contains(lower(concat_ws('|', customer_id, customer_name, email, raw_id, raw_name, raw_email)), 'user12')")
def rows_search(spark, sf_dir):
    return review.search(flagship(spark, sf_dir), ["customer_id", "customer_name", "email"], "USER12").select("row_index")


@query(f"WITH {CHECKED} SELECT row_index, customer_name FROM t ORDER BY row_index LIMIT 25 OFFSET 50")
def rows_page(spark, sf_dir):
    return review.page(flagship(spark, sf_dir).select("row_index", "customer_name"), 3, 25, "row_index")


@query(f"WITH {CHECKED} SELECT row_index, seq, field, code FROM i ORDER BY row_index NULLS FIRST, seq LIMIT 20 OFFSET 20")
def issues_page(spark, sf_dir):
    return review.page(validate.issue_rows(flagship(spark, sf_dir)).select("row_index", "seq", "field", "code"), 2, 20, "row_index", "seq")


@query(f"WITH {CHECKED} SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 25.0)) AS BIGINT) AS pages FROM t")
def page_totals(spark, sf_dir):
    return review.page_count(flagship(spark, sf_dir), 25)


@query(f"WITH {CHECKED} SELECT t.row_index, row_index + 2 AS row_number, row_status, email AS value, raw_email AS original, coalesce(string_agg(i.code, ',' ORDER BY seq) FILTER (i.field = 'email'), '') AS codes FROM t JOIN st USING (row_index) LEFT JOIN i USING (row_index) GROUP BY ALL")
def row_views(spark, sf_dir):
    view = review.row_view(flagship(spark, sf_dir), ["email"])
    return view.select("row_index", "row_number", "row_status", "email.value", "email.original", F.array_join(F.transform("email.issues", lambda i: i["code"]), ",").alias("codes"))


@query(f"WITH {CHECKED} SELECT row_index, customer_id, customer_name, email FROM t JOIN st USING (row_index) WHERE row_status <> 'error'")
def export_scope(spark, sf_dir):
    return export.scope(flagship(spark, sf_dir), "ready").select("row_index", "customer_id", "customer_name", "email")


@query(f"WITH {CHECKED} SELECT t.row_index + 2 AS _row, string_agg(i.field || ': ' || i.message, '; ' ORDER BY seq) AS _issues, customer_id, customer_name, email FROM t JOIN i USING (row_index) GROUP BY ALL")
def export_errors(spark, sf_dir):
    return export.error_rows(flagship(spark, sf_dir), ["customer_id", "customer_name", "email"])


@query(f"WITH {CHECKED} SELECT row_index, to_json({{'customer_id': customer_id, 'customer_name': customer_name, 'email': email}}) AS json FROM t")
def export_json(spark, sf_dir):
    return export.json_rows(flagship(spark, sf_dir), ["customer_id", "customer_name", "email"]).select("row_index", F.col("json").cast("string").alias("json"))


@query(f"WITH {CHECKED} SELECT count(*) AS rows, count(*) FILTER (row_status = 'ready') AS ready, CAST(0 AS BIGINT) AS warning, count(*) FILTER (row_status = 'error') AS error, count(*) FILTER (row_status = 'ready') AS exported, (SELECT code FROM i GROUP BY code, severity, field ORDER BY count(*) DESC, min(row_index * 1000 + seq) LIMIT 1) AS first_code FROM st")
def import_report(spark, sf_dir):
    v = flagship(spark, sf_dir)
    return export.report(v, validate.issue_rows(v), "Customer", "customers.csv").select("rows", "ready", "warning", "error", "exported", F.get("top_issues", F.lit(0))["code"].alias("first_code"))


@query("""WITH t AS (SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1)
SELECT segment, n, 'status' AS field, 'ERROR' AS severity, 'required_field_unmapped' AS code, 'Required field "Status" is not mapped to any column' AS message FROM t""")
def dataset_issues(spark, sf_dir):
    """The issues of the data set beside the rows of each segment, of which every row lacks the same fields."""
    contract = make_contract("Orders", [{"name": "order_id", "required": True}, {"name": "status", "required": True}, {"name": "source", "required": True, "default": "web"}])
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_index"), F.col("c_mktsegment").alias("order_id"))
    v = conform(rows, contract, {"order_id": "order_id"})
    whole = validate.all_issues(v, contract, {"order_id"}).where("row_index is null").select("field", "severity", "code", "message")
    return v.groupBy(F.col("order_id").alias("segment")).agg(F.count("*").alias("n")).join(F.broadcast(whole))


@query(f"""WITH {CHECKED}, g AS (SELECT code, severity, field, count(*) AS n, min(message) AS message FROM i GROUP BY 1, 2, 3), top AS (SELECT string_agg(message || ':' || n, '|' ORDER BY n DESC, message) AS top_issues FROM g)
SELECT 'Customer' AS contract, 'customers.csv' AS file, 'monthly' AS template, 'errors' AS scope, '2024-01-02 03:04:05' AS generated_at, count(*) AS rows, count(*) FILTER (row_status = 'ready') AS ready, count(*) FILTER (row_status = 'error') AS exported,
  round(100.0 * count(*) FILTER (row_status = 'ready') / count(*), 1) AS ready_pct, 'raw_id>customer_id|raw_name>customer_name|raw_email>email|left>' AS mapping, 'trim:|null_normalize:|email:email' AS transformations, any_value(top_issues) AS top_issues FROM st, top""")
def import_report_whole(spark, sf_dir):
    v = written(flagship(spark, sf_dir))
    told = export.report(v, validate.issue_rows(v), "Customer", "customers.csv", scope="errors", mapping=MAPPING | {"left": None}, specs=suggest_transforms(flagship_contract(), MAPPING), template="monthly", generated_at=datetime(2024, 1, 2, 3, 4, 5))
    lines = lambda c, f: F.array_join(F.transform(c, f), "|").alias(c)
    issues = F.array_sort("top_issues", lambda a, b: F.when(a["n"] != b["n"], (b["n"] - a["n"]).cast("int")).when(a["message"] < b["message"], -1).otherwise(1))
    told = told.withColumn("top_issues", issues)
    return told.select("contract", "file", "template", "scope", F.date_format("generated_at", "yyyy-MM-dd HH:mm:ss").alias("generated_at"), "rows", "ready", "exported", "ready_pct", lines("mapping", lambda m: F.concat(m["source"], F.lit(">"), F.coalesce(m["target"], F.lit("")))), lines("transformations", lambda t: F.concat(t["kind"], F.lit(":"), F.coalesce(t["target"], F.lit("")))), lines("top_issues", lambda i: F.concat(i["message"], F.lit(":"), i["n"].cast("string"))))


# ---- normalizers
@query(f"WITH {DC} SELECT row_index, raw_name AS raw, {TRIM.format('raw_name')} AS value FROM dc")
def norm_trim(spark, sf_dir):
    return dirty_customer(spark, sf_dir).select("row_index", F.col("raw_name").alias("raw"), N.trim(F.col("raw_name")).alias("value"))


@query(f"WITH {DC} SELECT row_index, CASE WHEN raw_name IN ('N/A', '') THEN NULL ELSE raw_name END AS value FROM dc")
def norm_null_tokens(spark, sf_dir):
    return dirty_customer(spark, sf_dir).select("row_index", N.null_tokens(F.col("raw_name")).alias("value"))


@query("SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, list_aggregate(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS title FROM part")
def norm_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", N.case(F.col("p_name"), "upper").alias("up"), N.case(F.col("p_type"), "lower").alias("low"), N.case(F.col("p_name"), "title").alias("title"))


@query(f"WITH {DC}, m AS (SELECT row_index, raw_email AS raw, {MAIL.format('raw_email')} AS value FROM dc) SELECT *, CASE WHEN NOT {EMAIL_OK.format('value')} THEN 'email_invalid' END AS warning FROM m")
def norm_email(spark, sf_dir):
    return normalized(spark, sf_dir, "raw_email", N.email)


@query(f"""WITH {DC}, p AS (SELECT row_index, raw_phone AS raw, regexp_replace(raw_phone, '[^0-9]', '', 'g') AS g FROM dc)
SELECT row_index, raw, CASE WHEN g LIKE '972%' THEN '+' || g WHEN row_index % 4 = 0 THEN '+972' || substr(g, 2) ELSE raw END AS value,
  CASE WHEN regexp_matches(raw, '[A-Za-z]') OR length(g) < 6 THEN 'phone_invalid' WHEN row_index % 4 = 2 THEN 'phone_unparseable' END AS warning FROM p""")
def norm_phone(spark, sf_dir):
    return normalized(spark, sf_dir, "raw_phone", lambda c: N.phone(c, F.lit("Israel")))


@query(f"WITH {DC} SELECT row_index, CASE row_index % 4 WHEN 0 THEN 'IL' WHEN 1 THEN 'IL' WHEN 2 THEN 'US' END AS region FROM dc")
def phone_region(spark, sf_dir):
    e164 = N.phone(F.col("raw_phone"), F.when(F.col("row_index") % 4 == 2, F.lit("US")).otherwise(F.lit("IL")))["value"]
    return dirty_customer(spark, sf_dir).select("row_index", N.phone_region(e164).alias("region"))


@query(f"""WITH {DC}, n(name, code) AS (VALUES ('Israel', 'IL'), ('IL', 'IL'), ('ISR', 'IL'), ('UK', 'GB'), ('Deutschland', 'DE'), ('USA', 'US'))
SELECT row_index, raw_country AS raw, coalesce(code, raw_country) AS value, CASE WHEN code IS NULL THEN 'country_unknown' END AS warning FROM dc LEFT JOIN n ON name = raw_country""")
def norm_country(spark, sf_dir):
    return normalized(spark, sf_dir, "raw_country", N.country)


@query(f"""WITH {DC}, n(name, code) AS (VALUES ('usd', 'USD'), ('euro', 'EUR'), ('₪', 'ILS'), ('GBP', 'GBP'))
SELECT row_index, raw_ccy AS raw, coalesce(code, raw_ccy) AS value, CASE WHEN raw_ccy = '$' THEN 'currency_ambiguous' WHEN code IS NULL THEN 'currency_unknown' END AS warning FROM dc LEFT JOIN n ON name = raw_ccy""")
def norm_currency(spark, sf_dir):
    return normalized(spark, sf_dir, "raw_ccy", N.currency)


@query(f"""WITH {DC} SELECT row_index, raw_bool AS raw, CASE WHEN lower(trim(raw_bool)) IN ('yes', 'true', 't') THEN 'true' WHEN lower(raw_bool) IN ('n', '0', 'off') THEN 'false' ELSE raw_bool END AS value, CASE WHEN raw_bool = 'maybe' THEN 'boolean_invalid' END AS warning FROM dc""")
def norm_boolean(spark, sf_dir):
    return normalized(spark, sf_dir, "raw_bool", N.boolean)


@query(f"""WITH {DC} SELECT row_index, raw_int AS raw, CASE row_index % 5 WHEN 4 THEN raw_int WHEN 2 THEN cast(-row_index AS varchar) ELSE cast(row_index AS varchar) END AS value, CASE WHEN row_index % 5 = 4 THEN 'integer_invalid' END AS warning FROM dc""")
def norm_integer(spark, sf_dir):
    return normalized(spark, sf_dir, "raw_int", N.integer)


@query(f"""WITH {DC}, c AS (SELECT *, cast(row_index % 90000 AS varchar) AS c FROM dc)
SELECT row_index, raw_amount AS raw, CASE row_index % 6 WHEN 0 THEN c || '.25' WHEN 1 THEN c || '250.50' WHEN 2 THEN c || '250.75' WHEN 3 THEN '-' || c || '.00' ELSE raw_amount END AS value,
  CASE row_index % 6 WHEN 4 THEN 'decimal_ambiguous' WHEN 5 THEN 'decimal_invalid' END AS warning FROM c""")
def norm_decimal(spark, sf_dir):
    return normalized(spark, sf_dir, "raw_amount", N.decimal)


@query("WITH l AS (SELECT l_orderkey, l_linenumber, cast(l_extendedprice AS decimal(12,2)) AS p FROM lineitem) SELECT l_orderkey, l_linenumber, cast(p AS varchar) AS value FROM l")
def norm_decimal_lines(spark, sf_dir):
    """Prices written with a currency sign and groups of thousands, back to plain decimals."""
    p = F.col("l_extendedprice").cast("decimal(12,2)")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("$"), F.format_number(p, 2)).alias("raw"))
    return lines.withColumn("r", N.decimal(F.col("raw"))).select("l_orderkey", "l_linenumber", "r.value")


@query(f"""WITH {DC}, x AS (SELECT row_index, raw_date AS raw, {ISO} AS t, try_cast(regexp_extract(raw_date, '^(\\d\\d)[/.](\\d\\d)', 1) AS int) AS a, try_cast(regexp_extract(raw_date, '^(\\d\\d)[/.](\\d\\d)', 2) AS int) AS b FROM dc)
SELECT row_index, raw, coalesce(strftime(t, '%Y-%m-%d'), raw) AS value, CASE WHEN t IS NULL THEN 'date_invalid' WHEN a <= 12 AND b <= 12 AND a <> b THEN 'date_ambiguous' END AS warning FROM x""")
def norm_date(spark, sf_dir):
    return normalized(spark, sf_dir, "raw_date", N.date)


#: Twenty ways to write a day.
FORMS = ("yyyy-MM-dd", "MMM d, yyyy", "MMMM d yyyy", "d MMM yyyy", "dd-MMM-yyyy", "dd/MMM/yy", "yyyy-MMM-dd", "yyyy MMMM d", "MMM-yyyy-dd", "EEE, d MMM yyyy", "EEEE, MMMM d, yyyy", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "ddMMMyyyy", "MM dd yyyy", "'on' d 'of' MMMM, yyyy", "d MMM yyyy 'at' h:mm a", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyyMMdd'T'HHmmss")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS value, CAST(NULL AS varchar) AS warning, strftime(date_trunc('day', o_orderdate) + INTERVAL 13 HOUR, '%Y-%m-%d ') || CASE o_orderkey % 20 WHEN 17 THEN '13:00:00' WHEN 18 THEN '13:00:00+00:00' WHEN 19 THEN '13:00:00' ELSE '00:00:00' END AS moment FROM orders")
def norm_written_dates(spark, sf_dir):
    """Every order's day in one of twenty forms, by key, as a date and as a date-time."""
    noon = F.date_trunc("day", "o_orderdate") + F.expr("interval 13 hours")
    raw = F.get(F.array(*[F.date_format(noon, form) for form in FORMS]), (F.col("o_orderkey") % len(FORMS)).cast("int"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", raw.alias("raw")).withColumn("d", N.date(F.col("raw"))).withColumn("t", N.datetime(F.col("raw")))
    return orders.select("o_orderkey", "d.value", "d.warning", F.col("t.value").alias("moment"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00' AS value FROM events")
def norm_datetime(spark, sf_dir):
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".123Z"))
    return table(spark, sf_dir, "events").select("event_id", N.datetime(raw)["value"].alias("value"))


@query("SELECT CASE WHEN count(*) FILTER (day(o_orderdate) > 12) > 0 THEN true END AS dayfirst FROM orders")
def infer_date_order(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    return spark.createDataFrame([(assemble.date_order(rows, ["d"]).get("d"),)], "dayfirst boolean")


@query(f"""WITH {DC} SELECT row_index, raw_url AS raw, CASE row_index % 4 WHEN 0 THEN 'https://' || raw_url ELSE raw_url END AS value, CASE WHEN row_index % 4 IN (2) THEN 'url_invalid' WHEN row_index % 4 = 3 THEN NULL END AS warning FROM dc""")
def norm_url(spark, sf_dir):
    return normalized(spark, sf_dir, "raw_url", N.url)


@query("SELECT page_id, url AS value FROM pages WHERE regexp_full_match(url, '(https?://)?([\\w-]+\\.)+[\\w-]{2,}(/\\S*)?')")
def norm_url_pages(spark, sf_dir):
    r = table(spark, sf_dir, "pages").select("page_id", N.url(F.col("url")).alias("r"))
    return r.where("r.warning is null").select("page_id", "r.value")


# ---- assembly
@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def replace_values(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", N.replace_values(F.col("o_orderstatus"), {"F": "final", "O": "open"}).alias("status"))


def _one(spark, sf_dir, name, key, columns, fields, mapped, specs, defaults=None, overrides=None):
    rows = table(spark, sf_dir, name).select(F.col(key).alias("row_index"), *columns)
    return assemble.transform(rows, make_contract("x", [{"name": f} for f in fields]), mapped, specs, defaults, overrides).select("row_index", *fields)


@query("SELECT c_custkey AS row_index, c_mktsegment AS segment, 'none' AS note, CASE WHEN c_custkey % 3 = 0 THEN 'web' ELSE c_name END AS origin FROM customer")
def default_values(spark, sf_dir):
    blank = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("src")
    return _one(spark, sf_dir, "customer", "c_custkey", ["c_mktsegment", blank], ["segment", "note", "origin"], {"c_mktsegment": "segment", "src": "origin"}, [TransformSpec("default", "note", {"value": "none"})], {"origin": "web"})


@query("SELECT c_custkey AS row_index, CASE WHEN c_custkey % 3 <> 0 THEN c_name ELSE c_mktsegment END AS label FROM customer")
def coalesce_sources(spark, sf_dir):
    blank = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise("").alias("a")
    return _one(spark, sf_dir, "customer", "c_custkey", [blank, "c_mktsegment"], ["label"], {"a": "label", "c_mktsegment": "label"}, [])


@query("SELECT p_partkey AS row_index, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ', ' || p_name ELSE p_name END AS label FROM part")
def combine_columns(spark, sf_dir):
    brand = F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("brand")
    return _one(spark, sf_dir, "part", "p_partkey", [brand, "p_name"], ["label"], {}, [TransformSpec("combine", "label", {"template": "{brand},  {p_name} "})])


def _split(spark, sf_dir, mode):
    return _one(spark, sf_dir, "part", "p_partkey", ["p_type"], ["a", "b"], {}, [TransformSpec("split", None, {"source": "p_type", "into": ["a", "b"], "mode": mode})])


@query("SELECT p_partkey AS row_index, string_split(p_type, ' ')[1] AS a, nullif(array_to_string(string_split(p_type, ' ')[2:], ' '), '') AS b FROM part")
def split_first_rest(spark, sf_dir):
    return _split(spark, sf_dir, "first_rest")


@query("SELECT p_partkey AS row_index, nullif(array_to_string(string_split(p_type, ' ')[:-2], ' '), '') AS a, string_split(p_type, ' ')[-1] AS b FROM part")
def split_rest_last(spark, sf_dir):
    return _split(spark, sf_dir, "rest_last")


@query("SELECT p_partkey AS row_index, string_split(p_type, ' ')[1] AS a, string_split(p_type, ' ')[2] AS b FROM part")
def split_all(spark, sf_dir):
    return _split(spark, sf_dir, "all")


# ---- review
def _edits(spark, sf_dir):
    """Three batches on customers by key: a name, a name again, a segment emptied."""
    c = table(spark, sf_dir, "customer")
    event = lambda seq, label, where, field, before, after: c.where(where).select(F.lit(seq).cast("long").alias("seq"), F.lit(label).alias("label"), F.col("c_custkey").alias("row_index"), F.lit(field).alias("field"), before.alias("before"), after.alias("after"))
    return event(1, "edit", "c_custkey % 10 = 1", "name", F.col("c_name"), F.concat(F.lit("New "), "c_name")).union(event(2, "edit", "c_custkey % 20 = 1", "name", F.col("c_name"), F.upper("c_name"))).union(event(3, "edit", "c_custkey % 7 = 0", "segment", F.col("c_mktsegment"), text()))


def _overlaid(spark, sf_dir, edits):
    return _one(spark, sf_dir, "customer", "c_custkey", ["c_name", "c_mktsegment"], ["name", "segment"], {"c_name": "name", "c_mktsegment": "segment"}, [], None, review.overrides(edits))


@query("SELECT c_custkey AS row_index, CASE WHEN c_custkey % 20 = 1 THEN upper(c_name) WHEN c_custkey % 10 = 1 THEN 'New ' || c_name ELSE c_name END AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM customer")
def override_overlay(spark, sf_dir):
    return _overlaid(spark, sf_dir, _edits(spark, sf_dir))


@query("SELECT c_custkey AS row_index, CASE WHEN c_custkey % 20 = 1 THEN upper(c_name) WHEN c_custkey % 10 = 1 THEN 'New ' || c_name ELSE c_name END AS name, c_mktsegment AS segment FROM customer")
def undo_replay(spark, sf_dir):
    return _overlaid(spark, sf_dir, review.undo_last(_edits(spark, sf_dir)))


@query("SELECT c_custkey AS row_index, c_name AS name, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS segment FROM customer")
def reset_column(spark, sf_dir):
    return _overlaid(spark, sf_dir, review.reset_column(_edits(spark, sf_dir), "name"))


@query(f"WITH {CHECKED} SELECT row_index, 'customer_name' AS field, customer_name AS before, 'Unknown' AS after FROM t WHERE coalesce(customer_name, '') = ''")
def bulk_replace(spark, sf_dir):
    return review.bulk_replace(flagship(spark, sf_dir), 1, "customer_name", None, "Unknown").select("row_index", "field", "before", "after")


@query(f"WITH {DC} SELECT row_index, raw_name AS before, {TRIM.format('raw_name')} AS after FROM dc WHERE raw_name IS DISTINCT FROM {TRIM.format('raw_name')}")
def bulk_trim(spark, sf_dir):
    rows = dirty_customer(spark, sf_dir).select("row_index", "raw_name")
    return review.bulk_trim(rows, 1, "raw_name").select("row_index", "before", "after")


@query(f"""WITH {CHECKED}, n AS (SELECT row_index, CASE WHEN row_index % 50 = 0 AND row_index > 0 THEN 'C-' || row_index ELSE customer_id END AS customer_id FROM t),
d AS (SELECT customer_id FROM n GROUP BY 1 HAVING count(*) > 1)
SELECT row_index, coalesce(bool_or(n.customer_id IN (SELECT * FROM d)), false) AS duplicate FROM n GROUP BY 1""")
def incremental_revalidate(spark, sf_dir):
    """Every injected duplicate id is put right; only affected rows are validated again and merged with the others."""
    before = written(flagship(spark, sf_dir))
    edited = before.where("row_index % 50 = 0 and row_index > 0").select("row_index", F.concat(F.lit("C-"), F.col("row_index").cast("string")).alias("new"))
    counts = review.Counts.of(before, flagship_contract())
    changed = before.join(edited, "row_index").withColumn("customer_id", F.col("new")).drop("new")
    fresh, _ = review.revalidated(before, counts, changed, flagship_contract(), set(MAPPING.values()))
    merged = review.merge(before, fresh.select(*before.columns))
    return merged.select("row_index", F.exists("issues", lambda i: (i["code"] == "duplicate") & (i["field"] == "customer_id")).alias("duplicate"))


# ---- profile
PROFILED = ["raw_name", "raw_email", "raw_country", "raw_date", "raw_bool", "raw_amount"]
_CELLS = " UNION ALL ".join(f"SELECT row_index, '{c}' AS \"column\", {i} AS index, {c} AS v FROM dc" for i, c in enumerate(PROFILED))


@query(f"""WITH {DC}, u AS ({_CELLS}) SELECT "column", index, count(*) AS total, count(*) FILTER (trim(v) <> '') AS non_empty_count,
  round(100.0 * (count(*) - count(*) FILTER (trim(v) <> '')) / count(*), 1) AS empty_pct, count(*) FILTER (trim(v) <> '') = 0 AS is_empty, false AS is_duplicate_header FROM u GROUP BY 1, 2""")
def profile_nulls(spark, sf_dir):
    return profile.profile(dirty_customer(spark, sf_dir), PROFILED).select("column", "index", "total", "non_empty_count", "empty_pct", "is_empty", "is_duplicate_header")


@query(f"""WITH {DC}, u AS ({_CELLS}) SELECT "column", count(DISTINCT v) AS distinct_count, round(100.0 * count(DISTINCT v) / count(*), 1) AS unique_pct FROM u WHERE trim(v) <> '' GROUP BY 1""")
def profile_distinct(spark, sf_dir):
    return profile.profile(dirty_customer(spark, sf_dir), PROFILED).select("column", "distinct_count", "unique_pct")


@query(f"""WITH {DC}, u AS ({_CELLS}), f AS (SELECT "column", v, min(row_index) AS r FROM u WHERE trim(v) <> '' GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY r, v) AS k FROM f)
SELECT "column", string_agg(v, '|' ORDER BY k) AS examples FROM k WHERE k <= 5 GROUP BY 1""")
def profile_examples(spark, sf_dir):
    return profile.profile(dirty_customer(spark, sf_dir), PROFILED).select("column", F.array_join("examples", "|").alias("examples"))


_TYPED = ", ".join(f"sum(CASE WHEN regexp_matches(trim(v), '{p}') THEN 1 ELSE 0 END) / count(*) AS {n}" for n, p in (
    ("mails", "^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$"), ("urls", "^(?i:https?://)"), ("bools", "^(?i:true|false|yes|no|y|n|1|0)$"), ("days", "^(\\d{4}-\\d{2}-\\d{2}|\\d{1,2}[./-]\\d{1,2}[./-]\\d{2,4}|[A-Za-z]{3,9} \\d{1,2},? \\d{4})$"), ("wholes", "^[+-]?\\d{1,18}$"), ("numbers", "^[+-]?[\\d.,\\s]*\\d[\\d.,]*$"), ("codes", "^[A-Za-z]{2,3}$")))


@query(f"""WITH {DC}, u AS ({_CELLS}), r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_index) AS k FROM u WHERE trim(v) <> ''), t AS (SELECT "column", {_TYPED} FROM r WHERE k <= 500 GROUP BY 1)
SELECT "column", CASE WHEN mails >= 0.8 THEN 'email' WHEN bools >= 0.95 THEN 'boolean' WHEN urls >= 0.8 THEN 'url' WHEN days >= 0.8 THEN 'date' WHEN wholes >= 0.9 THEN 'integer' WHEN numbers >= 0.9 THEN 'decimal' WHEN codes >= 0.9 THEN 'country_code' ELSE 'string' END AS detected_type FROM t""")
def profile_type(spark, sf_dir):
    return profile.profile(dirty_customer(spark, sf_dir), PROFILED).select("column", "detected_type")


# ---- twins of the similarity scores in SQL: all pairs, by the recurrence on bits
def _lcs(a: str, b: str) -> str:
    full = f"((CAST(1 AS BIGINT) << length({a})) - 1)"
    masks = f"list_transform(string_split({b}, ''), lambda c: CAST(coalesce(list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN {a}[i] = c THEN CAST(1 AS BIGINT) << (i - 1) ELSE 0 END)), 0) AS BIGINT))"
    return f"(length({a}) - bit_count(list_reduce(list_concat([{full}], {masks}), lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full})))"


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0 * {_lcs(a, b)} / (length({a}) + length({b})) END"


def _partial(short: str, long: str) -> str:
    part = f"{long}[greatest(w, 0) + 1:w + length({short})]"
    return f"list_max(list_transform(range(1 - length({short}), length({long})), lambda w: {_ratio(short, part)}))"


_ORDERED = "array_to_string(list_sort(list_filter(string_split(lower({0}), ' '), lambda w: w <> '')), ' ')"
_WORDSET = "list_distinct(list_filter(string_split(lower({0}), ' '), lambda w: w <> ''))"
_AS_TEXT = "array_to_string(list_sort({0}), ' ')"
#: Over v (value) and d (name, code): the best name of 80 or more. Where lengths differ by half or more, windows count.
NEAREST = f"""vv AS MATERIALIZED (SELECT value, lower(value) AS a, {_ORDERED.format("value")} AS sa, {_WORDSET.format("value")} AS wa FROM v),
dd AS MATERIALIZED (SELECT name, code, lower(name) AS b, {_ORDERED.format("name")} AS sb, {_WORDSET.format("name")} AS wb FROM d),
pairs AS MATERIALIZED (SELECT value, name, code, a, b, sa, sb, greatest(length(a), length(b)) / least(length(a), length(b)) AS longer, {_AS_TEXT.format("list_filter(wa, lambda w: list_contains(wb, w))")} AS same,
  {_AS_TEXT.format("list_filter(wa, lambda w: NOT list_contains(wb, w))")} AS xa, {_AS_TEXT.format("list_filter(wb, lambda w: NOT list_contains(wa, w))")} AS xb,
  {_AS_TEXT.format("wa")} AS ta, {_AS_TEXT.format("wb")} AS tb FROM vv, dd),
more AS MATERIALIZED (SELECT *, same || ' ' || xa AS ya, same || ' ' || xb AS yb, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS p, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS q,
  CASE WHEN length(sa) <= length(sb) THEN sa ELSE sb END AS sp, CASE WHEN length(sa) <= length(sb) THEN sb ELSE sa END AS sq, CASE WHEN length(ta) <= length(tb) THEN ta ELSE tb END AS tp, CASE WHEN length(ta) <= length(tb) THEN tb ELSE ta END AS tq FROM pairs),
scored AS MATERIALIZED (SELECT value, name, code, {_ratio("a", "b")} AS plain, longer, CASE WHEN longer >= 1.5 THEN 0.0 ELSE {_ratio("sa", "sb")} END AS ordered,
  CASE WHEN same <> '' AND (xa = '' OR xb = '') THEN 100.0 WHEN same = '' THEN {_ratio("ta", "tb")} ELSE greatest({_ratio("ya", "yb")}, {_ratio("same", "ya")}, {_ratio("same", "yb")}) END AS sets,
  CASE WHEN longer >= 1.5 AND longer < 8 THEN greatest(0.9 * {_partial("p", "q")}, 0.855 * {_partial("sp", "sq")}, 0.855 * CASE WHEN same <> '' THEN 100.0 ELSE {_partial("tp", "tq")} END) ELSE 0.0 END AS windows FROM more),
nearest AS (SELECT value, code FROM (SELECT value, code, row_number() OVER (PARTITION BY value ORDER BY s DESC, name DESC) AS k FROM (SELECT *, round(greatest(plain, CASE WHEN longer < 1.5 THEN 0.95 * greatest(ordered, sets) ELSE windows END), 9) AS s FROM scored) WHERE s >= 80) WHERE k = 1)"""
# ---- mapping: headers and contracts of the words in the names of parts
_ADJECTIVES, _NOUNS = "blue cold hot large new old red small".split(), "anvil bolt gear gizmo plate ring rod widget".split()


def _contract():
    """A field for each pair of words, told by the words turned round and by an alias."""
    return make_contract("Parts", [{"name": f"{a}_{n}", "display_name": f"{n} ({a})", "aliases": f"{a} type {n}", "allow_multiple_sources": a == "blue"} for a in _ADJECTIVES for n in _NOUNS])


def _headers(spark, sf_dir):
    """source, k: each part's name as a header, written in one of six ways by its key."""
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 6).alias("k"), *[F.split("p_name", " ")[i].alias(n) for i, n in enumerate("an")])
    forms = ["a || '_' || n", "'The ' || upper(n) || ' No. (' || a || ')'", "initcap(a) || '-type ' || n", "'m:' || a || n", "'zq' || n || 'kx'", "a || ' ' || n"]
    return parts.select(F.expr("case k " + " ".join(f"when {i} then {f}" for i, f in enumerate(forms)) + " end").alias("source"), "k", "a", "n").distinct()


_HEADERS = """h AS (SELECT DISTINCT p_partkey % 6 AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS n FROM part),
s AS (SELECT *, CASE k WHEN 0 THEN a || '_' || n WHEN 1 THEN 'The ' || upper(n) || ' No. (' || a || ')' WHEN 2 THEN upper(a[1]) || a[2:] || '-type ' || n WHEN 3 THEN 'm:' || a || n WHEN 4 THEN 'zq' || n || 'kx' ELSE a || ' ' || n END AS source FROM h)"""


@query(f"WITH {_HEADERS} SELECT source, CASE WHEN k = 3 THEN 'blue_' || n ELSE a || '_' || n END AS target, 'HIGH' AS confidence, CASE k WHEN 1 THEN 'normalized' WHEN 2 THEN 'alias' WHEN 3 THEN 'saved' ELSE 'exact' END AS method FROM s WHERE k <> 4")
def map_ladder(spark, sf_dir):
    """Saved pairs, kept under the header as written, lead to the blue thing of the same kind."""
    sources = _headers(spark, sf_dir)
    memory = sources.where("k = 3").select(F.col("source").alias("key"), F.concat(F.lit("blue_"), "n").alias("target"))
    return mapping.by_key(sources.select("source", F.lit(0).alias("ordinal"), F.lit("string").alias("detected")), mapping.target_names(spark, _contract()), memory)


@query(f"""WITH {_HEADERS}, o AS (SELECT source, k, a, n, CAST(row_number() OVER (ORDER BY source) - 1 AS integer) AS ordinal FROM s WHERE k IN (0, 4) AND a <> 'blue' GROUP BY source, k, CASE WHEN k = 0 THEN a END, a, n),
f AS (SELECT DISTINCT ON (source) source, k, a, n FROM o) SELECT source, CASE WHEN k = 0 THEN a || '_' || n END AS target, CASE WHEN k = 0 THEN 'HIGH' ELSE 'UNMAPPED' END AS confidence, CASE WHEN k = 0 THEN 'exact' ELSE 'none' END AS method, CAST(row_number() OVER (ORDER BY source) - 1 AS integer) AS ordinal, k = 0 AS confirmed FROM f""")
def map_suggest(spark, sf_dir):
    """One file's headers: those that are names, and those like none. A header met twice is one."""
    one = _headers(spark, sf_dir).where("k in (0, 4) and a <> 'blue'").select("source").distinct()
    sources = one.select("source", (F.row_number().over(Window.orderBy("source")) - 1).alias("ordinal"), F.lit("string").alias("detected"))  # a row a header
    return mapping.suggest(sources, _contract())


_FUZZY_FIELDS = (("ring_size", "integer"), ("bolt_color", "string"), ("gear_hot", "decimal"), ("widget", "email"), ("small_anvil_no", "string"), ("red", "enum"))


@query(f"""WITH v AS (SELECT DISTINCT p_name AS value FROM part), d(name, code) AS (VALUES {", ".join(f"('{n.replace('_', ' ')}', '{n}')" for n, _ in _FUZZY_FIELDS)}), k(code, type) AS (VALUES {", ".join(map(str, _FUZZY_FIELDS))}), {NEAREST},
b AS (SELECT value, code, greatest(sets, plain, CASE WHEN longer < 1.5 THEN 0.95 * greatest(ordered, sets) ELSE windows END) AS s FROM scored)
SELECT value AS source, code AS target, round(CASE WHEN type IN ('integer', 'decimal', 'string') THEN least(s + 6, 100.0) WHEN type = 'enum' THEN s ELSE s - 15 END, 6) AS score FROM b JOIN k USING (code)""")
def map_fuzzy(spark, sf_dir):
    """Names of parts, taken for columns of whole numbers, against six fields."""
    contract = make_contract("x", [{"name": n, "display_name": n.replace("_", " "), "type": t, **({"rules": {"enum": ["x"]}} if t == "enum" else {})} for n, t in _FUZZY_FIELDS])
    sources = table(spark, sf_dir, "part").select(F.col("p_name").alias("source"), F.lit(0).alias("ordinal"), F.lit("integer").alias("detected")).distinct()
    return mapping.fuzzy_scores(sources, mapping.target_names(spark, contract)).select("source", "target", F.round("score", 6).alias("score"))


@query("SELECT lower(p_type) || '_' || split_part(p_name, ' ', 2) AS target, string_agg(DISTINCT p_name, ',' ORDER BY p_name) AS sources FROM part WHERE p_type IN ('LARGE', 'SMALL') GROUP BY 1 HAVING count(DISTINCT p_name) > 1")
def map_conflicts(spark, sf_dir):
    """Names mapped to a field by type and kind: all conflict but what goes to blue fields, which may have several sources."""
    part = table(spark, sf_dir, "part").where("p_type in ('LARGE', 'SMALL')")
    kind = F.split("p_name", " ")[1]
    pairs = part.select(F.col("p_name").alias("source"), F.concat(F.lower("p_type"), F.lit("_"), kind).alias("target")).distinct()
    several = part.select(F.col("p_name").alias("source"), F.concat(F.lit("blue_"), kind).alias("target")).distinct()
    return mapping.conflicts(pairs.union(several), _contract()).select("target", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_HEADERS}, t AS (SELECT DISTINCT p_type, split_part(p_name, ' ', 1) || split_part(p_name, ' ', 2) AS key FROM part WHERE p_type = 'PROMO') SELECT source, min(p_type) AS target, CASE WHEN min(p_type) IS NULL THEN 'UNMAPPED' ELSE 'HIGH' END AS confidence, 'template' AS method, 0 AS ordinal FROM s LEFT JOIN t ON k IN (0, 5) AND key = a || n GROUP BY source")
def template_apply(spark, sf_dir):
    """A template of the names of promoted parts on all headers."""
    pairs = table(spark, sf_dir, "part").where("p_type = 'PROMO'").select(mapping.header_key(F.col("p_name")).alias("key"), F.col("p_type").alias("target")).distinct()
    return mapping.apply_template(_headers(spark, sf_dir).select("source", F.lit(0).alias("ordinal")).distinct(), pairs)


@query("""WITH m AS (SELECT p_brand AS schema, replace(p_name, ' ', '') AS key, min(p_type) AS target, count(*) AS hits FROM part WHERE p_partkey % 3 > 0 GROUP BY 1, 2), c AS (SELECT p_brand AS schema, replace(p_name, ' ', '') AS key, max(p_type) AS new FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2)
SELECT coalesce(m.schema, c.schema) AS schema, coalesce(m.key, c.key) AS key, coalesce(new, target) AS target, CASE WHEN new IS NULL THEN hits WHEN target = new THEN hits + 1 ELSE 1 END AS hits FROM m FULL JOIN c ON m.schema = c.schema AND m.key = c.key""")
def memory_upsert(spark, sf_dir):
    """Types of parts as targets of their names, for each brand: what was known, and what's confirmed now."""
    part = table(spark, sf_dir, "part")
    memory = part.where("p_partkey % 3 > 0").groupBy(F.col("p_brand").alias("schema"), mapping.header_key(F.col("p_name")).alias("key")).agg(F.min("p_type").alias("target"), F.count("*").alias("hits"))
    confirmed = part.where("p_partkey % 2 = 0").groupBy(F.col("p_brand").alias("schema"), F.initcap("p_name").alias("source")).agg(F.max("p_type").alias("target"))
    return mapping.remember(memory, confirmed.union(part.select("p_brand", F.concat(F.lit("ignored "), "p_name"), F.lit(None).cast("string")).distinct()))


def _misspelt(named):
    """named (name, k) -> value: the names with the character at k left out, those of each third k with their first word last."""
    at = F.expr("cast(k % length(name) as int)")
    cut = named.select("k", F.concat(F.substring("name", F.lit(1), at), F.substring("name", at + 2, F.length("name"))).alias("v"))
    turned = F.when((F.col("k") % 3 == 0) & F.contains("v", F.lit(" ")), F.concat(F.regexp_replace("v", "^[^ ]* +", ""), F.lit(" "), F.regexp_extract("v", "^[^ ]*", 0))).otherwise(F.col("v"))
    return cut.select(turned.alias("value")).where("length(value) >= 3").distinct()


@query()
def country_suggest(spark, sf_dir):
    """Each customer's country, by key, misspelt, against the names of all. The JVM has those and SQL hasn't; ``name_nearest`` is the same search with SQL."""
    names = country_names(spark)
    every = names.agg(F.array_sort(F.collect_list("name")).alias("every"))  # of fixed size
    named = table(spark, sf_dir, "customer").join(F.broadcast(every)).select(F.expr("every[cast(c_custkey % size(every) as int)]").alias("name"), F.col("c_custkey").alias("k"))
    return similarity.nearest_names(_misspelt(named), names, 80)


_MISSPELT = """m AS (SELECT p_name AS name, p_partkey AS k FROM part), cut AS (SELECT k, substr(name, 1, CAST(k % length(name) AS INTEGER)) || substr(name, CAST(k % length(name) AS INTEGER) + 2) AS v FROM m),
v AS (SELECT DISTINCT value FROM (SELECT CASE WHEN k % 3 = 0 AND contains(v, ' ') THEN regexp_replace(v, '^[^ ]* +', '') || ' ' || regexp_extract(v, '^[^ ]*') ELSE v END AS value FROM cut) WHERE length(value) >= 3),
d AS (SELECT p_name AS name, 'name' AS code FROM part UNION SELECT p_type, 'type' FROM part)"""


@query(f"WITH {_MISSPELT}, {NEAREST} SELECT value, code FROM nearest")
def name_nearest(spark, sf_dir):
    """Misspelt names of parts against all names and types of parts; the code tells which is nearest."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.col("p_name").alias("name"), F.lit("name").alias("code")).union(part.select("p_type", F.lit("type"))).distinct()
    return similarity.nearest_names(_misspelt(part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("k"))), names, 80)


@query("SELECT c_custkey, regexp_replace(c_name, '[0-9]', '9', 'g') AS name, CASE WHEN length(c_mktsegment) > 12 THEN c_mktsegment[:2] || '***' ELSE c_mktsegment END AS segment, 'u***@e***.com' AS mail FROM customer")
def mask_samples(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", N.mask(F.col("c_name")).alias("name"), N.mask(F.col("c_mktsegment")).alias("segment"), N.mask(F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.com"))).alias("mail"))


# ---- predicates
def _fails(spark, sf_dir, name, key, column, spec):
    f = make_contract("x", [spec]).fields[0]
    checks = validate.rule_checks(f, F.col(column).cast("string"))
    codes = F.array(*[F.when(fails, F.lit(code)) for fails, code, _ in checks])
    return table(spark, sf_dir, name).select(*key, F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))


@query("SELECT p_partkey, code FROM (SELECT p_partkey, unnest([CASE WHEN length(p_type) < 18 THEN 'min_length' END, CASE WHEN length(p_type) > 20 THEN 'max_length' END]) AS code FROM part) WHERE code IS NOT NULL")
def val_length(spark, sf_dir):
    return _fails(spark, sf_dir, "part", ["p_partkey"], "p_type", {"name": "t", "rules": {"min_length": 18, "max_length": 20}})


@query("SELECT p_partkey, 'regex' AS code FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[1-3]\\d')")
def val_regex(spark, sf_dir):
    return _fails(spark, sf_dir, "part", ["p_partkey"], "p_brand", {"name": "b", "rules": {"regex": r"Brand#[1-3]\d"}})


@query("SELECT c_custkey, 'enum' AS code FROM customer WHERE lower(c_mktsegment) NOT IN ('building', 'machinery')")
def val_enum(spark, sf_dir):
    return _fails(spark, sf_dir, "customer", ["c_custkey"], "c_mktsegment", {"name": "s", "type": "enum", "rules": {"enum": ["Building", "MACHINERY"]}})


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'min' ELSE 'max' END AS code FROM lineitem WHERE l_quantity < 10 OR l_quantity > 45")
def val_range(spark, sf_dir):
    return _fails(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"], "l_quantity", {"name": "q", "type": "decimal", "rules": {"min": 10, "max": "45"}})


@query("SELECT o_orderkey, CASE WHEN o_orderdate < date '1994-01-01' THEN 'min_date' ELSE 'max_date' END AS code FROM orders WHERE CAST(o_orderdate AS date) < date '1994-01-01' OR CAST(o_orderdate AS date) > date '1996-12-31'")
def val_date_range(spark, sf_dir):
    return _fails(spark, sf_dir, "orders", ["o_orderkey"], "o_orderdate", {"name": "d", "type": "date", "rules": {"min_date": "1994-01-01", "max_date": "1996-12-31"}})


@query(f"WITH {DC} SELECT raw_id AS value FROM dc GROUP BY 1 HAVING count(*) > 1")
def val_unique(spark, sf_dir):
    return validate.duplicates(dirty_customer(spark, sf_dir), "raw_id").select(F.col("__v_raw_id").alias("value"))


@query(f"WITH {DC} SELECT row_index FROM dc WHERE coalesce(raw_name, '') = ''")
def val_required(spark, sf_dir):
    return dirty_customer(spark, sf_dir).where(validate.is_empty(F.col("raw_name"))).select("row_index")


def _lines(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), "o_orderstatus")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"), F.col("l_quantity").cast("decimal(12,2)").cast("string").alias("quantity"), "l_returnflag").join(o, "l_orderkey")


@query("SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS date) >= CAST(o_orderdate AS date) AS gte, CAST(l_shipdate AS date) < CAST(o_orderdate AS date) AS lt, l_quantity > 30 AS gt, l_quantity <= 12.5 AS lte FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def val_cross_field_compare(spark, sf_dir):
    c = lambda f, op, v: validate.clause({"field": f, "op": op, "value": v}, F.col)
    clauses = {"gte": c("shipped", "gte_field", "ordered"), "lt": c("shipped", "lt_field", "ordered"), "gt": c("quantity", "gt", 30), "lte": c("quantity", "lte", "12.5")}
    return _lines(spark, sf_dir).withColumns(clauses).select("l_orderkey", "l_linenumber", "gte", "lt", "gt", "lte")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag NOT IN ('A', 'N')")
def val_cross_field_when_then(spark, sf_dir):
    when, then = {"field": "o_orderstatus", "op": "eq", "value": "F"}, {"field": "l_returnflag", "op": "in", "value": ["A", "N"]}
    return _lines(spark, sf_dir).where(validate.clause(when, F.col) & ~validate.clause(then, F.col)).select("l_orderkey", "l_linenumber")


# ---- sinks, guards, dashboards
@query("SELECT k, CASE WHEN k % 4 IN (0, 2) THEN '''' || v ELSE v END AS v FROM (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '=' || c_name WHEN 1 THEN '-' || c_custkey WHEN 2 THEN '@x' ELSE '+972' || lpad(cast(c_custkey AS varchar), 9, '5') END AS v FROM customer)")
def export_guard(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    v = F.expr("case c_custkey % 4 when 0 then '=' || c_name when 1 then '-' || c_custkey when 2 then '@x' else '+972' || lpad(cast(c_custkey as string), 9, '5') end")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), N.guard(v).alias("v")).where(k.isNotNull())


@query("SELECT doc_id, CASE WHEN substr(text, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) AND NOT regexp_full_match(trim(text), '[+-]?(\\d+([.,]\\d+)?|[.,]\\d+)([eE][+-]?\\d+)?') AND NOT regexp_full_match(trim(text), '\\+\\d[\\d\\s\\-()]{5,}') THEN '''' || text ELSE text END AS text FROM documents")
def export_guard_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", N.guard(F.col("text")).alias("text"))


@query(f"WITH {DC} SELECT count(*) AS n FROM dc WHERE coalesce(trim(raw_name), '') <> '' OR coalesce(trim(raw_country), '') <> ''")
def blank_row_filter(spark, sf_dir):
    from .sources.delimited import filled

    return dirty_customer(spark, sf_dir).where(filled(["raw_name", "raw_country"])).agg(F.count("*").alias("n"))


_FIELDS_LEFT = f"""{DC}, e AS (SELECT raw_email, {MAIL.format("raw_email")} AS email FROM dc), f AS (SELECT 'email' AS field, 'email_invalid' AS code, email AS value, replace(email, ' ', '') AS fixed, count(*) AS n FROM e WHERE NOT {EMAIL_OK.format("email")} GROUP BY 1, 2, 3, 4),
k AS (SELECT *, row_number() OVER (ORDER BY n DESC, value) AS k FROM f), all_ AS (SELECT field, code, value, fixed, n FROM k WHERE k <= 5 AND value <> fixed
  UNION ALL SELECT 'country', 'country_unknown', raw_country, 'IL', count(*) FROM dc WHERE raw_country = 'Isreal' GROUP BY 1, 2, 3, 4)"""


@query(f"WITH {_FIELDS_LEFT} SELECT field, code, value, fixed, n FROM all_ ORDER BY n DESC, field, code, value LIMIT 8")
def bulk_fix_suggestions(spark, sf_dir):
    """Mails with a space in them, and the one misspelt country of the recipe, whose nearest of all names is Israel."""
    contract = make_contract("x", [{"name": "email", "type": "email"}, {"name": "country", "type": "country"}])
    mapped = {"raw_email": "email", "raw_country": "country"}
    v = conform(dirty_customer(spark, sf_dir).select("row_index", *mapped), contract, mapped)
    return quality.bulk_fixes(v, contract.names)


# ---- a contract with reference names, phones and dates
PLACES = {"raw_id": "id", "raw_country": "country", "raw_ccy": "currency", "raw_phone": "phone", "raw_date": "since"}


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones are of their row's country."""
    contract = make_contract("Places", [{"name": "id", "unique": True}, {"name": "country", "type": "country"}, {"name": "currency", "type": "currency"}, {"name": "phone", "type": "phone"}, {"name": "since", "type": "date"}])
    specs = [*(TransformSpec(k, None) for k in ("trim", "null_normalize")), TransformSpec("country", "country"), TransformSpec("currency", "currency"), TransformSpec("phone", "phone", {"country_field": "country"}), TransformSpec("date", "since", {"dayfirst": True})]
    return conform(spread(dirty_customer(spark, sf_dir).select("row_index", *PLACES)), contract, PLACES, specs)


_CCY = "CASE raw_ccy WHEN 'usd' THEN 'USD' WHEN 'euro' THEN 'EUR' WHEN '₪' THEN 'ILS' WHEN 'GBP' THEN 'GBP' ELSE raw_ccy END"
_COUNTRY = "CASE WHEN raw_country IN ('Israel', 'IL', 'ISR') THEN 'IL' WHEN raw_country = 'UK' THEN 'GB' WHEN raw_country = 'Deutschland' THEN 'DE' WHEN raw_country = 'USA' THEN 'US' ELSE nullif(raw_country, '') END"
_TEL = r"""CASE WHEN raw_phone LIKE '%ABC' THEN raw_phone WHEN raw_phone LIKE '+%' THEN raw_phone WHEN raw_phone LIKE '052-%' AND country IN ('IL', 'DE') THEN CASE country WHEN 'IL' THEN '+972' ELSE '+49' END || regexp_replace(substr(raw_phone, 2), '\D', '', 'g')
  WHEN raw_phone LIKE '(212)%' AND country IN ('US', 'DE', 'GB') THEN CASE country WHEN 'US' THEN '+1' WHEN 'DE' THEN '+49' ELSE '+44' END || regexp_replace(raw_phone, '\D', '', 'g') ELSE raw_phone END"""
_PLACED = f"""{DC}, c AS (SELECT *, {_COUNTRY} AS country, {_CCY} AS currency FROM dc), t AS (SELECT *, {_TEL} AS phone, {ISO} AS since FROM c),
i AS (SELECT row_index, 1 AS seq, 'id' AS field, 'duplicate' AS code FROM t WHERE raw_id IN (SELECT raw_id FROM t GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT row_index, 14, 'country', 'country_unknown' FROM t WHERE country = 'Isreal'
  UNION ALL SELECT row_index, 26, 'currency', 'currency_unknown' FROM t WHERE currency = 'Zorkmid'
  UNION ALL SELECT row_index, 62, 'currency', 'currency_ambiguous' FROM t WHERE currency = '$'
  UNION ALL SELECT row_index, 38, 'phone', 'phone_invalid' FROM t WHERE phone LIKE '%ABC'
  UNION ALL SELECT row_index, 38, 'phone', 'phone_unparseable' FROM t WHERE phone NOT LIKE '%ABC' AND phone NOT LIKE '+%'
  UNION ALL SELECT row_index, 50, 'since', 'date_invalid' FROM t WHERE since IS NULL)"""


@query(f"WITH {_PLACED} SELECT row_index, field, code FROM i")
def places_issues(spark, sf_dir):
    return validate.issue_rows(places(spark, sf_dir)).select("row_index", "field", "code")


@query(f"WITH {_PLACED} SELECT row_index, country, currency, phone, coalesce(strftime(since, '%Y-%m-%d'), raw_date) AS since FROM t WHERE row_index NOT IN (SELECT row_index FROM i WHERE code IN ('duplicate', 'phone_invalid', 'date_invalid'))")
def places_ready(spark, sf_dir):
    return export.scope(places(spark, sf_dir), "ready").select("row_index", "country", "currency", "phone", "since")


@query(f"WITH {_PLACED} SELECT row_index, (SELECT count(*) FROM i WHERE i.row_index = t.row_index) AS issues FROM t WHERE contains(lower(concat_ws(' ', raw_id, country, raw_country, currency, raw_ccy, phone, raw_phone, strftime(since, '%Y-%m-%d'), raw_date)), 'isr')")
def places_search(spark, sf_dir):
    found = review.search(places(spark, sf_dir), list(PLACES.values()), "ISR")
    return found.select("row_index", F.size("issues").cast("long").alias("issues"))


ORDER_MAPPING = {"l_orderkey": "order_id", "price": "price", "shipped": "shipped", "l_returnflag": "flag"}


@query("""WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS row_index, cast(cast(l_extendedprice AS decimal(12,2)) AS varchar) AS price, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_returnflag AS flag FROM lineitem)
SELECT count(*) AS rows, count(*) FILTER (flag <> 'R' AND cast(price AS decimal(12,2)) <= 50000) AS ready, count(*) FILTER (flag = 'R' OR cast(price AS decimal(12,2)) > 50000) AS error, max(shipped) AS last FROM x""")
def conform_lines(spark, sf_dir):
    """The whole plan on every line item: prices with signs and groups, slashed dates whose order is inferred, an enum."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_index"), F.col("l_orderkey").cast("string").alias("l_orderkey"), F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice").cast("decimal(12,2)"), 2)).alias("price"), F.date_format("l_shipdate", "dd/MM/yyyy").alias("shipped"), "l_returnflag")
    contract = make_contract("Lines", [{"name": "order_id", "required": True}, {"name": "price", "type": "decimal", "rules": {"max": 50000}}, {"name": "shipped", "type": "date"}, {"name": "flag", "type": "enum", "rules": {"enum": ["a", "n"]}}])
    v = conform(spread(rows), contract, ORDER_MAPPING)
    return v.agg(F.count("*").alias("rows"), F.count_if(F.col("row_status") == "ready").alias("ready"), F.count_if(F.col("row_status") == "error").alias("error"), F.max("shipped").alias("last"))


# ---- headers, templates and jobs of the driver's tables
@query("""WITH h AS (SELECT CAST(c_custkey - 1 AS integer) AS pos, CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_mktsegment END AS name FROM customer),
n AS (SELECT pos, coalesce(nullif(name, ''), 'Column ' || (pos + 1)) AS name FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pos) AS k FROM n)
SELECT pos, CASE WHEN k > 1 THEN name || ' (' || k || ')' ELSE name END AS name FROM k""")
def header_dedupe(spark, sf_dir):
    """Customers' segments as headers: many repeats, some blank."""
    name = F.expr("case c_custkey % 11 when 0 then null when 1 then '  ' else c_mktsegment || case when c_custkey % 2 = 0 then ' ' else '' end end")
    return mapping.dedupe_headers(table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).cast("int").alias("pos"), name.alias("name")))


_KEY = "array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim({0})), '[\\s_\\-./\\\\()\\[\\]:#''\"]+', ' ', 'g'), '[^a-z0-9 ]+', '', 'g')), ' '), lambda w: w NOT IN ('the', 'of', 'a', 'an', 'no', 'num', 'number', 'nr', 'col', 'column', 'field')), '')"


@query(f"SELECT p_partkey, {_KEY.format('name')} AS key FROM (SELECT p_partkey, 'No. of ' || p_name || '_' || p_brand || ' (' || p_type || ')' AS name FROM part)")
def header_key(spark, sf_dir):
    name = F.concat(F.lit("No. of "), "p_name", F.lit("_"), "p_brand", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, sf_dir, "part").select("p_partkey", mapping.header_key(name).alias("key"))


def _header_sets(spark, sf_dir):
    """Files and templates of each nation, with its customers' segments and name endings as headers."""
    keys = lambda rows, n: rows.select("c_nationkey", F.explode(F.array("c_mktsegment", F.concat(F.lit("x"), (F.col("c_custkey") % n).cast("string")))).alias("k")).groupBy("c_nationkey").agg(F.array_sort(F.collect_set("k")).alias("keys"))
    c, schema = table(spark, sf_dir, "customer"), (F.col("c_nationkey") % 3).cast("string").alias("schema")
    return keys(c, 4).select(F.col("c_nationkey").alias("job_id"), schema, "keys"), keys(c.where("c_custkey % 3 > 0"), 5).select((F.col("c_nationkey") + 100).alias("template_id"), schema, "keys")


_SCORED = """c AS (SELECT c_nationkey, unnest([c_mktsegment, 'x' || (c_custkey % 4)]) AS k FROM customer), t AS (SELECT c_nationkey, unnest([c_mktsegment, 'x' || (c_custkey % 5)]) AS k FROM customer WHERE c_custkey % 3 > 0),
j AS (SELECT c_nationkey AS job_id, c_nationkey % 3 AS schema, list(DISTINCT k) AS keys FROM c GROUP BY 1, 2), p AS (SELECT c_nationkey + 100 AS template_id, c_nationkey % 3 AS schema, list(DISTINCT k) AS tkeys FROM t GROUP BY 1, 2),
x AS (SELECT job_id, template_id, len(list_intersect(keys, tkeys)) / len(list_distinct(list_concat(keys, tkeys))) AS score FROM j JOIN p USING (schema))"""


@query(f"WITH {_SCORED} SELECT job_id, template_id, score FROM x")
def template_match(spark, sf_dir):
    jobs, templates = _header_sets(spark, sf_dir)
    return jobs.join(templates.withColumnRenamed("keys", "tkeys"), "schema").select("job_id", "template_id", mapping.jaccard(F.col("keys"), F.col("tkeys")).alias("score"))


@query(f"WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY score DESC, template_id) AS k FROM x WHERE score >= 0.8) SELECT job_id, template_id, score FROM r WHERE k = 1")
def template_detect(spark, sf_dir):
    return mapping.detect_template(*_header_sets(spark, sf_dir))


_JOBS = "SELECT o_orderkey AS job_id, o_orderpriority AS schema, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'validated' ELSE 'mapped' END AS status, o_orderkey % 100 AS rows, o_orderdate AS created_at FROM orders"


def _jobs(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "validated").otherwise("mapped")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("schema"), status.alias("status"), (F.col("o_orderkey") % 100).alias("rows"), F.col("o_orderdate").alias("created_at"))


@query(f"SELECT count(*) AS imports, CAST(sum(rows) AS BIGINT) AS rows, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'validated') AS needs_review, count(DISTINCT schema) AS schemas FROM ({_JOBS})")
def job_dashboard(spark, sf_dir):
    return quality.dashboard(_jobs(spark, sf_dir))


@query(f"SELECT job_id, schema FROM ({_JOBS}) ORDER BY created_at DESC, job_id DESC LIMIT 20")
def latest_jobs(spark, sf_dir):
    return review.latest_first(_jobs(spark, sf_dir), 20).select("job_id", "schema")


# ---- catalogs
@query(f"SELECT job_id, CASE WHEN job_id % 10 = 0 THEN 'moved' ELSE schema END AS schema FROM ({_JOBS})")
def catalog_put(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return catalog.put(jobs, jobs.where("job_id % 10 = 0").withColumn("schema", F.lit("moved")), "job_id").select("job_id", "schema")


@query(f"SELECT job_id FROM ({_JOBS}) WHERE status <> 'mapped'")
def catalog_delete(spark, sf_dir):
    jobs = _jobs(spark, sf_dir)
    return catalog.delete(jobs, jobs.where("status = 'mapped'"), "job_id").select("job_id")


@query("SELECT c_custkey AS template_id, CAST(row_number() OVER (ORDER BY c_custkey % 50 DESC, c_custkey DESC) AS integer) AS place FROM customer")
def templates_listed(spark, sf_dir):
    made = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("template_id"), (F.col("c_custkey") % 50).alias("created_at"))
    return catalog.listed(made, *catalog.template_order()).select("template_id", "place")


@query("WITH f AS (SELECT p_brand AS schema, p_size % 2 = 0 AS builtin, p_size AS created_at, p_partkey AS position FROM part) SELECT schema, position, CAST(row_number() OVER (ORDER BY builtin DESC, created_at, schema, position) AS integer) AS place FROM f")
def contracts_listed(spark, sf_dir):
    fields = table(spark, sf_dir, "part").select(F.col("p_brand").alias("schema"), (F.col("p_size") % 2 == 0).alias("builtin"), F.col("p_size").alias("created_at"), F.col("p_partkey").alias("position"))
    return catalog.listed(fields, *catalog.contract_order()).select("schema", "position", "place")


@query("SELECT p_brand AS schema, p_size AS version, p_partkey FROM part WHERE p_size = (SELECT max(q.p_size) FROM part q WHERE q.p_brand = part.p_brand)")
def contracts_latest(spark, sf_dir):
    return catalog.latest(table(spark, sf_dir, "part").select(F.col("p_brand").alias("schema"), F.col("p_size").alias("version"), "p_partkey"))


@query("SELECT c_custkey AS template_id, 5 + (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS use_count FROM customer")
def template_use_count(spark, sf_dir):
    templates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("template_id"), F.lit(5).cast("long").alias("use_count"))
    return catalog.counted_use(templates, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("template_id")))


@query(f"""WITH {DC}, u AS ({_CELLS}), p AS (SELECT "column", count(*) FILTER (trim(v) <> '') AS non_empty_count FROM u GROUP BY 1)
SELECT "column" AS source, CASE WHEN "column" <> 'raw_name' THEN 'to_' || "column" END AS target, non_empty_count FROM p UNION ALL SELECT 'absent', 'to_absent', NULL""")
def mapping_view(spark, sf_dir):
    mapped = spark.createDataFrame([(c, f"to_{c}", c == "raw_name") for c in [*PROFILED, "absent"]], "source string, target string, ignored boolean")
    return catalog.mapping_view(mapped, profile.profile(dirty_customer(spark, sf_dir), PROFILED)).select("source", "target", "non_empty_count")


@query(f"WITH {CHECKED} SELECT CAST(1 AS integer) AS job_id, row_index, code FROM i WHERE field = 'email' UNION ALL SELECT 2, row_index, code FROM i")
def issues_replaced(spark, sf_dir):
    """Job 1 has all issues at first, then those of one field; job 2's stay."""
    path = shared_folder(spark)
    issues = written(validate.issue_rows(flagship(spark, sf_dir)))
    for job, these in ((1, issues), (2, issues), (1, issues.where("field = 'email'"))):
        catalog.replace_issues(these, job, path)
    return spark.read.parquet(path).select(F.col("job_id").cast("int").alias("job_id"), "row_index", "code")


@query(f"WITH {CHECKED} SELECT row_index, row_status FROM st")
def originals_scanned_again(spark, sf_dir):
    """Rows as stored at upload, read again and validated."""
    stored = written(dirty_customer(spark, sf_dir).select("row_index", *MAPPING))
    return conform(stored, flagship_contract(), MAPPING).select("row_index", "row_status")


@query("""SELECT CAST(o_orderkey AS varchar) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(date_trunc('day', o_orderdate) + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS moment, CAST(o_custkey AS varchar) AS whole,
  CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END AS flag FROM orders""")
def typed_cells(spark, sf_dir):
    """A typed table as text: days, moments, whole floats and booleans."""
    day = F.date_trunc("day", "o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), (day + F.expr("interval 90 minutes")).alias("moment"), F.col("o_custkey").cast("double").alias("whole"), (F.col("o_orderstatus") == "F").alias("flag"))
    return catalog.text_rows(o)


@query("SELECT page_id, page_id || '_' || coalesce(nullif(right(regexp_replace(regexp_replace(regexp_extract(trim(url), '[^/]*$'), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+', ''), 80), ''), 'file') AS name FROM pages")
def upload_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", catalog.upload_name(F.col("url"), F.col("page_id").cast("string")).alias("name"))


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def uploads_expired(spark, sf_dir):
    files = table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("modified_at"))
    return catalog.expired(files, F.lit(files.agg(F.max("modified_at")).first()[0]), 3).select("event_id")


@query("SELECT CAST(-1 AS BIGINT) AS row_index, 'c_name,note' AS line UNION ALL SELECT c_custkey, c_name || ',' || CASE c_custkey % 3 WHEN 0 THEN '\"a \"\"b\"\", ' || c_custkey || '\"' WHEN 1 THEN chr(39) || '=x' ELSE '' END FROM customer")
def export_csv_lines(spark, sf_dir):
    note = F.expr("case c_custkey % 3 when 0 then 'a \"b\", ' || c_custkey when 1 then '=x' end")
    return export.csv_lines(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_index"), "c_name", note.alias("note")), ["c_name", "note"])


@query("SELECT c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment FROM customer")
def export_json_array(spark, sf_dir):
    """Written as one array and read back."""
    path = shared_folder(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_index"), F.col("c_name").alias("name"), F.expr("case when c_custkey % 2 = 0 then c_mktsegment end").alias("segment"))
    export.write_json_array(rows, ["name", "segment"], path)
    return spark.read.schema("name string, segment string").json(path, multiLine=True)


@query("SELECT c_custkey AS row_index, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'two, ' || c_mktsegment END AS note FROM customer")
def csv_roundtrip(spark, sf_dir):
    """Customers as one marked CSV file, read by the engine's own reader."""
    path = shared_folder(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_index"), F.col("c_name").alias("name"), F.expr("case when c_custkey % 3 = 0 then 'two, ' || c_mktsegment end").alias("note"))
    export.write_single_csv(rows.withColumn("row_index", F.dense_rank().over(Window.orderBy("row_index"))), ["name", "note"], path)
    of = spark._jvm.org.apache.hadoop.fs.Path
    part = of(spark.read.text(path).select("_metadata.file_path").first()[0])
    part.getFileSystem(spark._jsc.hadoopConfiguration()).rename(part, of(f"{path}/customers.csv"))
    return read_csv(spark, f"{path}/customers.csv")[0]


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY c_custkey) - 1 AS row_index FROM customer)
SELECT row_index, c_name AS name, CASE c_custkey % 3 WHEN 1 THEN 'two' || chr(13) || chr(10) || 'líneas, "' || c_mktsegment || '"' || chr(10) WHEN 2 THEN 'a "b" c' END AS note, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM n""")
def csv_quoted_lines(spark, sf_dir):
    """Customers as a file of one byte a character with line ends and quotes in cells, short and long rows and blank lines, read in splits."""
    path = shared_folder(spark)
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    quoted = F.concat("c_name", F.lit(',"two\r\nlíneas, ""'), seg, F.lit('""\n",'), seg)
    line = F.when(k % 3 == 1, quoted).when(k % 3 == 2, F.concat("c_name", F.lit(',a "b" c,'), seg, F.lit(",too,many"))).otherwise(F.concat("c_name", F.lit("\n ,\n")))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("at"), F.lit("name,note,segment").alias("line"))
    lines = head.unionByName(table(spark, sf_dir, "customer").select(k.cast("long").alias("at"), line.alias("line")))
    staged = lines.select("at", F.encode("line", "ISO-8859-1").cast("string").alias("line")).coalesce(1).sortWithinPartitions("at").select("line")
    staged.write.text(path)
    of = spark._jvm.org.apache.hadoop.fs.Path
    part = of(spark.read.text(path).select("_metadata.file_path").first()[0])
    part.getFileSystem(spark._jsc.hadoopConfiguration()).rename(part, of(f"{path}/staged.csv"))
    return read_csv(spark, f"{path}/staged.csv")[0]


@query(f"WITH {CHECKED} SELECT row_index, seq FROM i WHERE severity = 'ERROR' AND field = 'email' AND code = 'email_invalid'")
def issues_filtered(spark, sf_dir):
    return validate.issue_rows(flagship(spark, sf_dir), severity="ERROR", field="email", code="email_invalid").select("row_index", "seq")


@query(f"WITH {CHECKED} SELECT row_index, field, code FROM i UNION ALL SELECT NULL, 'plan', 'required_field_unmapped'")
def issues_of_all_kinds(spark, sf_dir):
    contract = make_contract("Customer", [*flagship_contract().fields, {"name": "plan", "required": True}])
    v = conform(dirty_customer(spark, sf_dir).select("row_index", *MAPPING), contract, MAPPING)
    return validate.all_issues(v, contract, set(MAPPING.values())).select("row_index", "field", "code")


@query("""SELECT l_orderkey, l_linenumber, l_returnflag <> 'A' AS neq, o_orderstatus = 'F' AS filled, o_orderstatus <> 'F' AS blank, l_quantity >= 20 AS gte, l_quantity < 20.5 AS lt,
  CAST(o_orderdate AS date) <= CAST(l_shipdate AS date) AS lte_field, CAST(o_orderdate AS date) > CAST(l_shipdate AS date) AS gt_field FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def val_clauses(spark, sf_dir):
    c = lambda f, op, v=None: validate.clause({"field": f, "op": op, "value": v}, F.col)
    lines = _lines(spark, sf_dir).withColumn("maybe", F.when(F.col("o_orderstatus") == "F", "x"))
    clauses = {"neq": c("l_returnflag", "neq", "A"), "filled": c("maybe", "not_empty"), "blank": c("maybe", "empty"), "gte": c("quantity", "gte", 20), "lt": c("quantity", "lt", "20.5"), "lte_field": c("ordered", "lte_field", "shipped"), "gt_field": c("ordered", "gt_field", "shipped")}
    return lines.withColumns(clauses).select("l_orderkey", "l_linenumber", "neq", "filled", "blank", "gte", "lt", "lte_field", "gt_field")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN floor(l_quantity) > 25 THEN 'max' ELSE 'min' END AS code FROM lineitem WHERE floor(l_quantity) > 25 OR floor(l_quantity) < 5")
def val_range_of_long_numbers(spark, sf_dir):
    """Quantities followed by 24 digits against bounds of as many."""
    f = make_contract("x", [{"name": "q", "type": "decimal", "rules": {"min": "5" + "0" * 24, "max": "25" + "0" * 24}}]).fields[0]
    v = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("0" * 24))
    codes = F.array(*[F.when(fails, F.lit(code)) for fails, code, _ in validate.rule_checks(f, v)])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"))
