"""Queries for semantic roles."""
import re

from . import query
from .planted import CONTACT, CONTACT_SQL, CONTACT_TEXT, contacts
from .profiles import each
from ..functions import vocab
from ..operators import roles as ro
from ..operators.common import round_doubles

KINDS = {c: "numeric" if c in ("c_custkey", "grade", "balance") else "string" for c in CONTACT}
E = "WITH t AS " + CONTACT_SQL + ", e AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS col, '{k}' AS kind, count(*) n, count({c}) f, count(DISTINCT {c}) d, CAST(min({c}) AS VARCHAR) lo, CAST(max({c}) AS VARCHAR) hi,
    {'count(DISTINCT ' + c + ') = max(' + c + ')-min(' + c + ')+1' if k == 'numeric' else 'false'} AS consecutive FROM t""" for c, k in KINDS.items()) + ")"


def named(term):
    return ", ".join(f"'{c}'" for c in CONTACT if re.search(vocab.NAME_TERMS[term], c, re.I)) or "''"


def verdict(sql):
    return f"""{E} SELECT col AS "column", round(CAST(x AS DOUBLE),4) AS evidence, coalesce(m, false) AS match FROM ({sql})"""


@query(verdict(f"SELECT col, d/n AS x, d/n > 0.9 AND ((kind='numeric' AND col <> 'balance') OR col IN ({named('id')})) AS m FROM e"))
def r1_is_id(spark, sf):
    return round_doubles(ro.is_id(contacts(spark, sf)))


@query(verdict("""SELECT col, d AS x, d = 2 AND ((kind='numeric' AND lo IN ('0','0.0') AND hi IN ('1','1.0')) OR
    (kind='string' AND lower(trim(lo)) IN ('yes','no','true','false','y','n') AND lower(trim(hi)) IN ('yes','no','true','false','y','n'))) AS m FROM e"""))
def r2_is_binary(spark, sf):
    return round_doubles(ro.is_binary(contacts(spark, sf)))


@query(verdict("SELECT col, d AS x, kind='numeric' AND d BETWEEN 3 AND 10 AND consecutive AND CAST(lo AS DOUBLE) = 1 AND CAST(hi AS DOUBLE) BETWEEN 3 AND 10 AS m FROM e WHERE kind='numeric' UNION ALL SELECT col, d, false FROM e WHERE kind='string'"))
def r3_is_likert(spark, sf):
    return round_doubles(ro.is_likert(contacts(spark, sf)))


def shipping_notes(spark, sf):
    from pyspark.sql import functions as F
    from . import table
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_date_text"),
                     F.when(F.col("l_linenumber") == 1, "unknown").otherwise(F.date_format("l_shipdate", "dd/MM/yyyy")).alias("due_day"), "l_returnflag")


@query("""SELECT 'l_orderkey' AS "column", 0.0::DOUBLE AS evidence, false AS match UNION ALL SELECT 'l_shipdate', 1.0, true UNION ALL SELECT 'ship_date_text', 1.0, true
   UNION ALL SELECT 'due_day', round(x,4), x >= 0.85 FROM (SELECT avg(CASE WHEN l_linenumber=1 THEN 0.0 ELSE 1.0 END) x FROM lineitem) UNION ALL SELECT 'l_returnflag', 0.0, false""")
def r4_is_datetime(spark, sf):
    return round_doubles(ro.is_datetime(shipping_notes(spark, sf)))


@query(verdict("SELECT col, CASE WHEN kind='numeric' THEN 1 ELSE 0 END AS x, kind='numeric' AS m FROM e"))
def r5_is_numeric(spark, sf):
    return ro.is_numeric_role(contacts(spark, sf))


def text_verdict(template):
    return f"WITH t AS {CONTACT_SQL} SELECT col AS \"column\", round(CAST(x AS DOUBLE),4) AS evidence, coalesce(m,false) AS match FROM (" + each(template, CONTACT_TEXT) + ")"


GENDER_WORDS = "'gender','sex','male','female','nam','nữ','boy','girl','man','woman','m','f','men','women'"


@query(text_verdict(f"SELECT '{{c}}' AS col, count(DISTINCT lower({{c}})) FILTER (WHERE len(list_intersect(string_split_regex(lower({{c}}),'[^a-zữ]+'), [{GENDER_WORDS}]))>0) AS x, "
                    f"count(DISTINCT lower({{c}})) BETWEEN 2 AND 5 AND count(DISTINCT lower({{c}})) FILTER (WHERE len(list_intersect(string_split_regex(lower({{c}}),'[^a-zữ]+'), [{GENDER_WORDS}]))>0) >= 2 AS m FROM t"))
def r6_is_gender(spark, sf):
    return round_doubles(ro.is_gender(contacts(spark, sf)))


def share(pattern, lower=False):
    c = "lower({c})" if lower else "{c}"
    return f"avg(CASE WHEN regexp_matches({c}, '{pattern}') THEN 1.0 ELSE 0.0 END)"


def share_verdict(pattern):
    s = share(pattern)
    return text_verdict(f"SELECT '{{c}}' AS col, {s} AS x, {s} > 0.9 AS m FROM t")


@query(share_verdict(vocab.EMAIL))
def r7_is_email(spark, sf):
    return round_doubles(ro.is_email(contacts(spark, sf)))


@query(share_verdict(vocab.PHONE))
def r8_is_phone(spark, sf):
    return round_doubles(ro.is_phone(contacts(spark, sf)))


US, UK, VN = [" + ".join(f"{w}*{share(p, True)}" for g, w, p in vocab.ADDRESS_PATTERNS if g == k) for k in ("us", "uk", "vn")]
SCORE = f"greatest({US}, {UK}, {VN}) + 2*{share(vocab.HOUSE_NUMBER, True)} + 0.5*least(avg(length({{c}})-length(replace({{c}},',',''))), 3)"


@query(text_verdict(f"SELECT '{{c}}' AS col, {SCORE} AS x, avg(length({{c}})) >= 10 AND {SCORE} > 1 AS m FROM t"))
def r9_is_address(spark, sf):
    return round_doubles(ro.is_address(contacts(spark, sf)))


CMP = "[" + ", ".join(share(p, True) for p in vocab.COMPARISONS) + "]"
UNIT = "|".join(r"\d+\s*" + re.escape(u) for u in vocab.UNITS)


@query(text_verdict(f"""SELECT col, greatest(h, o, s) AS x, h > 0.4 OR o > 0.4 OR list_max(k) > 0.2 OR s > 0.3 OR (u > 0.5 AND (h > 0.1 OR o > 0.1 OR s > 0.1)) AS m FROM
   (SELECT '{{c}}' AS col, {share(vocab.HYPHEN_RANGE)} h, {share(vocab.TO_RANGE, True)} o, {share(UNIT, True)} u, {CMP} k, list_sum({CMP}) s FROM t)"""))
def r10_is_range(spark, sf):
    return round_doubles(ro.is_range(contacts(spark, sf)))


WORDS = "len(string_split_regex(trim({c}), '\\s+'))"


@query(text_verdict(f"SELECT '{{c}}' AS col, avg({WORDS}) AS x, avg({WORDS}) BETWEEN 1 AND 4 AND {share('[0-9]')} < 0.05 AS m FROM t"))
def r11_is_name(spark, sf):
    return round_doubles(ro.is_name(contacts(spark, sf)))


@query(share_verdict(vocab.URL))
def r12_is_url(spark, sf):
    return round_doubles(ro.is_url(contacts(spark, sf)))


@query(verdict("SELECT col, d AS x, d <= least(20.0, n*0.1) AS m FROM e WHERE kind='string'"))
def r13_categorical_or_text(spark, sf):
    return round_doubles(ro.categorical_or_text(contacts(spark, sf)))


@query(f"""{E} SELECT col AS "column", CASE WHEN kind='numeric' THEN 'numeric' WHEN d < least(20.0, n*0.5) THEN 'categorical' ELSE 'text' END AS role FROM e""")
def r14_basic_roles(spark, sf):
    return ro.basic_roles(contacts(spark, sf))


# Roles expected of the planted columns, in table order.
EXPECTED = {"c_custkey": "id", "box": "email", "call_me": "phone", "home": "address", "bracket": "range", "person": "name", "page": "url",
            "pronoun": "gender", "segment": "name", "agreed": "binary", "grade": "likert", "balance": "numeric", "note": "text"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {i}, '{r}')" for i, (c, r) in enumerate(EXPECTED.items())) + ') v("column", position, role)')
def infer_roles(spark, sf):
    return ro.infer_roles(contacts(spark, sf))


@query("SELECT role, count(*) AS n, string_agg(c, ',' ORDER BY c) AS columns, round(100.0*count(*)/13,4) AS percent FROM (VALUES " + ", ".join(f"('{c}', '{r}')" for c, r in EXPECTED.items()) + ") v(c, role) GROUP BY 1")
def r15_role_summary(spark, sf):
    return round_doubles(ro.role_summary(ro.infer_roles(contacts(spark, sf))))


IDISH = ", ".join(f"'{c}'" for c in CONTACT if any(t in c.lower() for t in ("id", "uuid", "guid", "key", "code", "sku", "index")))


@query(verdict(f"SELECT col, d/n AS x, (kind='numeric' AND d/n > 0.8) OR (col IN ({IDISH}) AND d/n > 0.64) OR (d/n > 0.95 AND n > 100) AS m FROM e"))
def r16_is_id_by_ratio(spark, sf):
    return round_doubles(ro.is_id_by_ratio(contacts(spark, sf)))


def typed_text(spark, sf):
    from pyspark.sql import functions as F
    from . import table
    o = table(spark, sf, "orders")
    return o.select(F.col("o_custkey").cast("string").alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("b"),
                    F.when(F.col("o_orderkey") % 2 == 0, "Yes").otherwise("no").alias("c"),
                    F.when(F.col("o_orderkey") % 3 == 0, "12.5").otherwise(F.col("o_orderpriority")).alias("d"))


TYPED = """(SELECT CAST(o_custkey AS VARCHAR) a, strftime(o_orderdate,'%Y-%m-%d') b, CASE WHEN o_orderkey%2=0 THEN 'Yes' ELSE 'no' END c,
   CASE WHEN o_orderkey%3=0 THEN '12.5' ELSE o_orderpriority END d FROM orders)"""


@query(each(f"""SELECT '{{c}}' AS "column", CASE WHEN bool_and(try_cast({{c}} AS DOUBLE) IS NOT NULL) THEN 'number' WHEN bool_and(try_cast({{c}} AS TIMESTAMP) IS NOT NULL) THEN 'date'
   WHEN bool_and(lower({{c}}) IN ('true','false','yes','no','0','1','y','n')) THEN 'boolean' ELSE 'string' END AS type FROM {TYPED}""", "abcd"))
def r17_primitive_types(spark, sf):
    return ro.primitive_types(typed_text(spark, sf))


@query(each(f"""SELECT '{{c}}' AS "column", CASE WHEN dt >= nu AND dt >= tx AND dt > nu THEN 'datetime' WHEN nu >= tx THEN 'numeric' ELSE 'text' END AS type FROM
   (SELECT count(*) FILTER (WHERE k='d') dt, count(*) FILTER (WHERE k='n') nu, count(*) FILTER (WHERE k='t') tx FROM
   (SELECT CASE WHEN try_cast({{c}} AS DATE) IS NOT NULL THEN 'd' WHEN try_cast({{c}} AS DOUBLE) IS NOT NULL THEN 'n' ELSE 't' END k FROM {TYPED}))""", "abcd"))
def r18_majority_types(spark, sf):
    return ro.majority_types(typed_text(spark, sf))
