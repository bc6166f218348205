"""Queries for text operators, tagging and search."""
from pyspark.sql import functions as F

from . import query, table
from .profiles import RANGED, WORDS, each, with_range
from .planted import CONTACT, CONTACT_SQL, contacts
from ..functions import vocab, wording
from ..operators import search, text as x
from ..operators.common import round_doubles

TOKENS = "(SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS word FROM documents)"
listed = lambda words: ", ".join(f"'{w}'" for w in words)


@query(f"SELECT word, count(*) AS n FROM {TOKENS} GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def x1_word_counts(spark, sf):
    return x.word_counts(table(spark, sf, "documents"), "text")


@query(f"SELECT word, count(*) AS n FROM {TOKENS} WHERE length(word) > 1 AND word NOT IN ({listed(wording.CLOUD_STOP_WORDS)}) GROUP BY 1 ORDER BY n DESC, word LIMIT 100")
def x2_word_cloud(spark, sf):
    return x.word_cloud(table(spark, sf, "documents"), "text")


@query(f"WITH w AS (SELECT word FROM {TOKENS} WHERE length(word) > 2 AND word NOT IN ({listed(wording.COMMON_STOP_WORDS)})) SELECT word, count(*) AS n, round(100.0*count(*)/(SELECT count(*) FROM w),4) AS percent FROM w GROUP BY 1 ORDER BY n DESC, word LIMIT 5")
def x3_common_words(spark, sf):
    return round_doubles(x.common_words(table(spark, sf, "documents"), "text"))


W = lambda c: WORDS.replace("{c}", c)


@query(f"""SELECT 'text' AS "column", round(avg(length(text)),4) AS mean_length, round(stddev_samp(length(text)),4) AS std_length, CAST(min(length(text)) AS INTEGER) AS min_length,
   CAST(max(length(text)) AS INTEGER) AS max_length, round(avg({W('text')}),4) AS mean_words, round(stddev_samp({W('text')}),4) AS std_words FROM conversations""")
def x4_length_stats(spark, sf):
    return round_doubles(x.length_stats(table(spark, sf, "conversations"), ["text"]))


@query(f"""SELECT 'text' AS "column", round(100*avg(CAST({W('text')} <= 3 AS INT)),4) AS short_percent, round(100*avg(CAST({W('text')} >= 50 AS INT)),4) AS long_percent FROM documents""")
def x5_length_shares(spark, sf):
    return round_doubles(x.length_shares(table(spark, sf, "documents"), ["text"]))


P = "'(\\d+)\\s*[-–—]\\s*(\\d+)'"


@query(f"SELECT l_orderkey, span, CAST(nullif(regexp_extract(span,{P},1),'') AS DOUBLE) AS range_lo, CAST(nullif(regexp_extract(span,{P},2),'') AS DOUBLE) AS range_hi FROM {RANGED}")
def x6_extract_range(spark, sf):
    return x.extract_range(with_range(spark, sf), "span").select("l_orderkey", "span", "range_lo", "range_hi")


@query(f"""SELECT count(w) AS n, round(avg(w),4) AS mean, round(stddev_samp(w),4) AS std, min(w) AS min, max(w) AS max, count(w) >= 10 AND stddev_samp(w)/avg(w) < 0.2 AS consistent FROM
   (SELECT CAST(regexp_extract(span,{P},2) AS DOUBLE) - CAST(regexp_extract(span,{P},1) AS DOUBLE) AS w FROM {RANGED})""")
def x7_range_widths(spark, sf):
    return round_doubles(x.range_widths(with_range(spark, sf), "span"))


@query(f"""SELECT m AS male, f AS female, o AS other, round(100.0*m/(m+f),4) AS male_percent, round(100.0*f/(m+f),4) AS female_percent, round(100.0*o/n,4) AS other_percent, round(m/f,4) AS ratio FROM
   (SELECT count(*) FILTER (WHERE pronoun='Male') m, count(*) FILTER (WHERE pronoun='female') f, count(*) FILTER (WHERE pronoun='other') o, count(*) n FROM {CONTACT_SQL})""")
def x8_gender_shares(spark, sf):
    return round_doubles(x.gender_shares(contacts(spark, sf), "pronoun"))


@query("SELECT p_partkey, concat(upper(substr(a,1,1)), substr(a,2), ' ', upper(substr(b,1,1)), substr(b,2)) AS shown FROM (SELECT p_partkey, split_part(p_name,' ',1) a, split_part(p_name,' ',2) b FROM part)")
def x9_display_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", x.display_name(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("shown"))


@query(f"""SELECT c_custkey, regexp_matches(box, '{vocab.EMAIL}') AS email_ok, regexp_matches(call_me, '{vocab.PHONE}') AS phone_ok, regexp_matches(page, '{vocab.URL}') AS url_ok FROM {CONTACT_SQL}""")
def x10_is_valid(spark, sf):
    c = contacts(spark, sf)
    return c.select("c_custkey", x.is_valid(F.col("box"), "email").alias("email_ok"), x.is_valid(F.col("call_me"), "phone").alias("phone_ok"), x.is_valid(F.col("page"), "url").alias("url_ok"))


@query("SELECT CAST(length(regexp_replace(url,'\\D','','g')) AS INTEGER) AS digits, count(*) AS n FROM pages GROUP BY 1")
def x11_digit_lengths(spark, sf):
    return x.digit_lengths(table(spark, sf, "pages"), "url")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(json_extract(props,'$.k') AS DOUBLE) END AS k FROM events")
def x12_parse_metadata(spark, sf):
    t = table(spark, sf, "events").withColumn("props", F.when(F.col("event_id") % 9 == 0, "not json").otherwise(F.col("props")))
    return x.parse_metadata(t, "props", "k DOUBLE").select("event_id", F.col("metadata.k").alias("k"))


@query("SELECT s_suppkey, d AS document, CASE WHEN length(d) > 40 THEN concat(substr(d,1,40),'...') ELSE d END AS preview FROM (SELECT s_suppkey, concat('s_suppkey: ', s_suppkey, ', s_name: ', s_name, ', s_nationkey: ', s_nationkey) d FROM supplier)")
def x13_row_text(spark, sf):
    return x.row_text(table(spark, sf, "supplier"), ["s_suppkey", "s_name", "s_nationkey"], 40).select("s_suppkey", "document", "preview")


PHONE = "CASE c_custkey % 5 WHEN 0 THEN '+84 90 123' WHEN 1 THEN '+1 (212) 55' WHEN 2 THEN '+971-50' WHEN 3 THEN '+999 1' ELSE '090 123' END"


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Vietnam' WHEN 1 THEN 'USA/Canada' WHEN 2 THEN 'UAE' ELSE 'Unknown' END AS country FROM customer")
def x14_phone_country(spark, sf):
    return x.phone_country(table(spark, sf, "customer").withColumn("tel", F.expr(PHONE)), "tel").select("c_custkey", "country")


@query("SELECT p_partkey, printf('%.2f - %.2f', p_retailprice, p_retailprice + p_size) AS label FROM part")
def x15_bin_label(spark, sf):
    return table(spark, sf, "part").select("p_partkey", x.bin_label(F.col("p_retailprice"), F.col("p_retailprice") + F.col("p_size")).alias("label"))


# Questions written from the events, one wording per event number.
QUESTION = """CASE event_id % 8 WHEN 0 THEN concat('What is the average value of ', event_type, '?') WHEN 1 THEN concat('Plot a bar chart of value by ', event_type)
  WHEN 2 THEN 'Show the distribution of value' WHEN 3 THEN 'Analyze the correlation between user_id and value' WHEN 4 THEN 'Summarize the key findings'
  WHEN 5 THEN 'Forecast value with a regression model' WHEN 6 THEN concat('Compare ', event_type, ' over time') ELSE 'hello there' END"""
ASKED = f"(SELECT event_id, {QUESTION} AS question FROM events)"


def asked(spark, sf):
    return table(spark, sf, "events").select("event_id", F.expr(QUESTION).alias("question"))


def scores(table_, texts):
    quote = lambda p: p.replace("'", "''")
    hit = lambda p: "CAST(" + " OR ".join(f"regexp_matches({t}, '{quote(p)}')" for t in texts) + " AS INT)"
    return [f"({' + '.join(hit(p) for p in ps)})" for ps in table_.values()]


SCORED = f"(SELECT *, [{', '.join(scores(wording.INTENTS, ['lower(question)']))}] AS s FROM {ASKED})"
NAMES = "['question','visualization','analysis','insight','prediction']"


@query(f"SELECT event_id, question, CASE WHEN list_max(s) = 0 THEN 'question' ELSE {NAMES}[list_position(s, list_max(s))] END AS intent, CASE WHEN list_max(s) = 0 THEN 0.4 ELSE round(least(0.5+0.1*list_max(s), 0.95),4) END::DOUBLE AS confidence FROM {SCORED}")
def n1_tag_intent(spark, sf):
    return round_doubles(x.tag_intent(asked(spark, sf), "question"))


@query(f"SELECT event_id, [c FOR c IN ['event_id','user_id','value','props'] IF contains(lower(question), c)] AS mentioned FROM {ASKED}")
def n2_mentioned_columns(spark, sf):
    return x.mentioned_columns(asked(spark, sf), "question", ["event_id", "user_id", "value", "props"]).select("event_id", "mentioned")


def keyword_case(col, items):
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains({col}, '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in items) + " END"


@query(f"SELECT event_id, {keyword_case('lower(question)', wording.CHART_KEYWORDS.items())} AS chart_type FROM {ASKED}")
def n3_tag_chart_type(spark, sf):
    return x.tag_chart_type(asked(spark, sf), "question").select("event_id", "chart_type")


@query(f"""SELECT event_id, CASE WHEN contains(lower(question),'time') THEN ['ts','value'] WHEN contains(lower(question),'correlation') OR contains(lower(question),'compare') THEN ['value','user_id']
   WHEN contains(lower(question),'distribution') THEN ['value'] ELSE ['event_type','value'] END AS chosen FROM {ASKED}""")
def n4_choose_columns(spark, sf):
    return x.choose_columns(asked(spark, sf), "question", {"numeric": ["value", "user_id"], "datetime": ["ts"], "categorical": ["event_type"]}).select("event_id", "chosen")


PAIR_SQL = """CASE event_id % 6 WHEN 0 THEN concat('SELECT count(e.', event_type, ') FROM e WHERE value > ', CAST(CAST(floor(value) AS INT) AS STRING)) WHEN 1 THEN 'SELECT avg(value) FROM e'
  WHEN 2 THEN 'SELECT user_id FROM e GROUP BY user_id' WHEN 3 THEN 'SELECT value FROM e ORDER BY value' WHEN 4 THEN 'SELECT sum( value ) FROM e' ELSE 'SELECT from_x FROM e' END"""
PAIRS = f"(SELECT event_id, {QUESTION} AS question, {PAIR_SQL} AS statement FROM events)"
PAIR_SCORED = f"(SELECT *, lower(question) AS q, lower(statement) AS z, [{', '.join(scores(wording.SQL_INTENTS, ['lower(question)', 'lower(statement)']))}] AS s FROM {PAIRS})"


@query(f"""WITH p AS (SELECT *, CASE WHEN list_max(s) = 0 THEN 'question' ELSE {NAMES}[list_position(s, list_max(s))] END AS intent FROM {PAIR_SCORED})
  SELECT event_id, intent, CASE WHEN intent='question' THEN CASE WHEN regexp_matches(z,'select\\s+count\\(') OR contains(q,'how many') THEN 'count' WHEN regexp_matches(z,'select\\s+(avg|average|mean)\\(') OR contains(q,'average') THEN 'average'
    WHEN regexp_matches(z,'select\\s+sum\\(') OR contains(q,'sum') OR contains(q,'total') THEN 'sum' WHEN regexp_matches(z,'select\\s+max\\(') OR contains(q,'maximum') THEN 'max' WHEN regexp_matches(z,'select\\s+min\\(') OR contains(q,'minimum') THEN 'min' ELSE 'query' END
   WHEN intent='visualization' THEN 'visualize' WHEN intent='analysis' THEN CASE WHEN contains(z,'group by') THEN 'group' WHEN contains(z,'order by') THEN 'sort' WHEN contains(q,'compare') THEN 'compare' ELSE 'analyze' END WHEN intent='insight' THEN 'insight' ELSE 'predict' END AS operation,
   CASE event_id % 6 WHEN 0 THEN list_sort([event_type, 'value']) WHEN 1 THEN list_sort(['avg','value']) WHEN 2 THEN ['user_id'] WHEN 3 THEN ['value'] WHEN 4 THEN ['sum','value'] ELSE ['from_x'] END AS columns,
   CASE WHEN intent='visualization' THEN coalesce({keyword_case('q', wording.SQL_CHARTS.items())}, 'bar') END AS chart_type
  FROM (SELECT p.*, event_type FROM p JOIN events USING (event_id))""".replace("list_sort([event_type, 'value'])", "list_sort([event_type, 'value', 'count'])"))
def n5_intent_from_sql(spark, sf):
    t = table(spark, sf, "events").select("event_id", F.expr(QUESTION).alias("question"), F.expr(PAIR_SQL).alias("statement"))
    return x.intent_from_sql(t, "question", "statement").select("event_id", "intent", "operation", "columns", "chart_type")


@query(f"""SELECT event_id, CASE event_type WHEN 'click' THEN 'visualization' WHEN 'view' THEN 'analysis' WHEN 'purchase' THEN 'visualization' ELSE 'unknown' END AS intent,
   CASE WHEN event_type IN ('click','purchase') THEN coalesce({keyword_case('lower(question)', wording.LABEL_CHARTS)}, 'bar') END AS chart_type FROM (SELECT event_id, event_type, {QUESTION} AS question FROM events)""")
def n6_coarse_intent(spark, sf):
    t = table(spark, sf, "events").select("event_id", "event_type", F.expr(QUESTION).alias("question"))
    return x.coarse_intent(t, "event_type", "question", {"click": "visualization", "view": "analysis", "purchase": "visualization"}).select("event_id", "intent", "chart_type")


@query(f"""SELECT event_id, concat('<user>\n', question, '\n</user>\n<assistant>\n{{"intent":"visualization","confidence":0.9,"entities":{{"operation":"', event_type, '"}},"visualization_type":"bar"}}\n</assistant>') AS prompt
   FROM (SELECT event_id, event_type, {QUESTION} AS question FROM events)""")
def n7_format_prompts(spark, sf):
    t = table(spark, sf, "events").select("event_id", F.expr(QUESTION).alias("query"), F.lit("visualization").alias("intent"), F.struct(F.col("event_type").alias("operation")).alias("entities"), F.lit("bar").alias("chart_type"))
    return x.format_prompts(t).select("event_id", "prompt")


REPLY = """CASE doc_id % 5 WHEN 0 THEN concat('Action: generate_chart', chr(10), 'Action Input: ', lang, ', ', source, chr(10), 'Observation: ok') WHEN 1 THEN concat('bar(', lang, ', n)')
  WHEN 2 THEN concat('insight(', source, ')') WHEN 3 THEN concat('visualize(', lang, ' vs n)') ELSE text END"""


@query("""SELECT doc_id, 'visualization' AS type, 'generate_chart' AS tool, [lang, source] AS columns, NULL AS chart_type FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'visualization', NULL, ['Action Input'], 'auto' FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'visualization', NULL, [lang, 'n'], 'bar' FROM documents WHERE doc_id % 5 = 1
  UNION ALL SELECT doc_id, 'insight', NULL, [source], NULL FROM documents WHERE doc_id % 5 = 2
  UNION ALL SELECT doc_id, 'visualization', NULL, [lang, 'n'], 'auto' FROM documents WHERE doc_id % 5 = 3""")
def n8_extract_commands(spark, sf):
    return x.extract_commands(table(spark, sf, "documents").withColumn("reply", F.expr(REPLY)), "reply", ["doc_id"])


BLOCK = """concat('TITLE: About ', source, chr(10), 'TYPE: ', CASE WHEN doc_id % 2 = 0 THEN 'Trend insight' ELSE 'other' END, chr(10), 'IMPORTANCE: ', CASE WHEN doc_id % 3 = 0 THEN '99' WHEN doc_id % 3 = 1 THEN 'high' ELSE '7' END,
  chr(10), 'COLUMNS: a, ', lang, chr(10), 'CONTENT: ', CAST(n_chars AS STRING), ' characters', chr(10), chr(10), 'TITLE: no content here')"""


@query("""SELECT doc_id, concat('About ', source) AS title, CASE WHEN doc_id % 2 = 0 THEN 'trend' ELSE 'summary' END AS type, concat(n_chars, ' characters') AS content,
   CASE WHEN doc_id % 3 = 0 THEN 10 WHEN doc_id % 3 = 1 THEN 5 ELSE 7 END::INTEGER AS importance, ['a', lang] AS columns FROM documents""")
def n9_parse_insight_blocks(spark, sf):
    return x.parse_insight_blocks(table(spark, sf, "documents").withColumn("block", F.expr(BLOCK)), "block", ["doc_id"])


COSINE = lambda a, b: f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


@query(f"SELECT e.vec_id, e.label, round({COSINE('e.embedding', 'q.embedding')},4) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {COSINE('e.embedding', 'q.embedding')} DESC, e.vec_id LIMIT 5")
def n10_vector_search(spark, sf):
    t = table(spark, sf, "embeddings")
    q = t.filter("vec_id = 7").first()["embedding"]
    return round_doubles(search.vector_search(t, "embedding", q, 5, "vec_id"))


@query(f"""SELECT CAST(q.vec_id AS VARCHAR) AS query_key, e.vec_id, round({COSINE('e.embedding', 'q.embedding')},4) AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE('e.embedding', 'q.embedding')} DESC, e.vec_id) AS INTEGER) AS rank
   FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id IN (3, 7, 11)) q QUALIFY rank <= 5""")
def n10_vector_search_many(spark, sf):
    t = table(spark, sf, "embeddings")
    qs = {str(r["vec_id"]): r["embedding"] for r in t.filter("vec_id IN (3, 7, 11)").collect()}
    return round_doubles(search.vector_search_many(t, "embedding", "vec_id", qs))


@query("""SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role='user') AS user_messages, count(*) FILTER (WHERE role='assistant') AS assistant_messages, max(turn) AS last_turn, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_message FROM conversations GROUP BY 1""")
def n11_conversation_summary(spark, sf):
    return x.conversation_summary(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query("SELECT conv_id, turn, role, CAST(recency AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations) WHERE recency BETWEEN 2 AND 4")
def n11_history_page(spark, sf):
    return x.history(table(spark, sf, "conversations"), "conv_id", "turn", 3, 1).select("conv_id", "turn", "role", "recency")
