"""Checks of the scoring operators (group C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as hx
from ..operators import extract as ex
from ..operators import scoring as sc
from . import sqltext as q
from .catalog_extract import articles
from .oracle import cte, query
from .tables import AS_OF, Tables


def lit(p: str) -> str:
    return p.replace("'", "''")


def read_cols(text: str) -> str:
    """sentences, words, syllables of a text in DuckDB."""
    return f"""greatest(1, {q.n(text, '[^.!?\\s][^.!?]*')})::INTEGER AS sentences,
  {q.n(q.plain(text), '\\b[a-zA-Z]+\\b')}::INTEGER AS words,
  greatest(1, coalesce(list_sum(list_transform(regexp_extract_all({q.plain(f"lower({text})")}, '\\b[a-z]+\\b'), lambda w: CASE WHEN length(w) <= 2 THEN 1
    ELSE greatest(1, len(regexp_extract_all(CASE WHEN w LIKE '%e' AND w NOT LIKE '%le' THEN left(w, length(w) - 1) ELSE w END, '[aeiouy]+'))) END)), 0))::INTEGER AS syllables"""


FRE = "CASE WHEN words = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, least(100.0, 206.835::DOUBLE - 1.015::DOUBLE * (words / sentences) - 84.6::DOUBLE * (syllables / words))) END"
GRADE = "CASE WHEN words = 0 THEN 0.0::DOUBLE ELSE greatest(0.0, round_even(0.39::DOUBLE * (words / sentences) + 11.8::DOUBLE * (syllables / words) - 15.59::DOUBLE, 1)) END"
cte("readable", f"SELECT *, {FRE} AS fre, {GRADE} AS grade FROM (SELECT post_id, site_id, language, body_text, {read_cols('body_text')} FROM posts)", "posts")


@query("c1_text_counts", "SELECT post_id, sentences, words, syllables FROM readable", "readable")
def c1(t: Tables):
    return sc.readability(t.posts).select("post_id", "sentences", "words", "syllables")


@query("c2_reading_ease", "SELECT post_id, round(fre, 6) AS reading_ease FROM readable", "readable")
def c2(t: Tables):
    return sc.readability(t.posts).select("post_id", F.round("reading_ease", 6).alias("reading_ease"))


@query("c3_grade_level", "SELECT post_id, grade FROM readable", "readable")
def c3(t: Tables):
    return sc.readability(t.posts).select("post_id", "grade")


@query("c4_hard_paragraphs", f"""
WITH p AS (SELECT doc_id AS post_id, unnest(ps) AS para, unnest(range(len(ps)))::INTEGER AS index FROM (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {q.strip('x')}), lambda x: length(x) > 50) AS ps FROM documents)),
r AS (SELECT *, {FRE} AS fre FROM (SELECT *, {read_cols('para')} FROM p))
SELECT post_id, index, round_even(fre, 1) AS flesch, left(para, 100) AS preview FROM r WHERE fre < 30 AND {q.words('para')} > 20
QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY round_even(fre, 1), index) <= 3
""")
def c4(t: Tables):
    docs = t.raw("documents").select(F.col("doc_id").alias("post_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("body_text"))
    return sc.hard_paragraphs(docs)


@query("c5_readability_job", """
WITH f AS (SELECT site_id, post_id, language FROM posts WHERE length(body_text) > 100 QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY post_id) <= 5),
v AS (SELECT site_id, language, count(*) AS n, min(post_id) AS p FROM f GROUP BY 1, 2),
b AS (SELECT site_id, language, n, sum(n) OVER (PARTITION BY site_id) AS size FROM v QUALIFY row_number() OVER (PARTITION BY site_id ORDER BY n DESC, p) = 1),
l AS (SELECT site_id, CASE WHEN n >= greatest(1, size - 1) THEN language END AS lang FROM b)
SELECT post_id, r.site_id, round(fre, 6) AS reading_ease, grade FROM readable r JOIN l ON l.site_id = r.site_id
WHERE length(body_text) > 100 AND coalesce(lang, language) = 'en'
""", "readable")
def c5(t: Tables):
    return sc.readability_job(t.posts).withColumn("reading_ease", F.round("reading_ease", 6))


# fixed values: openings that give the synthetic titles an intent
OPENERS = [
    "Best tools", "Buy now", "Why I won’t buy", "Pricing of", "Alpha vs beta", "Login help", "How to", "We recommend",
    "Top 10", "Customers buy", "Never stop: buy the", "Compare plans", "Support desk", "Free trial",
]
OPENERS_SQL = "[" + ",".join(f"'{lit(o)}'" for o in OPENERS) + "]"
cte("titled", f"SELECT post_id, site_id, {OPENERS_SQL}[post_id % {len(OPENERS)} + 1] || ' ' || title AS title, 'https://x.example.com/blog/' || CASE WHEN post_id % 9 = 0 THEN 'best-' WHEN post_id % 11 = 0 THEN 'help-' ELSE 'a-' END || post_id AS url, word_count FROM posts", "posts")


def opened(title):
    """A title behind its opening."""
    return F.concat(F.element_at(F.array(*map(F.lit, OPENERS)), (F.col("post_id") % len(OPENERS) + 1).cast("int")), F.lit(" "), title)


def titled(t: Tables):
    slug = F.when(F.col("post_id") % 9 == 0, "best-").when(F.col("post_id") % 11 == 0, "help-").otherwise("a-")
    return t.posts.select(
        "post_id", "site_id", opened(F.col("title")).alias("title"),
        F.concat(F.lit("https://x.example.com/blog/"), slug, F.col("post_id").cast("string")).alias("url"), "word_count",
    )


cte("intents", f"""
SELECT post_id, CASE
  WHEN regexp_matches(slug, '{sc.TRANSACTIONAL_SLUG}') THEN 'transactional' WHEN regexp_matches(slug, '{sc.COMMERCIAL_SLUG}') THEN 'commercial'
  WHEN regexp_matches(slug, '{sc.NAVIGATIONAL_SLUG}') THEN 'navigational'
  WHEN regexp_matches(txt, '\\bbuy\\b') AND NOT neg AND NOT regexp_matches(txt, '{sc.BUY_STORY}') AND (regexp_matches(txt, '{sc.BUY_NOW}') OR contains(slug, 'buy')) THEN 'transactional'
  WHEN regexp_matches(txt, '{sc.TRANSACTIONAL}') THEN 'transactional'
  WHEN regexp_matches(array_to_string(regexp_extract_all(lower(name), '\\S+')[1:4], ' '), '^(best|top\\s*\\d+|(\\d+\\s+)?best)') THEN 'commercial'
  WHEN regexp_matches(txt, '\\breview\\b') AND slug LIKE '%-review' THEN 'commercial'
  WHEN regexp_matches(txt, '\\b(i|we)\\s+recommend\\b') THEN 'commercial'
  WHEN regexp_matches(txt, '{sc.COMMERCIAL}') THEN 'commercial' WHEN regexp_matches(txt, '{sc.NAVIGATIONAL}') THEN 'navigational'
  ELSE 'informational' END AS intent
FROM (SELECT *, lower(name || ' ' || slug) AS txt, CASE WHEN instr(lower(name), 'buy') <= 1 THEN false
    ELSE regexp_matches(substring(name, greatest(1, instr(lower(name), 'buy') - 50), least(50, instr(lower(name), 'buy') - 1)), '{lit(sc.NEGATION)}') END AS neg
  FROM (SELECT post_id, {q.plain("replace(replace(title, '’', ''''), '‘', '''')")} AS name, lower(regexp_extract(url, '[^/]*$', 0)) AS slug FROM titled))
""", "titled")


@query("c6_content_intent", "SELECT post_id, intent FROM intents", "intents")
def c6(t: Tables):
    return titled(t).select("post_id", sc.content_intent(F.col("title"), F.col("url")).alias("intent"))


@query("c7_negation_lookback", f"""
SELECT post_id, CASE WHEN instr(lower(name), 'buy') <= 1 THEN false
  ELSE regexp_matches(substring(name, greatest(1, instr(lower(name), 'buy') - 50), least(50, instr(lower(name), 'buy') - 1)), '{lit(sc.NEGATION)}') END AS negated
FROM (SELECT post_id, {q.plain("replace(title, '’', '''')")} AS name FROM titled)
""", "titled")
def c7(t: Tables):
    return titled(t).select("post_id", sc.negated_before(F.col("title"), "buy").alias("negated"))


cte("gscq", """
SELECT user_id AS post_id, date, CASE event_type WHEN 'view' THEN 'how to do ' WHEN 'click' THEN 'best ' WHEN 'purchase' THEN 'Buy cheap ' WHEN 'signup' THEN 'login ' ELSE 'plain ' END || k AS query,
  count(*) AS impressions FROM ev GROUP BY ALL
""", "ev")


def phrased_queries(t: Tables):
    e = F.col("event_type")
    phrase = F.when(e == "view", "how to do ").when(e == "click", "best ").when(e == "purchase", "Buy cheap ").when(e == "signup", "login ").otherwise("plain ")
    return t.events.groupBy(F.col("user_id").alias("post_id"), "date", F.concat(phrase, F.col("k").cast("string")).alias("query")).agg(
        F.count("*").alias("impressions")
    )


QI = "CASE WHEN query LIKE 'Buy%' THEN 'transactional' WHEN query LIKE 'best%' THEN 'commercial' WHEN query LIKE 'login%' THEN 'navigational' ELSE 'informational' END"


@query("c8_query_intent", f"SELECT query, {QI} AS intent, sum(impressions)::BIGINT AS impressions FROM gscq GROUP BY query", "gscq")
def c8(t: Tables):
    return phrased_queries(t).groupBy("query").agg(F.sum("impressions").alias("impressions")).withColumn("intent", sc.query_intent(F.col("query")))


@query("c9_intent_mismatch", f"""
WITH d AS (SELECT DISTINCT post_id, query FROM gscq WHERE date >= DATE '2024-01-31' - 90),
c AS (SELECT post_id, {QI} AS intent, count(*) AS n, min(query) AS q FROM d GROUP BY 1, 2),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY n DESC, q) = 1)
SELECT p.post_id, content_intent, intent AS query_intent, 'intent_mismatch' AS problem_type, 'high' AS severity
FROM posts p JOIN b USING (post_id) WHERE content_intent <> intent
""", "gscq posts")
def c9(t: Tables):
    return sc.intent_mismatch(t.posts, phrased_queries(t), AS_OF)


def _fam(words):
    return "(" + " OR ".join(f"contains(both_, '{w}')" for w in words) + ")::INT"


@query("c10_ambiguous_intent", f"""
SELECT post_id FROM (SELECT post_id, {' + '.join(_fam(w) for w in sc.STRONG_WORDS.values())} AS hits FROM (SELECT post_id, lower(title) || ' ' || lower(url) AS both_ FROM titled))
WHERE hits = 0 OR hits >= 2
""", "titled")
def c10(t: Tables):
    return titled(t).filter(sc.ambiguous_intent(F.col("title"), F.col("url"))).select("post_id")


@query("c11_intent_counts", "SELECT site_id, intent, count(*) AS n FROM intents JOIN posts USING (post_id) GROUP BY 1, 2", "intents posts")
def c11(t: Tables):
    return sc.intent_counts(titled(t))


cte("cite", f"""
SELECT *, least(100, CASE WHEN data_tables >= 1 THEN 20 ELSE 0 END + CASE WHEN ol_items >= 3 THEN 15 WHEN ol_items >= 1 THEN 7 ELSE 0 END
  + CASE WHEN first_person >= 3 THEN 20 WHEN first_person >= 1 THEN 10 ELSE 0 END + CASE WHEN stats_mentions >= 3 THEN 20 WHEN stats_mentions >= 1 THEN 10 ELSE 0 END
  + CASE WHEN definitions >= 2 THEN 10 WHEN definitions = 1 THEN 5 ELSE 0 END + CASE WHEN ents / w * 1000 >= 15 THEN 10 WHEN ents / w * 1000 >= 8 THEN 5 ELSE 0 END
  + CASE WHEN citations >= 2 THEN 5 ELSE 0 END + CASE WHEN qr >= 0.3 THEN 15 WHEN qr >= 0.15 THEN 7 ELSE 0 END
  + CASE WHEN dd >= 1 THEN 10 WHEN dd >= 0.5 THEN 5 ELSE 0 END + CASE WHEN answer_first THEN 10 ELSE 0 END)::DOUBLE AS cite_score
FROM (SELECT *, question_headers / greatest(total_headers, 1) AS qr, data_points / w * 200 AS dd FROM (
SELECT post_id, site_id, {q.n('body_html', '(?i)<table[\\s>]')} AS data_tables,
  coalesce(list_sum(list_transform(regexp_extract_all(body_html, '(?is)<ol[^>]*>.*?</ol>'), lambda x: {q.n('x', '(?i)<li[\\s>]')})), 0) AS ol_items,
  {q.n('txt', lit(sc.FIRST_PERSON))} AS first_person, {q.n('txt', sc.STATS)} AS stats_mentions, {q.n('txt', '(?m)' + sc.DEFINITION)} AS definitions,
  {q.n('txt', sc.ENTITY)} AS ents, greatest(1, {q.words('txt')}) AS w, {q.n('txt', sc.CITATION)} AS citations,
  {q.n('body_html', '(?is)<h[23][^>]*>.*?</h[23]>')} AS total_headers,
  len(list_filter(regexp_extract_all(body_html, '(?is)<h[23][^>]*>(.*?)</h[23]>', 1), lambda h: regexp_matches({q.inner('h')}, '{sc.QUESTION}'))) AS question_headers,
  {q.n('txt', sc.DATA_POINT)} AS data_points, regexp_matches(f200, '{lit(sc.ANSWER)}') AND regexp_matches(f200, '{sc.ANSWER_FACT}') AS answer_first
FROM (SELECT *, {q.plain('body_text')} AS txt, array_to_string(regexp_extract_all({q.plain('body_text')}, '\\S+')[1:200], ' ') AS f200 FROM articles)))
""", "articles")


@query("c12_citability", """
SELECT post_id, first_person::INTEGER AS first_person, stats_mentions::INTEGER AS stats_mentions, definitions::INTEGER AS definitions, ol_items::INTEGER AS ol_items,
  round(dd, 6) AS data_density, round(qr, 6) AS question_ratio, cite_score FROM cite
""", "cite")
def c12(t: Tables):
    return sc.citability(articles(t)).select(
        "post_id", "first_person", "stats_mentions", "definitions", "ol_items", F.round("data_density", 6).alias("data_density"),
        F.round("question_ratio", 6).alias("question_ratio"), "cite_score",
    )


def trusted(t: Tables, *fields: str):
    p = articles(t).withColumn("opening", hx.opening_text(F.col("body_html"), 3000))
    return p.withColumn("trust", ex.trust_metadata(F.col("body_html"), *fields, opening=F.col("opening")))


def ai_scored(t: Tables):
    p = trusted(t, "author_name", "has_visible_date", "has_contact_link")
    return sc.ai_scores(p.select("post_id", "site_id", "body_text", "body_html", "opening", "headings", "trust", "word_count", "publish_date", "modified_date"), AS_OF)


cte("medians", "SELECT site_id, list_sort(list(word_count))[len(list(word_count)) // 2 + 1] AS site_median FROM posts GROUP BY site_id", "posts")
cte("eeat", f"""
SELECT *, least(100, CASE WHEN word_count > 0 AND word_count < 300 THEN least(raw, 50) ELSE raw END)::DOUBLE AS eeat_score FROM (
SELECT *, CASE WHEN author_found THEN 15 ELSE 0 END + CASE WHEN bio THEN 20 ELSE 0 END
  + CASE WHEN NOT has_date THEN 0 WHEN age IS NULL THEN 5 WHEN age <= 180 THEN 15 WHEN age <= 365 THEN 10 WHEN age <= 730 THEN 5 ELSE 0 END
  + CASE WHEN external_links >= 21 THEN 15 WHEN external_links >= 11 THEN 13 WHEN external_links >= 6 THEN 10 WHEN external_links >= 3 THEN 7 WHEN external_links >= 1 THEN 3 ELSE 0 END
  + 10 + CASE WHEN site_median = 0 THEN 0 WHEN word_count / site_median >= 2 THEN 10 WHEN word_count / site_median >= 1.5 THEN 7 WHEN word_count / site_median >= 1 THEN 5 WHEN word_count / site_median >= 0.5 THEN 2 ELSE 0 END
  + CASE WHEN h2 >= 6 THEN 15 WHEN h2 >= 3 THEN 10 WHEN h2 >= 1 THEN 5 ELSE 0 END AS raw FROM (
SELECT a.post_id, a.site_id, word_count, site_median, a.post_id % 4 = 0 OR regexp_matches(left(v, 3000), '{sc.BYLINE}') AS author_found, a.post_id % 4 = 0 AS bio,
  has_visible_date OR regexp_matches(left(v, 3000), '{sc.SHOWN_DATE}') AS has_date, regexp_matches(left(v, 3000), '{sc.UPDATED_DATE}') AS has_updated_date,
  (a.post_id % 12)::INTEGER AS external_links, len(headings) AS h2, date_diff('day', coalesce(modified_date, publish_date), DATE '2024-01-31') AS age
FROM (SELECT *, {q.visible('body_html')} AS v FROM articles) a JOIN trust USING (post_id) JOIN medians m ON m.site_id = a.site_id))
""", "articles trust medians")


@query("c13_eeat", "SELECT post_id, author_found, has_date, has_updated_date, external_links, eeat_score FROM eeat", "eeat")
def c13(t: Tables):
    from .scale import upper_median

    med = upper_median(t.posts, ["site_id"], "word_count", "site_median")
    return sc.eeat(trusted(t).join(med, "site_id"), AS_OF).select("post_id", "author_found", "has_date", "has_updated_date", "external_links", "eeat_score")


cte("ldscore", "SELECT post_id, CASE post_id % 5 WHEN 0 THEN 30 + 30 + 4 / 5 * 30 WHEN 1 THEN 30 + 30 + 10 ELSE 0 END::DOUBLE AS schema_score, CASE post_id % 5 WHEN 0 THEN 'Article' WHEN 1 THEN 'FAQPage,WebPage,Thing' ELSE '' END AS schema_types FROM posts", "posts")


@query("c14_schema_markup", "SELECT post_id, schema_score, schema_types FROM ldscore", "ldscore")
def c14(t: Tables):
    return sc.schema_markup(articles(t)).select("post_id", "schema_score", F.array_join("schema_types", ",").alias("schema_types"))


cte("extr", f"""
WITH s AS (SELECT post_id, body_text, body_html, string_split(regexp_replace(body_html, '(?is)<h([23])[^>]*>(.*?)</h[23]>', chr(1) || '\\1\\2' || chr(2), 'g'), chr(1))[2:] AS parts FROM articles),
h AS (SELECT post_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM s),
x AS (SELECT post_id, i, left(part, 1) AS level, {q.inner("string_split(substring(part, 2), chr(2))[1]")} AS htext,
  CASE WHEN regexp_matches(part, '(?is)' || chr(2) || '.*?<p(?:\\s[^>]*)?>.*?</p>') THEN {q.inner("regexp_extract(part, '(?is)' || chr(2) || '.*?<p(?:\\s[^>]*)?>(.*?)</p>', 1)")} END AS p FROM h),
f AS (SELECT *, first_value(p IGNORE NULLS) OVER (PARTITION BY post_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np FROM x),
a AS (SELECT post_id, count(*) AS total_h2,
  count(*) FILTER ({q.words('np')} BETWEEN 15 AND 80 AND regexp_matches({q.plain('np')}, '{sc.SECTION_ANSWER}')) AS h2_with_answer,
  count(*) FILTER (regexp_matches(htext, '(?i)(frequently asked|FAQ|common questions)')) > 0 AS faq_heading,
  count(*) FILTER (level = '3' AND (htext LIKE '%?' OR regexp_matches(htext, '{sc.FAQ_QUESTION}')) AND np IS NOT NULL AND {q.words('np')} <= 150) AS faq_pairs,
  count(*) FILTER (level = '2') AS h2n,
  count(*) FILTER (level = '2' AND lower(regexp_extract(np, '^(\\S+)', 1)) IN ('this','it','that','these','those','they','he','she')) AS pron FROM f GROUP BY post_id),
b AS (SELECT post_id, regexp_matches(f100, '{sc.OPENING}') OR regexp_matches(f100, '(?m){sc.DEFINITION}') AS direct_opening, {q.n(q.plain('body_text'), '(?m)' + sc.DEFINITION)} AS definition_count,
  {q.n('body_html', '(?i)<li[\\s>]')} AS list_items,
  len(list_filter(list_transform(regexp_extract_all(body_html, '(?is)<p(?:\\s[^>]*)?>(.*?)</p>', 1), lambda x: {q.inner('x')}), lambda x: {q.words('x')} BETWEEN 10 AND 40 AND regexp_matches(x, '\\d') AND regexp_matches({q.plain('x')}, '{sc.CLAIM}'))) AS quotable,
  CASE WHEN post_id % 3 = 0 THEN 1 ELSE 0 END AS extractable_tables
  FROM (SELECT *, array_to_string(regexp_extract_all({q.plain('body_text')}, '\\S+')[1:100], ' ') AS f100 FROM s)),
c AS (SELECT *, faq_heading OR faq_pairs >= 3 AS has_faq_section, CASE WHEN h2n < 2 THEN 0.5::DOUBLE ELSE 1 - pron / h2n END AS standalone_ratio FROM a JOIN b USING (post_id))
SELECT *, least(100, CASE WHEN direct_opening THEN 25 ELSE 0 END + CASE WHEN h2_with_answer / greatest(total_h2, 1) >= 0.5 THEN 25 WHEN h2_with_answer / greatest(total_h2, 1) >= 0.25 THEN 12 ELSE 0 END
  + CASE WHEN definition_count >= 2 THEN 20 WHEN definition_count = 1 THEN 10 ELSE 0 END
  + CASE WHEN has_faq_section AND faq_pairs >= 3 THEN 20 WHEN has_faq_section OR faq_pairs >= 2 THEN 15 WHEN faq_pairs >= 1 THEN 5 ELSE 0 END
  + CASE WHEN standalone_ratio >= 0.8 THEN 10 WHEN standalone_ratio >= 0.5 THEN 5 ELSE 0 END + CASE WHEN list_items >= 5 THEN 10 WHEN list_items >= 2 THEN 5 ELSE 0 END
  + CASE WHEN quotable >= 3 THEN 10 WHEN quotable >= 1 THEN 5 ELSE 0 END + CASE WHEN extractable_tables >= 1 THEN 10 ELSE 0 END)::DOUBLE AS extraction_score FROM c
""", "articles")


@query("c15_extraction", """
SELECT post_id, total_h2::INTEGER AS total_h2, h2_with_answer::INTEGER AS h2_with_answer, faq_pairs::INTEGER AS faq_pairs, has_faq_section, direct_opening, quotable::INTEGER AS quotable,
  extractable_tables, round(standalone_ratio, 6) AS standalone_ratio, extraction_score FROM extr
""", "extr")
def c15(t: Tables):
    return sc.extraction(articles(t)).select(
        "post_id", "total_h2", "h2_with_answer", "faq_pairs", "has_faq_section", "direct_opening", "quotable", "extractable_tables",
        F.round("standalone_ratio", 6).alias("standalone_ratio"), "extraction_score",
    )


cte("ai", """
SELECT c.post_id, c.site_id, cite_score, eeat_score, schema_score, extraction_score, qr, dd, total_headers, answer_first, has_updated_date, has_faq_section, faq_pairs, site_median
FROM cite c JOIN eeat USING (post_id) JOIN ldscore USING (post_id) JOIN extr USING (post_id)
""", "cite eeat ldscore extr")


@query("c16_ai_scores", "SELECT post_id, site_id, site_median, cite_score, eeat_score, schema_score, extraction_score FROM ai", "ai")
def c16(t: Tables):
    return ai_scored(t).select("post_id", "site_id", "site_median", "cite_score", "eeat_score", "schema_score", "extraction_score")


@query("c17_ai_summary", """
SELECT cluster_id, count(ai_citability_score) AS total_scored, round(avg(ai_citability_score), 1) AS avg_citability, round(avg(eeat_score), 1) AS avg_eeat,
  round(avg(schema_score), 1) AS avg_schema, round(avg(extraction_score), 1) AS avg_extraction,
  round(count(*) FILTER (schema_score > 0) / count(*) * 100, 1) AS pct_has_schema,
  round(count(*) FILTER (ai_citability_score >= 60) / nullif(count(ai_citability_score), 0) * 100, 1) AS pct_ai_ready FROM scores GROUP BY cluster_id
""", "scores")
def c17(t: Tables):
    return sc.ai_summary(t.scores, ["cluster_id"])


@query("c18_ai_readiness", """
SELECT post_id, round(coalesce(list_avg(list_filter([ai_citability_score, eeat_score, CASE WHEN post_id % 63 <> 0 THEN schema_score END], lambda x: x IS NOT NULL)), 40.0), 6) AS ai_readiness FROM scores
""", "scores")
def c18(t: Tables):
    schema = F.when(F.col("post_id") % 63 != 0, F.col("schema_score"))
    return t.scores.select("post_id", F.round(sc.ai_readiness(F.col("ai_citability_score"), F.col("eeat_score"), schema), 6).alias("ai_readiness"))


@query("c19_ai_problems", """
SELECT post_id, r.t AS problem_type, r.s AS severity, round(r.v, 6) AS value FROM (SELECT post_id, unnest([
  CASE WHEN cite_score < 40 THEN {'t': 'low_ai_citability', 's': CASE WHEN cite_score < 20 THEN 'high' ELSE 'medium' END, 'v': cite_score} END,
  CASE WHEN eeat_score < 40 THEN {'t': 'weak_eeat', 's': CASE WHEN eeat_score < 20 THEN 'high' ELSE 'medium' END, 'v': eeat_score} END,
  CASE WHEN schema_score < 30 THEN {'t': 'missing_schema', 's': 'medium', 'v': schema_score} END,
  CASE WHEN extraction_score < 40 THEN {'t': 'poor_ai_structure', 's': 'medium', 'v': extraction_score} END,
  CASE WHEN NOT has_faq_section THEN {'t': 'geo_no_faq_section', 's': 'medium', 'v': NULL::DOUBLE} END,
  CASE WHEN total_headers = 0 OR (round_even(qr, 2) < 0.3 AND total_headers >= 3) THEN {'t': 'geo_no_question_headers', 's': 'medium', 'v': round_even(qr, 2)} END,
  CASE WHEN round_even(dd, 2) < 0.5 THEN {'t': 'geo_low_data_density', 's': 'medium', 'v': round_even(dd, 2)} END,
  CASE WHEN NOT answer_first THEN {'t': 'geo_no_answer_first', 's': 'medium', 'v': NULL::DOUBLE} END,
  CASE WHEN has_faq_section THEN {'t': 'geo_missing_faq_schema', 's': 'high', 'v': NULL::DOUBLE} END,
  CASE WHEN NOT has_updated_date THEN {'t': 'geo_no_updated_date', 's': 'low', 'v': NULL::DOUBLE} END]) AS r FROM ai) WHERE r IS NOT NULL
""", "ai")
def c19(t: Tables):
    return sc.ai_problems(ai_scored(t)).withColumn("value", F.round("value", 6))


def _hints(words):
    return " + ".join(f"coalesce(max(contains(lower(title), '{w}')::INT), 0)" for w in words)


@query("c20_industry", f"""
SELECT site_id, CASE WHEN greatest(a, b, c, d) = 0 THEN 'default' WHEN a >= greatest(b, c, d) THEN 'saas' WHEN b >= greatest(c, d) THEN 'ecommerce' WHEN c >= d THEN 'media' ELSE 'agency' END AS industry
FROM (SELECT site_id, {', '.join(_hints(w) + ' AS ' + n for n, w in zip('abcd', sc.INDUSTRY_HINTS.values()))} FROM titled GROUP BY site_id)
""", "titled")
def c20(t: Tables):
    return sc.detect_industry(titled(t), ["site_id"])


def pct_sql(x: str, v: list) -> str:
    v = [float(a) for a in v]
    mid = " ".join(
        f"WHEN {x} <= {v[i + 1]} THEN {p} + ({x} - {v[i]}) / greatest({v[i + 1] - v[i]}, 1.0) * {d}"
        for i, (p, d) in enumerate([(10, 15), (25, 25), (50, 25), (75, 15)])
    )
    return f"trunc(CASE WHEN {x} <= {v[0]} THEN 10 * {x} / greatest({v[0]}, 1.0) WHEN {x} >= {v[4]} THEN least(99, 90 + floor(10 * ({x} - {v[4]}) / greatest({v[4]}, 1.0))) {mid} END::DOUBLE)::INTEGER"


@query("c21_percentile", f"SELECT p_partkey, {pct_sql('p_retailprice', sc.BENCHMARKS['media']['word_count'])} AS pct FROM part")
def c21(t: Tables):
    return t.raw("part").select("p_partkey", sc.percentile_of(F.col("p_retailprice"), sc.BENCHMARKS["media"]["word_count"]).alias("pct"))


_B = sc.BENCHMARKS
IND = "['saas','ecommerce','media','agency','default'][post_id % 5 + 1]"


def _bench_sql(metric: str, x: str) -> str:
    return "CASE industry " + " ".join(f"WHEN '{n}' THEN {pct_sql(x, _B[n][metric])}" for n in _B) + " END"


@query("c22_benchmarks", f"""
WITH m AS (SELECT r.post_id, {IND.replace('post_id', 'r.post_id')} AS industry, word_count::DOUBLE AS wc, fre, composite_score AS hs, coalesce(n, 0)::DOUBLE AS ln
  FROM readable r JOIN posts USING (post_id) JOIN scores USING (post_id) LEFT JOIN (SELECT source_post_id AS post_id, count(*) AS n FROM links GROUP BY 1) USING (post_id)),
a AS (SELECT -1 - row_number() OVER (ORDER BY industry) AS post_id, industry, avg(wc) AS wc, avg(fre) AS fre, avg(hs) AS hs, avg(ln) AS ln FROM m GROUP BY industry),
u AS (SELECT post_id, industry, wc, fre, hs, ln FROM m UNION ALL SELECT NULL, industry, wc, fre, hs, ln FROM a)
SELECT post_id, industry, {_bench_sql('word_count', 'wc')} AS word_count_pct, {_bench_sql('flesch', 'fre')} AS flesch_pct, {_bench_sql('health_score', 'hs')} AS health_score_pct, {_bench_sql('internal_links', 'ln')} AS internal_links_pct FROM u
""", "readable posts scores links")
def c22(t: Tables):
    n = t.links.groupBy(F.col("source_post_id").alias("post_id")).agg(F.count("*").alias("ln"))
    m = (
        sc.readability(t.posts).join(t.scores.select("post_id", "composite_score"), "post_id").join(n, "post_id", "left")
        .select(
            "post_id",
            F.element_at(F.array(*map(F.lit, _B)), (F.col("post_id") % 5 + 1).cast("int")).alias("industry"),
            F.col("word_count").cast("double").alias("wc"), F.col("reading_ease").alias("fre"), F.col("composite_score").alias("hs"),
            F.coalesce("ln", F.lit(0)).cast("double").alias("ln"),
        )
    )
    site = m.groupBy("industry").agg(*[F.avg(c).alias(c) for c in ("wc", "fre", "hs", "ln")]).withColumn("post_id", F.lit(None).cast("long"))
    cols = {"word_count": "wc", "flesch": "fre", "health_score": "hs", "internal_links": "ln"}
    return sc.benchmark(m.unionByName(site), cols).drop("wc", "fre", "hs", "ln")


@query("c23_geo_averages", """
SELECT site_id, round(avg(round_even(dd, 2)), 1) AS avg_data_density, round(avg(round_even(qr, 2)), 2) AS avg_question_header_ratio,
  round(count(*) FILTER (has_faq_section) / count(*) * 100, 1) AS pct_has_faq FROM ai GROUP BY site_id
""", "ai")
def c23(t: Tables):
    return sc.geo_averages(ai_scored(t), ["site_id"])
