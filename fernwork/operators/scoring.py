"""Readability, intent, AI-readiness and benchmark scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as hx
from ..functions import text as tx
from ..functions.text import beginning as _beginning
from ..functions.text import ladder
from ..plans.scale import top_per_group, upper_median

# ---- readability ---------------------------------------------------------


def readability(df: DataFrame, text: str = "body_text") -> DataFrame:
    """Adds sentences, words, syllables, reading_ease and grade."""
    t = F.col(text)
    w, s, y = F.col("words"), F.col("sentences"), F.col("syllables")
    counted = df.withColumns(
        {"sentences": tx.sentence_count(t), "words": tx.plain_word_count(t), "syllables": tx.syllable_count(t)}
    )
    return counted.withColumns({"reading_ease": tx.flesch_reading_ease(w, s, y), "grade": tx.grade_level(w, s, y)})


def hard_paragraphs(df: DataFrame, key: str = "post_id", text: str = "body_text", keep: int = 3) -> DataFrame:
    """The hardest long paragraphs of each text (reading ease below 30)."""
    paras = F.filter(F.transform(F.split(text, "\n\n"), lambda p: tx.strip(p)), lambda p: F.length(p) > 50)
    rows = df.select(key, F.posexplode(paras).alias("index", "para"))
    hard = readability(rows, "para").filter((F.col("reading_ease") < 30) & (tx.word_count(F.col("para")) > 20))
    hard = hard.select(key, "index", tx.round_even(F.col("reading_ease"), 1).alias("flesch"), F.left("para", F.lit(100)).alias("preview"))
    return top_per_group(hard, [key], [F.asc("flesch"), F.asc("index")], keep)


def site_language(posts: DataFrame, sample: int = 5) -> DataFrame:
    """Language of a site when all but one of its first posts agree, else null."""
    first = top_per_group(posts.select("site_id", "post_id", "language"), ["site_id"], [F.asc("post_id")], sample)
    votes = first.groupBy("site_id", "language").agg(F.count("*").alias("n"), F.min("post_id").alias("_first"))
    best = votes.groupBy("site_id").agg(
        F.max_by(F.struct("language", "n"), F.struct("n", -F.col("_first"))).alias("_b"), F.sum("n").alias("_size")
    )
    return best.select(
        "site_id",
        F.when(F.col("_b.n") >= F.greatest(F.lit(1), F.col("_size") - 1), F.col("_b.language")).alias("site_lang"),
    )


def readability_job(posts: DataFrame) -> DataFrame:
    """Scores of English posts over 100 characters; the site vote overrides the post's own language."""
    long = posts.filter(F.length("body_text") > 100)
    lang = site_language(long)
    english = long.join(lang, "site_id", "left").filter(F.coalesce("site_lang", "language") == "en")
    return readability(english).select("post_id", "site_id", "reading_ease", "grade")


# ---- intent --------------------------------------------------------------

# fixed values: keyword patterns of each intent
NEGATION = r"(?i)\b(won't|don't|can't|shouldn't|isn't|aren't|not|never|stop|avoid|quit|hate|refuse|why i (won't|don't|didn't|can't))\s+"
TRANSACTIONAL = (
    r"(?i)\b(pricing|purchase|order|sign\s*up|free\s*trial|get\s*started|demo|request\s*a|start\s*free|subscribe|"
    r"checkout|add\s*to\s*cart|download\s*now|try\s*free|create\s*account)\b"
)
COMMERCIAL = (
    r"(?i)\b(vs\.?|versus|comparison|compare|alternative|rated|cheapest|affordable|pros?\s*(and|&)\s*cons?|"
    r"which\s*(is|should)|buyer.?s?\s*guide)\b"
)
NAVIGATIONAL = (
    r"(?i)\b(login|log\s*in|sign\s*in|dashboard|account|support|contact|help\s*center|docs|documentation|"
    r"api\s*reference|changelog|status\s*page|about\s*us|careers|press)\b"
)
TRANSACTIONAL_SLUG = r"(pricing|demo|trial|signup|get-started|plans)"
COMMERCIAL_SLUG = r"(^best-|^top-\d+-|vs-|-comparison|-alternative|-review$)"
NAVIGATIONAL_SLUG = r"^(?:login|signin|support|contact|docs|help|about|careers)(?:$|-)"
BUY_STORY = r"(?i)\b(?:people|customers?|them|makes?|helps?|gets?)\s+buy\b"
BUY_NOW = r"(?i)\bbuy\s+(?:now|today|this|here|the|our|my)\b"
# fixed values: query intent patterns in priority order
QUERY_INTENT = {
    "transactional": r"\b(buy|purchas(e|ing)|order|subscri(be|ption)|download|sign\s*up|register|free\s+trial|pric(e|ing)|discount|coupon|deal|cheap|affordable)\b",
    "commercial": r"\b(best|top\s+\d+|vs|versus|compar(e|ison)|review|alternativ(e|es)|pros\s+and\s+cons|worth\s+it|recommend)\b",
    "navigational": r"\b(login|sign\s*in|dashboard|account|(\.com|\.io|\.org)|official|website)\b",
}
# fixed values: strong keyword families
STRONG_WORDS = {
    "commercial": ["pricing", "cost", "demo", "alternative", "vs ", "review", "compare", "buy"],
    "informational": ["how to", "guide", "what is", "why ", "tips", "best practices", "tutorial"],
    "transactional": ["download", "template", "free trial", "sign up", "checklist", "worksheet"],
    "navigational": ["login", "contact", "about", "team", "careers", "sitemap"],
}


def negated_before(text: Column, keyword: str) -> Column:
    """A negation stands in the 50 characters before the keyword."""
    t = tx.straight_quotes(text)
    at = F.instr(F.lower(t), keyword)
    start = F.greatest(F.lit(1), at - 50)
    return F.when(at <= 1, F.lit(False)).otherwise(t.substr(start, at - start).rlike(NEGATION))


def content_intent(title: Column, url: Column) -> Column:
    slug = F.lower(F.substring_index(url, "/", -1))
    name = tx.straight_quotes(title)
    text = F.lower(F.concat(name, F.lit(" "), slug))
    head = F.lower(F.array_join(F.slice(tx.tokens(name), 1, 4), " "))
    buys = (
        text.rlike(r"\bbuy\b") & ~negated_before(name, "buy") & ~text.rlike(BUY_STORY)
        & (text.rlike(BUY_NOW) | F.contains(slug, F.lit("buy")))
    )
    return (
        F.when(slug.rlike(TRANSACTIONAL_SLUG), "transactional")
        .when(slug.rlike(COMMERCIAL_SLUG), "commercial")
        .when(slug.rlike(NAVIGATIONAL_SLUG), "navigational")
        .when(buys, "transactional")
        .when(text.rlike(TRANSACTIONAL), "transactional")
        .when(head.rlike(r"^(best|top\s*\d+|(\d+\s+)?best)"), "commercial")
        .when(text.rlike(r"\breview\b") & slug.endswith("-review"), "commercial")
        .when(text.rlike(r"\b(i|we)\s+recommend\b"), "commercial")
        .when(text.rlike(COMMERCIAL), "commercial")
        .when(text.rlike(NAVIGATIONAL), "navigational")
        .otherwise("informational")
    )


def query_intent(query: Column) -> Column:
    q = F.lower(F.trim(query))
    out = F
    for intent, pattern in QUERY_INTENT.items():
        out = out.when(q.rlike(pattern), intent)
    return out.otherwise("informational")


def intent_mismatch(posts: DataFrame, gsc: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Posts whose intent differs from that of most of their recent queries.

    Ties go to the intent of the alphabetically first query.
    """
    recent = gsc.filter(F.col("date") >= F.date_sub(F.lit(as_of).cast("date"), days)).select("post_id", "query").distinct()
    per = recent.groupBy("post_id", query_intent(F.col("query")).alias("intent")).agg(
        F.count("*").alias("n"), F.min("query").alias("q")
    )
    top = top_per_group(per, ["post_id"], [F.desc("n"), F.asc("q")], 1)
    return (
        posts.filter(F.col("content_intent").isNotNull())
        .join(top, "post_id")
        .filter(F.col("content_intent") != F.col("intent"))
        .select("post_id", "content_intent", F.col("intent").alias("query_intent"), F.lit("intent_mismatch").alias("problem_type"), F.lit("high").alias("severity"))
    )


def ambiguous_intent(title: Column, url: Column) -> Column:
    both = F.concat(F.lower(title), F.lit(" "), F.lower(url))
    families = None
    for needles in STRONG_WORDS.values():
        hit = tx.any_of(both, needles).cast("int")
        families = hit if families is None else families + hit
    return (families == 0) | (families >= 2)


def intent_counts(posts: DataFrame) -> DataFrame:
    return posts.groupBy("site_id", content_intent(F.col("title"), F.col("url")).alias("intent")).agg(F.count("*").alias("n"))


# ---- AI readiness --------------------------------------------------------

# fixed values: signal patterns
FIRST_PERSON = (
    r"(?i)\b(in our testing|when we (implemented|tested|tried|built|ran)|we found|we discovered|in my experience|i tested|i found|"
    r"our (data|results|analysis|research|study|tests) (show|reveal|found|indicate)|based on our|in practice|in real(-| )world|"
    r"our team|we've been|when i|after i|i've (been|used|tested|tried))\b"
)
STATS = (
    r"(?i)(\d+[\.,]?\d*\s*%|\d{4,}[\.,]?\d*\s*(users|companies|brands|sites|searches|queries|customers|people|respondents|participants)|"
    r"\d+\s*(out of|in)\s*\d+|(according to our|in our survey|our study|we surveyed|we analyzed|we collected|our data|proprietary data))"
)
DEFINITION = (
    r"^[A-Z][A-Za-z\s\-]{3,50}\b(is|are|refers to|means|can be defined as|describes)\s+"
    r"(?:a|an|the|when|how|any|one|not|essentially|basically|simply|generally|broadly)"
)
CITATION = (
    r"(?i)(according to|as reported by|cited by|published by|per |source:|from a (study|report|survey|research) by|data from|"
    r"\.gov|\.edu|journal|research|university|institute)"
)
ENTITY = r"(?:[A-Z][a-z]+\s){1,}[A-Z][a-z]+"
DATA_POINT = r"(?i)\d+[\.,]?\d*\s*%|\$\d+|\d{2,}[\.,]\d+|\d+\s*(million|billion|thousand|users|customers|companies)"
ANSWER = r"(?i)\b(is|are|means|refers to|the (best|most|key|main)|you (can|should|need)|here's|here is)\b"
ANSWER_FACT = r"(?i)\d|\b(is|are|means|refers to|can be defined as)\b"
OPENING = r"(?i)\b(is|are|means|refers to|helps you|allows you|enables)\b|\d"
QUESTION = r"(?i)^(what|how|why|when|where|which|who|can|does|is|are|should|will)\s"
FAQ_QUESTION = r"(?i)^(what|how|why|when|where|which|who|can|does|is|are|should)\s"
SECTION_ANSWER = r"(?i)\b(is|are|means|you can|you should|this|the best|use|start)\b"
CLAIM = r"(?i)\b(increase|decrease|reduce|improve|boost|grow|drop|rise|save|cost)\b"
CREDENTIALS = (
    r"(?i)\b(CEO|CTO|CMO|VP|director|manager|founder|co-founder|editor|journalist|author|consultant|analyst|engineer|developer|"
    r"researcher|scientist|professor|PhD|MSc|MBA|years of experience|years experience|previously at|worked at|former|ex-|advisor|"
    r"expert|specialist|head of)\b"
)
MONTH = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z.]*"
ANY_DATE = MONTH + r"\s+\d{1,2},?\s+\d{4}|\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4}|\d{4}[/\-]\d{1,2}[/\-]\d{1,2}"
SHOWN_DATE = rf"(?i)(?:{MONTH}\s+\d{{1,2}},?\s+\d{{4}}|(?:published|posted|updated|modified|last updated)\s*[:\s]*(?:{ANY_DATE}))"
UPDATED_DATE = rf"(?i)(?:last updated|updated on|modified|updated)\s*[:\s]*(?:{ANY_DATE})"
BYLINE = r"(?i)(?:written by|by|author[:\s]+|reviewed by|edited by)\s+([A-Z][a-z]+ [A-Z][a-z]+(?:\s[A-Z][a-z]+)?)"
SHARE_LINK = r"(facebook\.com|twitter\.com|linkedin\.com|pinterest\.com|x\.com)/(share|intent|sharer)"
# fixed values: structured-data types that AI systems reward, and article types
HIGH_VALUE_SCHEMA = ["Article", "NewsArticle", "BlogPosting", "FAQPage", "HowTo", "TechArticle", "Dataset", "Review"]
ARTICLE_TYPES = ["Article", "BlogPosting", "NewsArticle", "TechArticle"]
# fixed values: openings that lean on earlier text
PRONOUNS = ["this", "it", "that", "these", "those", "they", "he", "she"]


def _definitions(text: Column) -> Column:
    return tx.count_matches(text, "(?md)" + DEFINITION)  # d: only \n ends a line


def _entities(text: Column) -> Column:
    """Matches of ENTITY, in a form that takes a run of any length: its repeated group would need the stack at each word."""
    return tx.count_matches(text, r"[A-Z][a-z]++(?:\s[A-Z][a-z]++)++")


def citability(df: DataFrame) -> DataFrame:
    """Adds the citability signals and cite_score (0–100) from body_text and body_html."""
    text, html = F.coalesce("body_text", F.lit("")), F.coalesce("body_html", F.lit(""))
    lists = F.regexp_extract_all(html, F.lit(r"(?is)<ol[^>]*>.*?</ol>"), F.lit(0))
    heads = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)<h[23][^>]*>(.*?)</h[23]>"), F.lit(1)), lambda h: hx.inner_text(h)
    )
    first = F.array_join(tx.first_tokens(text, 200), " ")
    out = df.withColumns(
        {
            "data_tables": tx.count_matches(html, r"(?i)<table[\s>]"),
            "ol_items": F.aggregate(lists, F.lit(0), lambda a, x: a + F.regexp_count(x, F.lit(r"(?i)<li[\s>]"))),
            "first_person": tx.count_matches(text, _beginning("wiob", FIRST_PERSON)),
            "stats_mentions": tx.count_matches(text, _beginning(r"\daiowp", STATS)),
            "definitions": _definitions(text),
            "_entities": _entities(text),
            "_words": F.greatest(tx.word_count(text), F.lit(1)),
            "citations": tx.count_matches(text, _beginning("acpsfdjrui.", CITATION)),
            "total_headers": F.size(heads),
            "question_headers": F.size(F.filter(heads, lambda h: h.rlike(QUESTION))),
            "data_points": tx.count_matches(text, _beginning(r"\d$", DATA_POINT)),
            "answer_first": first.rlike(ANSWER) & first.rlike(ANSWER_FACT),
        }
    )
    out = out.withColumns(
        {
            "entity_density": F.col("_entities") / F.col("_words") * 1000,
            "question_ratio": F.col("question_headers") / F.greatest(F.col("total_headers"), F.lit(1)),
            "data_density": F.col("data_points") / F.col("_words") * 200,
        }
    )
    c = F.col
    score = (
        F.when(c("data_tables") >= 1, 20).otherwise(0)
        + ladder(c("ol_items"), [(3, 15), (1, 7)], 0)
        + ladder(c("first_person"), [(3, 20), (1, 10)], 0)
        + ladder(c("stats_mentions"), [(3, 20), (1, 10)], 0)
        + ladder(c("definitions"), [(2, 10), (1, 5)], 0)
        + ladder(c("entity_density"), [(15, 10), (8, 5)], 0)
        + ladder(c("citations"), [(2, 5)], 0)
        + ladder(c("question_ratio"), [(0.3, 15), (0.15, 7)], 0)
        + ladder(c("data_density"), [(1.0, 10), (0.5, 5)], 0)
        + F.when(c("answer_first"), 10).otherwise(0)
    )
    return out.withColumn("cite_score", F.least(score, F.lit(100)).cast("double")).drop("_entities", "_words")


def eeat(df: DataFrame, as_of: str) -> DataFrame:
    """Adds visible trust signals and eeat_score (0–100)."""
    return eeat_score(trust_signals(df), as_of)


def trust_signals(df: DataFrame) -> DataFrame:
    """Adds the trust signals that the page shows.

    Needs body_html, headings and the crawl-time ``trust`` struct; an
    ``opening`` (``opening_text`` of the first 3000 characters) is taken as it is.
    """
    html, trust = F.coalesce("body_html", F.lit("")), F.col("trust")
    tag = r"(?is)<[a-z][a-z0-9]*[^>]*\s(?:class|id)\s*=\s*[\"'][^\"']*(?:author|bio|writer|contributor)[^\"']*[\"'][^>]*>"
    bio = hx.visible_text(F.regexp_extract(html, tag + r"(.*?)</(?:div|section|aside|article|p|span|footer|header)>", 1))
    author_link = html.rlike(r"(?is)<a[^>]*href\s*=\s*[\"'][^\"']*/authors?/[^/\"']+")
    text = F.coalesce("opening", F.lit("")) if "opening" in df.columns else hx.opening_text(html, 3000)
    marked_author = (
        html.rlike(r"(?is)<meta[^>]*name\s*=\s*[\"']author[\"'][^>]*content\s*=\s*[\"'][^\"']+")
        | html.rlike(r"(?is)<[a-z][a-z0-9]*[^>]*\s(?:itemprop|rel)\s*=\s*[\"']author[\"']")
        | html.rlike(r"(?is)<[a-z][a-z0-9]*[^>]*\sclass\s*=\s*[\"'][^\"']*(?:author|byline)")
    )
    links = F.transform(hx.anchors(html), lambda a: F.lower(a["href"]))
    times = html.rlike(r"(?is)<time[^>]*\sdatetime\s*=")
    out = df.withColumn("_text", text).withColumns(
        {
            "author_found": F.coalesce(trust["author_name"], F.lit("")).rlike(r"\S") | marked_author | author_link
            | F.left("_text", F.lit(3000)).rlike(BYLINE),
            "_bio": bio,
        }
    )
    out = out.withColumns(
        {
            "has_author_bio": (F.col("_bio") != "") | (F.col("author_found") & author_link),
            "has_credentials": F.when(
                F.col("_bio").rlike(CREDENTIALS), F.lit(True)
            ).otherwise((F.coalesce(trust["author_name"], F.lit("")) != "") & F.left("_text", F.lit(800)).rlike(CREDENTIALS)),
            "has_date": times | F.left("_text", F.lit(3000)).rlike(_beginning("jfmasondpul", SHOWN_DATE)) | F.coalesce(trust["has_visible_date"], F.lit(False)),
            "has_updated_date": F.left("_text", F.lit(3000)).rlike(_beginning("lum", UPDATED_DATE))
            | html.rlike(r"(?is)(updated|modified)[^<]{0,40}<time[^>]*\sdatetime\s*="),
            "external_links": F.size(F.filter(links, lambda a: a.rlike("^https?://") & ~a.rlike(SHARE_LINK))),
            "has_contact_link": F.coalesce(trust["has_contact_link"], F.lit(False)),
            "h2_total": F.size(F.filter("headings", lambda h: h["level"] == "h2")),
        }
    )
    return out.drop("_text", "_bio", "opening")


def eeat_score(df: DataFrame, as_of: str) -> DataFrame:
    """Adds word_ratio and eeat_score to rows of ``trust_signals`` with word_count, site_median, publish_date, modified_date."""
    out = df.withColumn("word_ratio", F.when(F.col("site_median") > 0, F.col("word_count") / F.col("site_median")))
    c = F.col
    age = F.date_diff(F.lit(as_of).cast("date"), F.to_date(F.coalesce("modified_date", "publish_date")))
    fresh = (
        F.when(~c("has_date"), 0)
        .when(age.isNull(), 5)
        .when(age <= 180, 15).when(age <= 365, 10).when(age <= 730, 5).otherwise(0)
    )
    score = (
        F.when(c("author_found"), 15).otherwise(0)
        + F.when(c("has_author_bio"), 10).otherwise(0)
        + F.when(c("has_credentials"), 10).otherwise(0)
        + fresh
        + ladder(c("external_links"), [(21, 15), (11, 13), (6, 10), (3, 7), (1, 3)], 0)
        + F.when(c("has_contact_link"), 10).otherwise(0)
        + F.coalesce(ladder(c("word_ratio"), [(2.0, 10), (1.5, 7), (1.0, 5), (0.5, 2)], 0), F.lit(0))
        + ladder(c("h2_total"), [(6, 15), (3, 10), (1, 5)], 0)
    )
    thin = (c("word_count") > 0) & (c("word_count") < 300)
    capped = F.when(thin, F.least(score, F.lit(50))).otherwise(score)
    return out.withColumn("eeat_score", F.least(capped, F.lit(100)).cast("double"))


_LD_SCHEMA = "array<struct<`@type`:string,headline:string,datePublished:string,author:string,image:string,dateModified:string>>"


def schema_markup(df: DataFrame) -> DataFrame:
    """Adds schema_types and schema_score (0–100) from JSON-LD blocks."""
    html = F.coalesce("body_html", F.lit(""))
    blocks = F.regexp_extract_all(
        html, F.lit(r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1)
    )
    items = F.flatten(
        F.transform(blocks, lambda b: F.coalesce(F.from_json(b, _LD_SCHEMA), F.array().cast(_LD_SCHEMA)))
    )
    kinds = F.flatten(
        F.transform(
            F.filter("_items", lambda i: i["@type"].isNotNull()),
            lambda i: F.when(i["@type"].startswith("["), F.from_json(i["@type"], "array<string>")).otherwise(F.array(i["@type"])),
        )
    )
    filled = lambda v: (~F.coalesce(v, F.lit("")).isin("", "{}", "[]", "false", "0")).cast("int")
    article = F.try_element_at(F.filter("_items", lambda i: i["@type"].isin(ARTICLE_TYPES)), F.lit(-1))
    complete = sum(
        (filled(article[f]) for f in ("headline", "datePublished", "author", "image", "dateModified")), F.lit(0)
    )
    out = df.withColumn("_blocks", F.size(blocks)).withColumn("_items", items).withColumn("schema_types", kinds)
    score = (
        F.lit(30)
        + F.when(F.arrays_overlap("schema_types", F.array(*map(F.lit, HIGH_VALUE_SCHEMA))), 30).otherwise(0)
        + F.when(article.isNotNull(), complete / 5 * 30).otherwise(0)
        + F.when(F.size(F.array_distinct("schema_types")) >= 2, 10).otherwise(0)
    )
    scored = F.when(F.col("_blocks") == 0, F.lit(0.0)).otherwise(F.bround(F.least(score, F.lit(100)), 0).cast("double"))
    return out.withColumn("schema_score", scored).drop("_items", "_blocks")


def extraction(df: DataFrame) -> DataFrame:
    """Adds answer-structure signals and extraction_score (0–100).

    The page is cut at h2/h3; the paragraph that follows a heading is the
    first <p> in its own part or in a later one.
    """
    text, html = F.coalesce("body_text", F.lit("")), F.coalesce("body_html", F.lit(""))
    marked = F.regexp_replace(html, r"(?is)<h([23])[^>]*>(.*?)</h[23]>", "\u0001$1$2\u0002")
    parts = F.slice(F.split(marked, "\u0001"), F.lit(2), F.lit(1_000_000))
    heads = F.transform(
        parts,
        lambda p: F.struct(
            F.left(p, F.lit(1)).alias("level"),
            hx.inner_text(F.substring_index(p.substr(F.lit(2), F.length(p)), "\u0002", 1)).alias("text"),
            F.when(
                p.rlike(r"(?is)\u0002.*?<p(?:\s[^>]*)?>.*?</p>"),
                hx.inner_text(F.regexp_extract(p, r"(?is)\u0002.*?<p(?:\s[^>]*)?>(.*?)</p>", 1)),
            ).alias("p"),
        ),
    )
    followed = tx.let(
        heads,
        lambda hs: F.transform(
            hs,
            lambda h, i: F.struct(
                h["level"].alias("level"), h["text"].alias("text"),
                F.coalesce(
                    h["p"],
                    F.try_element_at(F.filter(F.slice(hs, i + 1, F.size(hs)), lambda x: x["p"].isNotNull()), F.lit(1))["p"],
                ).alias("p"),
            ),
        ),
    )
    first = F.array_join(tx.first_tokens(text, 100), " ")
    paras = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1)), lambda p: hx.inner_text(p)
    )
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>.*?</table>"), F.lit(0))
    c = F.col
    out = df.withColumn("_h", followed)
    out = out.withColumns(
        {
            "direct_opening": first.rlike(OPENING) | first.rlike("(?md)" + DEFINITION),
            "total_h2": F.size("_h"),
            "h2_with_answer": F.size(
                F.filter("_h", lambda h: tx.word_count(h["p"]).between(15, 80) & h["p"].rlike(SECTION_ANSWER))
            ),
            "definition_count": _definitions(text),
            "faq_heading": F.exists("_h", lambda h: h["text"].rlike(r"(?i)(frequently asked|FAQ|common questions)")),
            "faq_pairs": F.size(
                F.filter(
                    "_h",
                    lambda h: (h["level"] == "3") & (h["text"].endswith("?") | h["text"].rlike(FAQ_QUESTION))
                    & h["p"].isNotNull() & (tx.word_count(h["p"]) <= 150),
                )
            ),
            "_h2": F.size(F.filter("_h", lambda h: h["level"] == "2")),
            "_pronouns": F.size(
                F.filter("_h", lambda h: (h["level"] == "2") & F.lower(F.regexp_extract(h["p"], r"^(\S+)", 1)).isin(PRONOUNS))
            ),
            "list_items": tx.count_matches(html, r"(?i)<li[\s>]"),
            "quotable": F.size(
                F.filter(paras, lambda p: tx.word_count(p).between(10, 40) & p.rlike(r"\d") & p.rlike(CLAIM))
            ),
            "extractable_tables": F.size(
                F.filter(
                    tables,
                    lambda t: (F.regexp_count(t, F.lit(r"(?i)<tr[\s>]")) >= 3) & (F.regexp_count(t, F.lit(r"(?i)<th[\s>]")) >= 2),
                )
            ),
        }
    )
    out = out.withColumns(
        {
            "has_faq_section": c("faq_heading") | (c("faq_pairs") >= 3),
            "standalone_ratio": F.when(c("_h2") < 2, F.lit(0.5)).otherwise(1 - c("_pronouns") / c("_h2")),
        }
    )
    score = (
        F.when(c("direct_opening"), 25).otherwise(0)
        + ladder(c("h2_with_answer") / F.greatest(c("total_h2"), F.lit(1)), [(0.5, 25), (0.25, 12)], 0)
        + ladder(c("definition_count"), [(2, 20), (1, 10)], 0)
        + F.when(c("has_faq_section") & (c("faq_pairs") >= 3), 20)
        .when(c("has_faq_section") | (c("faq_pairs") >= 2), 15)
        .when(c("faq_pairs") >= 1, 5).otherwise(0)
        + ladder(c("standalone_ratio"), [(0.8, 10), (0.5, 5)], 0)
        + ladder(c("list_items"), [(5, 10), (2, 5)], 0)
        + ladder(c("quotable"), [(3, 10), (1, 5)], 0)
        + F.when(c("extractable_tables") >= 1, 10).otherwise(0)
    )
    return out.withColumn("extraction_score", F.least(score, F.lit(100)).cast("double")).drop("_h", "_h2", "_pronouns", "faq_heading")


def ai_scores(posts: DataFrame, as_of: str) -> DataFrame:
    """All four AI-readiness scores per post, with the site's upper-middle word count.

    Everything that needs the text is counted first; the site's median meets
    rows without text or markup.
    """
    med = upper_median(posts.select("site_id", F.coalesce("word_count", F.lit(0)).alias("w")), ["site_id"], "w", "site_median")
    base = posts.filter(F.col("body_text").isNotNull())
    scored = extraction(schema_markup(trust_signals(citability(base))))
    narrow = scored.drop("body_text", "body_html", "headings", "trust")
    return eeat_score(narrow.join(med, "site_id"), as_of)


def ai_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Score averages, share with structured data and share citable (≥ 60)."""
    pct = lambda n, d: F.round(F.try_divide(n, d) * 100, 1)
    cite = F.col("ai_citability_score")
    avg1 = lambda c: F.round(F.avg(c), 1)
    return scores.groupBy(*keys).agg(
        F.count(cite).alias("total_scored"),
        avg1(cite).alias("avg_citability"), avg1("eeat_score").alias("avg_eeat"),
        avg1("schema_score").alias("avg_schema"), avg1("extraction_score").alias("avg_extraction"),
        pct(F.count_if(F.col("schema_score") > 0), F.count("*")).alias("pct_has_schema"),
        pct(F.count_if(cite >= 60), F.count(cite)).alias("pct_ai_ready"),
    )


def ai_readiness(*scores: Column, default: float = 40.0) -> Column:
    """Mean of the scores that exist."""
    have = F.filter(F.array(*scores), lambda x: x.isNotNull())
    total = F.aggregate(have, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(total, F.size(have)), F.lit(default))


def ai_problems(scored: DataFrame) -> DataFrame:
    """Up to ten AI/GEO problem rows per scored post."""
    c = F.col
    low = lambda s: F.when(s < 20, "high").otherwise("medium")

    def rule(when: Column, kind: str, severity: Column, value: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("problem_type"), severity.alias("severity"), value.cast("double").alias("value")))

    m, one = F.lit("medium"), F.lit(None)
    rules = F.array(
        rule(c("cite_score") < 40, "low_ai_citability", low(c("cite_score")), c("cite_score")),
        rule(c("eeat_score") < 40, "weak_eeat", low(c("eeat_score")), c("eeat_score")),
        rule(c("schema_score") < 30, "missing_schema", m, c("schema_score")),
        rule(c("extraction_score") < 40, "poor_ai_structure", m, c("extraction_score")),
        rule(~c("has_faq_section"), "geo_no_faq_section", m, one),
        rule(
            (c("total_headers") == 0) | ((tx.round_even(F.col("question_ratio"), 2) < 0.3) & (c("total_headers") >= 3)),
            "geo_no_question_headers", m, tx.round_even(F.col("question_ratio"), 2),
        ),
        rule(tx.round_even(F.col("data_density"), 2) < 0.5, "geo_low_data_density", m, tx.round_even(F.col("data_density"), 2)),
        rule(~c("answer_first"), "geo_no_answer_first", m, one),
        # raised for every FAQ section, whether or not FAQPage markup is present
        rule(c("has_faq_section"), "geo_missing_faq_schema", F.lit("high"), one),
        rule(~c("has_updated_date"), "geo_no_updated_date", F.lit("low"), one),
    )
    return scored.select("post_id", F.inline(F.filter(rules, lambda r: r.isNotNull())))


def geo_averages(scored: DataFrame, keys: list[str]) -> DataFrame:
    return scored.groupBy(*keys).agg(
        F.round(F.avg(tx.round_even(F.col("data_density"), 2)), 1).alias("avg_data_density"),
        F.round(F.avg(tx.round_even(F.col("question_ratio"), 2)), 2).alias("avg_question_header_ratio"),
        F.round(F.try_divide(F.count_if("has_faq_section"), F.count("*")) * 100, 1).alias("pct_has_faq"),
    )


# ---- benchmarks ----------------------------------------------------------

# fixed values: p10, p25, p50, p75, p90 per industry and metric
BENCHMARKS = {
    "saas": {"word_count": [400, 800, 1400, 2200, 3500], "flesch": [25, 35, 48, 60, 70],
             "health_score": [15, 30, 50, 68, 82], "internal_links": [0, 2, 5, 10, 18]},
    "ecommerce": {"word_count": [300, 600, 1000, 1600, 2500], "flesch": [30, 40, 55, 65, 75],
                  "health_score": [12, 25, 45, 62, 78], "internal_links": [0, 3, 7, 15, 25]},
    "media": {"word_count": [300, 500, 900, 1500, 2200], "flesch": [35, 45, 58, 68, 78],
              "health_score": [10, 22, 42, 60, 75], "internal_links": [1, 4, 8, 14, 22]},
    "agency": {"word_count": [500, 900, 1500, 2400, 3800], "flesch": [20, 30, 42, 55, 65],
               "health_score": [12, 28, 48, 65, 80], "internal_links": [0, 2, 5, 10, 16]},
    "default": {"word_count": [350, 700, 1200, 2000, 3000], "flesch": [28, 38, 50, 62, 72],
                "health_score": [12, 26, 46, 63, 78], "internal_links": [0, 2, 5, 10, 18]},
}
# fixed values: words that hint at an industry
INDUSTRY_HINTS = {
    "saas": ["saas", "software", "crm", "erp", "api", "platform", "subscription", "onboarding", "churn", "mrr", "arr", "b2b",
             "pipeline", "demo"],
    "ecommerce": ["ecommerce", "e-commerce", "shopify", "woocommerce", "product", "cart", "checkout", "shipping", "inventory",
                  "marketplace"],
    "media": ["news", "journalism", "editorial", "magazine", "publisher", "content studio", "newsletter", "subscriber"],
    "agency": ["agency", "client", "freelance", "consulting", "marketing agency", "digital agency", "retainer", "seo",
               "content marketing", "copywriting", "digital marketing", "email marketing", "blogging", "content strategy"],
}


def detect_industry(titles: DataFrame, keys: list[str], title: str = "title") -> DataFrame:
    """Industry with the most distinct hint words over a site's titles and labels.

    Each word is one boolean aggregate, so no titles are gathered.
    """
    low = F.lower(F.col(title))
    flags = {
        f"{name}_{i}": F.max(F.contains(low, F.lit(word)).cast("int"))
        for name, words in INDUSTRY_HINTS.items() for i, word in enumerate(words)
    }
    hit = titles.groupBy(*keys).agg(*[v.alias(k) for k, v in flags.items()])
    totals = [
        F.struct(sum((F.coalesce(F.col(f"{n}_{i}"), F.lit(0)) for i in range(len(w))), F.lit(0)).alias("n"), F.lit(-pos).alias("o"), F.lit(n).alias("name"))
        for pos, (n, w) in enumerate(INDUSTRY_HINTS.items())
    ]
    best = F.array_max(F.array(*totals))
    return hit.select(*keys, F.when(best["n"] == 0, "default").otherwise(best["name"]).alias("industry"))


def percentile_of(value: Column, bench: list[float] | Column) -> Column:
    """Truncated piecewise-linear percentile (0–99) in a p10 … p90 table."""
    pcts = [10, 25, 50, 75, 90]
    v = [F.lit(float(b)) for b in bench] if isinstance(bench, list) else [bench[i] for i in range(5)]
    x = value.cast("double")
    out = F.when(x <= v[0], 10 * x / F.greatest(v[0], F.lit(1.0)))
    out = out.when(x >= v[4], F.least(F.lit(99.0), 90 + F.floor(10 * (x - v[4]) / F.greatest(v[4], F.lit(1.0)))))
    for i in range(4):
        ratio = (x - v[i]) / F.greatest(v[i + 1] - v[i], F.lit(1.0))
        out = out.when(x <= v[i + 1], pcts[i] + ratio * (pcts[i + 1] - pcts[i]))
    return out.cast("int")


def benchmark(df: DataFrame, metrics: dict[str, str], industry: str = "industry") -> DataFrame:
    """Percentile columns for word_count, flesch, health_score and internal_links."""
    def table(metric: str) -> Column:
        pick = None
        for name, rows in BENCHMARKS.items():
            arr = F.array(*[F.lit(float(b)) for b in rows[metric]])
            pick = (F if pick is None else pick).when(F.col(industry) == name, arr)
        return pick.otherwise(F.array(*[F.lit(float(b)) for b in BENCHMARKS["default"][metric]]))

    return df.withColumns({f"{m}_pct": percentile_of(F.col(c), table(m)) for m, c in metrics.items()})
