"""TF-IDF cluster labels from titles, headings and body text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans.scale import durable, top_per_group

# fixed values: words that carry no topic
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "shall", "can", "this", "that", "these",
    "those", "it", "its", "you", "your", "we", "our", "they", "their", "how", "what", "when", "where", "why", "which", "who", "more", "most", "very",
    "just", "also", "than", "then", "about", "into", "through", "during", "before", "after", "above", "below", "between", "each", "every", "all",
    "both", "few", "some", "any", "other", "new", "one", "two", "first", "last", "many", "much", "get", "got", "use", "make", "like", "need", "want",
    "know", "think", "come", "take", "see", "look", "find", "give", "tell", "work", "way", "even", "well", "back", "only", "still", "here", "there",
    "not", "no", "so", "up", "out", "if", "my", "me", "him", "her", "them", "us", "she", "he", "as", "his", "whom", "whose", "thee", "thou", "thy",
    "whereby", "thereof", "whether", "whereas", "hence", "thus", "therefore", "really", "actually", "literally", "basically", "simply", "always",
    "never", "because", "since", "until", "unless", "although", "though", "while", "often", "sometimes", "usually", "already", "enough", "almost",
    "quite", "rather", "perhaps", "maybe", "sure", "thing", "things", "stuff", "kind", "type", "lot", "lots", "said", "says", "went", "going",
    "done", "doing", "let", "lets", "put", "puts", "set", "run", "say", "true", "real", "right", "wrong", "big", "old",
]
# fixed values: words that describe the kind of article
FORMAT_WORDS = [
    "definitive", "complete", "ultimate", "comprehensive", "step", "guide", "beginner", "beginners", "advanced", "simple", "easy", "quick", "proven",
    "essential", "actionable", "powerful", "effective", "practical", "updated", "review", "checklist", "template", "templates", "roundup", "list",
    "resource", "resources", "tutorial", "overview", "introduction", "explained", "basics", "fundamental", "fundamentals", "key", "important",
    "incredible", "awesome", "ways", "tips", "tricks", "hacks", "secrets", "examples", "report", "study", "case", "results", "here", "what",
    "learned", "better", "tried", "worth", "good", "tested", "comparison", "top", "bottom", "worst", "biggest", "greatest", "number", "reasons",
    "steps", "mistake", "mistakes", "common", "remix", "remixed", "remixes", "rewrite", "revisited",
]
# fixed values: words of page chrome
UI_WORDS = [
    "tweet", "share", "pin", "facebook", "twitter", "linkedin", "pinterest", "instagram", "reddit", "email", "print", "copy", "link", "subscribe",
    "comment", "comments", "reply", "cancel", "submit", "search", "menu", "close", "open", "toggle", "click", "next", "previous", "prev", "read",
    "reading", "min", "ago", "posted", "author", "written", "category", "categories", "tag", "tags", "related", "popular", "recent", "sidebar",
    "footer", "header", "nav", "navigation", "cookie", "cookies", "privacy", "policy", "terms", "login", "signup", "register", "password", "account",
    "profile", "settings", "loading", "advertisement", "sponsored", "affiliate", "disclosure", "class", "swp", "div", "span", "href", "src", "alt",
    "img", "width", "height", "style", "script", "https", "http", "www", "com", "org", "net", "php", "jpg", "png", "gif", "wordpress", "theme",
    "plugin", "widget", "shortcode", "rdf", "xml", "json", "api", "schema", "xmlns", "meta", "viewport", "charset", "utf", "doctype", "don", "didn",
    "doesn", "isn", "wasn", "aren", "won", "wouldn", "couldn", "shouldn", "hasn", "hadn", "haven", "mustn", "needn",
]
# fixed values: phrases that mark the article format
FORMAT_PHRASES = [
    "the definitive guide", "a complete guide", "the complete guide", "the ultimate guide", "a comprehensive guide", "a beginner's guide",
    "the beginner's guide", "step by step guide", "step-by-step guide", "a step-by-step guide", "comprehensive checklist", "quick guide",
    "an in-depth guide", "in depth guide", "the complete beginner's guide", "everything you need to know",
]
# fixed values: words written in capitals
ACRONYMS = [
    "seo", "sem", "ppc", "cta", "roi", "b2b", "b2c", "saas", "api", "html", "css", "cro", "kpi", "url", "cpc", "cpm", "ctr", "serp", "eeat", "llm",
    "ux", "ui", "smm", "pr", "roas", "lp",
]
# fixed values: word pairs that need no connector
COMPOUNDS = [
    "link building", "email marketing", "content marketing", "content strategy", "social media", "keyword research", "search engine",
    "landing page", "lead generation", "affiliate marketing", "influencer marketing", "conversion rate", "pay per", "per click",
    "organic traffic", "guest posting", "digital marketing", "technical seo", "local seo", "video marketing", "brand awareness",
    "customer acquisition", "growth hacking", "product launch", "market research", "data analysis", "machine learning",
    "user experience", "mobile optimization", "site speed", "page speed", "core web", "web vitals", "schema markup", "structured data",
    "internal linking",
]
WORD = "[a-z]{3,}"


def _words(c: Column, noise: list[str] | None = None) -> Column:
    found = F.regexp_extract_all(c, F.lit(WORD), F.lit(0))
    if noise is None:
        return found
    return F.filter(found, lambda w: ~w.isin(noise))  # planned as one hash-set lookup


def title_words(c: Column) -> Column:
    return _words(c, STOP_WORDS + FORMAT_WORDS)


def strip_format(title: Column) -> Column:
    """Lower-cased topic part of a title."""
    low = F.lower(title)
    for phrase in FORMAT_PHRASES:
        low = F.replace(low, F.lit(phrase), F.lit(" "))
    low = F.regexp_replace(low, r"^\d+\s+(?:best|top|key|most\s+important|awesome|incredible)\s+", "")
    low = F.regexp_replace(low, r"^(?:how\s+to|what\s+(?:is|are)|why\s+you\s+should)\s+", "")
    low = F.regexp_replace(low, r"(?s)\s*(?:in|for)\s+\d{4}\b[^\n]*$", "")
    cut = lambda x: F.regexp_replace(x, r"\s*[-–|:].{0,30}$", "")
    both = tx.let(low, lambda x: F.struct(x.alias("low"), cut(x).alias("cut")))
    return tx.let(both, lambda s: tx.strip(F.when(tx.word_count(s["cut"]) >= 3, s["cut"]).otherwise(s["low"])))


def bigrams(words: Column) -> Column:
    """Consecutive word pairs."""
    return tx.let(
        words,
        lambda w: F.zip_with(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        ),
    )


def title_phrases(title: Column) -> Column:
    """Unigrams then bigrams of the topic part of a title."""
    return tx.let(title_words(strip_format(title)), lambda w: F.concat(w, bigrams(w)))


def body_phrases(posts: DataFrame, unigrams: int = 10, pairs: int = 5) -> DataFrame:
    """Each post's most frequent body words and word pairs (ties: first seen)."""
    noise = STOP_WORDS + FORMAT_WORDS + UI_WORDS
    text = F.lower(F.regexp_replace("body_html", r"<[^>]+>", " "))
    base = posts.select("post_id", _words(text, noise).alias("w"))

    def best(phrases: Column, k: int) -> DataFrame:
        rows = base.select("post_id", F.posexplode(phrases).alias("pos", "phrase")).groupBy("post_id", "phrase").agg(
            F.count("*").alias("n"), F.min("pos").alias("first")
        )
        return top_per_group(rows, ["post_id"], [F.desc("n"), F.asc("first")], k).select("post_id", "phrase", "n")

    return best(F.col("w"), unigrams).unionByName(best(bigrams(F.col("w")), pairs))


def heading_phrases(posts: DataFrame) -> DataFrame:
    """Words and word pairs of every h2/h3, with counts."""
    noise = STOP_WORDS + FORMAT_WORDS + UI_WORDS
    heads = posts.select("post_id", F.explode(F.filter("headings", lambda h: h["level"].isin("h2", "h3"))).alias("h"))
    words = heads.select("post_id", _words(F.lower("h.text"), noise).alias("w"))
    return words.select("post_id", F.explode(F.concat("w", bigrams(F.col("w")))).alias("phrase")).groupBy("post_id", "phrase").agg(
        F.count("*").alias("n")
    )


def site_stops(titles: DataFrame) -> DataFrame:
    """Words in so many titles of a site that they say nothing (15/20/30 % by size)."""
    n = titles.groupBy("site_id").agg(F.count("*").alias("n"))
    df = titles.select("site_id", F.explode(F.array_distinct(title_words(strip_format(F.col("title"))))).alias("word")).groupBy(
        "site_id", "word"
    ).agg(F.count("*").alias("df"))
    limit = F.when(F.col("n") < 100, 0.15).when(F.col("n") < 300, 0.20).otherwise(0.30)
    return df.join(n, "site_id").filter(F.col("df") >= F.col("n") * limit).select("site_id", "word", "df")


def corpus_frequency(titles: DataFrame) -> DataFrame:
    """Titles per phrase (words and word pairs) of a site."""
    return titles.select("site_id", F.explode(F.array_distinct(title_phrases(F.col("title")))).alias("phrase")).groupBy(
        "site_id", "phrase"
    ).agg(F.count("*").alias("df"))


def min_doc_freq(n: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(n * 0.15)).cast("int")


def smart_title(word: Column) -> Column:
    return F.when(word.isin(ACRONYMS), F.upper(word)).otherwise(F.initcap(word))


def smart_phrase(phrase: Column) -> Column:
    return F.array_join(F.transform(F.split(phrase, " "), smart_title), " ")


def redundant(a: Column, b: Column) -> Column:
    """A word of one phrase contains a word of the other."""
    return tx.let(
        F.split(F.lower(b), " "),
        lambda wb: F.exists(
            F.split(F.lower(a), " "),
            lambda x: F.exists(wb, lambda y: (F.length(x) >= 3) & (F.length(y) >= 3) & (F.contains(x, y) | F.contains(y, x))),
        ),
    )


def connect(a: Column, b: Column) -> Column:
    """Join two label parts: compound nouns plainly, others with '&'."""
    def joined(s: Column) -> Column:
        x, y = s["a"], s["b"]
        return (
            F.when(F.lower(F.concat_ws(" ", x, y)).isin(COMPOUNDS), F.concat_ws(" ", x, y))
            .when(F.lower(F.concat_ws(" ", y, x)).isin(COMPOUNDS), F.concat_ws(" ", y, x))
            .otherwise(F.concat_ws(" & ", x, y))
        )

    return tx.let(F.struct(a.alias("a"), b.alias("b")), joined)


def cluster_word_df(titles: DataFrame) -> DataFrame:
    """Titles per word and cluster: all words (freq) and topic words only (topic)."""
    return (
        titles.select("cluster_id", F.explode(F.array_distinct(_words(F.lower("title")))).alias("word"))
        .groupBy("cluster_id", "word").agg(F.count("*").alias("freq"))
        .withColumn("topic", F.when(F.col("word").isin(STOP_WORDS + FORMAT_WORDS), F.lit(0)).otherwise(F.col("freq")))
    )


def phrase_scores(posts: DataFrame) -> DataFrame:
    """TF-IDF of every phrase of a cluster.

    posts(post_id, site_id, cluster_id, title, body_html, headings) →
    (site_id, cluster_id, phrase, is_bigram, weight, score).
    """
    titles = posts.select("site_id", "title")
    key = posts.select("post_id", "site_id", "cluster_id")
    parts = (
        posts.select("site_id", "cluster_id", F.explode(title_phrases(F.col("title"))).alias("phrase"), F.lit(3).alias("w"))
        .unionByName(heading_phrases(posts).join(key, "post_id").select("site_id", "cluster_id", "phrase", (2 * F.col("n")).alias("w")))
        .unionByName(body_phrases(posts).join(key, "post_id").select("site_id", "cluster_id", "phrase", F.lit(1).alias("w")))
    )
    weight = parts.groupBy("site_id", "cluster_id", "phrase").agg(F.sum("w").alias("weight"))
    stops = site_stops(titles).select("site_id", F.col("word"), F.lit(True).alias("stop"))
    pair = F.contains("phrase", F.lit(" "))
    first, second = F.substring_index("phrase", " ", 1), F.substring_index("phrase", " ", -1)
    marked = (
        weight.withColumns({"is_bigram": pair, "_w1": first, "_w2": second})
        .join(stops.select("site_id", F.col("word").alias("_w1"), F.col("stop").alias("_s1")), ["site_id", "_w1"], "left")
        .join(stops.select("site_id", F.col("word").alias("_w2"), F.col("stop").alias("_s2")), ["site_id", "_w2"], "left")
    )
    noise1 = F.coalesce("_s1", F.lit(False)) | F.col("_w1").isin(FORMAT_WORDS)
    noise2 = F.coalesce("_s2", F.lit(False)) | F.col("_w2").isin(FORMAT_WORDS)
    marked = marked.withColumn("noise", noise1 & noise2)
    # totals: every bigram counts, of the words only those that are not noise
    totals = marked.filter("is_bigram OR NOT noise").groupBy("cluster_id", "is_bigram").agg(F.sum("weight").alias("total"))
    n = titles.groupBy("site_id").agg(F.count("*").alias("n_docs"))
    df = corpus_frequency(titles)
    return (
        marked.filter("NOT noise").join(totals, ["cluster_id", "is_bigram"]).join(n, "site_id").join(df, ["site_id", "phrase"], "left")
        .select(
            "site_id", "cluster_id", "phrase", "is_bigram", "weight",
            (F.col("weight") / F.col("total") * F.log(F.col("n_docs") / (1 + F.coalesce("df", F.lit(0))))).alias("score"),
        )
    )


def primary_bigrams(scored: DataFrame, titles: DataFrame) -> DataFrame:
    """Best bigram of each cluster whose two words both occur in enough of its titles.

    Scores are compared to nine decimals so that equal ones fall back to the phrase.
    """
    sizes = titles.groupBy("cluster_id").agg(F.count("*").alias("n"))
    wdf = cluster_word_df(titles)
    w1 = wdf.select("cluster_id", F.col("word").alias("_w1"), F.col("topic").alias("_t1"))
    w2 = wdf.select("cluster_id", F.col("word").alias("_w2"), F.col("topic").alias("_t2"))
    grounded = (
        scored.filter("is_bigram AND score > 0").join(sizes, "cluster_id")
        .filter(F.col("weight") >= F.when(F.col("n") < 5, 1).otherwise(2))
        .withColumns({"_w1": F.substring_index("phrase", " ", 1), "_w2": F.substring_index("phrase", " ", -1), "floor": min_doc_freq(F.col("n"))})
        .join(w1, ["cluster_id", "_w1"]).join(w2, ["cluster_id", "_w2"])
        .filter((F.col("_t1") >= F.col("floor")) & (F.col("_t2") >= F.col("floor")))
    )
    return top_per_group(grounded, ["cluster_id"], [F.desc(F.round("score", 9)), F.asc("phrase")], 1)


def raw_labels(posts: DataFrame) -> DataFrame:
    """Label, up to three alternatives and description words per cluster.

    Order of phrases: score, then the phrase itself. Per cluster only the best
    few phrases are gathered, so the arrays stay small however large it is.
    """
    scored = durable(phrase_scores(posts))
    titles = posts.select("post_id", "cluster_id", "title")
    sizes = titles.groupBy("cluster_id").agg(F.count("*").alias("n"))
    wdf = cluster_word_df(titles)
    floor = min_doc_freq(F.col("n"))
    least = F.when(F.col("n") < 5, 1).otherwise(2)
    by_score = [F.desc(F.round("score", 9)), F.asc("phrase")]

    pairs = scored.filter("is_bigram").join(sizes, "cluster_id")
    primary = primary_bigrams(scored, titles).select("cluster_id", smart_phrase(F.col("phrase")).alias("primary"))
    runners = (
        top_per_group(pairs, ["cluster_id"], by_score, 6, rank="r").filter((F.col("r") >= 2) & (F.col("score") > 0) & (F.col("weight") >= least))
        .groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", "phrase"))).alias("_r"))
        .select("cluster_id", F.transform("_r", lambda x: smart_phrase(x["phrase"])).alias("runners"))
    )
    singles = top_per_group(scored.filter("NOT is_bigram"), ["cluster_id"], by_score, 10, rank="r")
    words = (
        singles.filter("score > 0").join(sizes, "cluster_id")
        .join(wdf.select("cluster_id", F.col("word").alias("phrase"), "topic", "freq"), ["cluster_id", "phrase"])
        .filter(F.col("topic") >= floor + 1)
        .groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("r", F.col("phrase").alias("w"), "freq"))).alias("_w"))
        .select("cluster_id", F.slice(F.transform("_w", lambda x: F.struct(smart_title(x["w"]).alias("t"), x["w"].alias("w"), x["freq"].alias("freq"))), 1, 5).alias("words"))
    )
    common = top_per_group(scored.filter("NOT is_bigram"), ["cluster_id"], [F.desc("weight"), F.asc("phrase")], 1).select(
        "cluster_id", smart_title(F.col("phrase")).alias("common")
    )
    none = F.array().cast("array<string>")
    base = (
        sizes.join(primary, "cluster_id", "left").join(runners, "cluster_id", "left").join(words, "cluster_id", "left").join(common, "cluster_id", "left")
        .withColumns(
            {
                "runners": F.coalesce("runners", none),
                "top": F.coalesce(F.transform("words", lambda x: x["t"]), none),
                "words": F.coalesce("words", F.array().cast("array<struct<t:string,w:string,freq:bigint>>")),
            }
        )
    )
    base = durable(base)
    top, head = F.col("top"), F.try_element_at("top", F.lit(1))
    qualifier = F.try_element_at(
        F.filter("top", lambda w: ~F.contains(F.lower("primary"), F.lower(w)) & ~redundant(w, F.col("primary"))), F.lit(1)
    )
    second = F.try_element_at(F.filter(F.slice(top, 2, 10), lambda w: ~redundant(w, F.try_element_at(F.col("top"), F.lit(1)))), F.lit(1))
    # candidates: runner-up pairs first, then neighbouring top words
    steps = F.zip_with(F.slice(top, 1, 4), F.slice(top, 2, 4), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), connect(a, b)))
    base = base.withColumn("_q", F.when(F.col("primary").isNotNull(), qualifier).otherwise(second)).withColumn("_h", F.coalesce("primary", head))
    base = base.withColumn(
        "label", F.when(F.col("_h").isNull(), F.coalesce("common", F.lit("General Content"))).when(F.col("_q").isNull(), F.col("_h")).otherwise(connect(F.col("_h"), F.col("_q")))
    )
    base = durable(base.withColumn("cands", F.array_distinct(F.concat("runners", F.filter(steps, lambda x: x.isNotNull())))))
    alts = _valid_alternatives(base, titles, wdf, floor)
    desc = F.slice(
        F.transform(
            F.filter("words", lambda x: ~F.contains(F.lower("label"), x["w"]) & (x["freq"] >= floor)), lambda x: x["t"]
        ), 1, 5,
    )
    return base.join(alts, "cluster_id", "left").select(
        "cluster_id", "label", F.coalesce("alternatives", none).alias("alternatives"), desc.alias("words")
    )


def _valid_alternatives(base: DataFrame, titles: DataFrame, wdf: DataFrame, floor: Column) -> DataFrame:
    """Keep candidate labels that are grounded in the titles and are not proper names."""
    cand = base.select("cluster_id", "n", "label", F.posexplode("cands").alias("pos", "alt"))
    cand = cand.withColumn("_ws", F.array_distinct(_words(F.lower("alt")))).filter(
        (F.size("_ws") >= 2) & ~F.exists("_ws", lambda w: w.isin(UI_WORDS)) & (F.lower("alt") != F.lower("label"))
    )
    rare = (
        cand.select("cluster_id", "alt", "n", F.explode("_ws").alias("word")).join(wdf, ["cluster_id", "word"], "left")
        .filter(F.coalesce("freq", F.lit(0)) < floor).select("cluster_id", "alt").distinct()
    )
    # first title that spells the candidate: capitals in it mean a proper name
    lists = cand.groupBy("cluster_id").agg(F.collect_set("alt").alias("_alts"))
    spelled = titles.join(lists, "cluster_id").select(
        "cluster_id", "post_id", "title", F.explode(F.filter("_alts", lambda a: F.contains(F.lower("title"), F.lower(a)))).alias("alt")
    )
    at = F.instr(F.lower("title"), F.lower("alt"))
    raw = F.col("title").substr(at, F.length("alt"))
    proper = (
        spelled.groupBy("cluster_id", "alt").agg(F.min_by(raw, "post_id").alias("_raw"))
        .filter((tx.word_count(F.col("_raw")) >= 2) & F.forall(tx.tokens(F.col("_raw")), lambda w: F.left(w, F.lit(1)).rlike(r"\p{Lu}")))
        .select("cluster_id", "alt")
    )
    good = cand.join(rare, ["cluster_id", "alt"], "left_anti").join(proper, ["cluster_id", "alt"], "left_anti")
    return good.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "alt"))).alias("_a")).select(
        "cluster_id", F.slice(F.transform("_a", lambda x: x["alt"]), 1, 3).alias("alternatives")
    )


def cluster_sites(titles: DataFrame) -> DataFrame:
    """The site of each cluster: titles(site_id, cluster_id, …)."""
    return titles.groupBy("cluster_id").agg(F.min("site_id").alias("site_id"))


def specific(labels: DataFrame, titles: DataFrame, label: str = "label") -> DataFrame:
    """Whether a label sets its cluster apart in its site: (cluster_id, label, specific).

    A label fails when all its words occur in more than half of the site's other
    clusters. A word found in at most half of them settles the question, so
    only labels made of very common words are compared cluster by cluster.
    """
    sites = cluster_sites(titles)
    wdf = cluster_word_df(titles).select("cluster_id", "word").join(sites, "cluster_id")
    n_other = sites.groupBy("site_id").agg((F.count("*") - 1).alias("_others"))
    spread = wdf.groupBy("site_id", "word").agg(F.count("*").alias("_c"))
    words = labels.select("cluster_id", label, F.explode(F.array_distinct(title_words(F.lower(label)))).alias("word")).join(sites, "cluster_id")
    common = words.join(spread, ["site_id", "word"], "left").join(n_other, "site_id").groupBy("site_id", "cluster_id", label).agg(
        F.count("*").alias("_m"), F.min(F.coalesce("_c", F.lit(0))).alias("_min"), F.first("_others").alias("_others")
    ).filter(F.col("_min") > F.col("_others") / 2)
    check = common.join(words.select("cluster_id", label, "word"), ["cluster_id", label])
    other = wdf.select("site_id", "word", F.col("cluster_id").alias("_other"))
    hits = (
        check.join(other, ["site_id", "word"]).filter("_other <> cluster_id")
        .groupBy("cluster_id", label, "_m", "_others", "_other").agg(F.count("*").alias("_got")).filter("_got = _m")
        .groupBy("cluster_id", label, "_others").agg(F.count("*").alias("_hits"))
        .filter((F.col("_others") > 0) & (F.col("_hits") / F.col("_others") > 0.5)).select("cluster_id", label, F.lit(False).alias("_bad"))
    )
    return labels.select("cluster_id", label).distinct().join(hits, ["cluster_id", label], "left").select(
        "cluster_id", label, F.coalesce("_bad", F.lit(True)).alias("specific")
    )


def use_specific(labels: DataFrame, titles: DataFrame) -> DataFrame:
    """Swap a label that is not specific for its first specific alternative."""
    every = labels.select("cluster_id", F.col("label").alias("text"), F.lit(0).alias("pos")).unionByName(
        labels.select("cluster_id", F.posexplode("alternatives").alias("pos", "text")).select("cluster_id", "text", (F.col("pos") + 1).alias("pos"))
    )
    ok = every.join(specific(every, titles, "text"), ["cluster_id", "text"])
    best = ok.filter("specific").groupBy("cluster_id").agg(F.min_by("text", "pos").alias("_pick"))
    return labels.join(best, "cluster_id", "left").withColumn("label", F.coalesce("_pick", "label")).drop("_pick")


def primary_pair(label: Column) -> Column:
    return F.lower(F.array_join(F.slice(F.split(F.replace(label, F.lit(" & "), F.lit(" ")), " "), 1, 2), " "))


def repair_duplicates(labels: DataFrame, words: DataFrame) -> DataFrame:
    """Make a site's labels distinct: repeats of a leading pair take an unused alternative,
    exact repeats get the cluster's most common other word in brackets.

    labels(site_id, cluster_id, label, alternatives), words(cluster_id, word, n).
    """
    pair = ["site_id", "_p"]
    keyed = labels.withColumn("_p", primary_pair(F.col("label")))
    first = keyed.groupBy(*pair).agg(F.min("cluster_id").alias("_first"))
    keyed = keyed.join(first, pair)
    late = keyed.filter(F.col("cluster_id") != F.col("_first")).select("site_id", "cluster_id", F.posexplode("alternatives").alias("pos", "alt")).withColumn(
        "_p", primary_pair(F.col("alt"))
    )
    free = late.join(first.withColumnRenamed("_first", "_owner"), pair, "left").filter(
        F.col("_owner").isNull() | (F.col("_owner") > F.col("cluster_id"))
    ).groupBy("cluster_id").agg(F.min_by("alt", "pos").alias("_alt"))
    named = durable(keyed.join(free, "cluster_id", "left").withColumn("label", F.coalesce("_alt", "label")).drop("_alt", "_p", "_first"))
    same = named.groupBy("site_id", "label").agg(F.count("*").alias("_same"))
    named = named.join(same, ["site_id", "label"])
    extra = top_per_group(
        named.filter("_same > 1").select("cluster_id", "label").join(words, "cluster_id").filter(~F.contains(F.lower("label"), F.col("word"))),
        ["cluster_id"], [F.desc("n"), F.asc("word")], 1,
    ).select("cluster_id", smart_title(F.col("word")).alias("_extra"))
    return named.join(extra, "cluster_id", "left").withColumn(
        "label", F.when(F.col("_extra").isNotNull(), F.format_string("%s (%s)", "label", "_extra")).otherwise(F.col("label"))
    ).drop("_same", "_extra")


def description(label: Column, words: Column) -> Column:
    """Sentence naming the topic words that are not part of the label."""
    left = tx.let(
        F.lower(label), lambda low: F.transform(F.filter(words, lambda w: ~F.contains(low, F.lower(w))), lambda w: F.lower(w))
    )

    def sentence(x: Column) -> Column:
        listed = F.concat(F.array_join(F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), ", "), F.lit(", and "), F.try_element_at(x, F.lit(-1)))
        text = F.when(F.size(x) <= 2, F.array_join(x, " and ")).otherwise(listed)
        return F.when(F.size(x) == 0, F.lit("")).otherwise(F.concat(F.lit("Posts covering "), text, F.lit(".")))

    return tx.let(left, sentence)


def cluster_words(posts: DataFrame) -> DataFrame:
    """Topic words of a cluster's titles by frequency, without site stop words."""
    words = posts.select("site_id", "cluster_id", F.explode(title_words(strip_format(F.col("title")))).alias("word")).groupBy(
        "site_id", "cluster_id", "word"
    ).agg(F.count("*").alias("n"))
    return words.join(site_stops(posts.select("site_id", "title")).select("site_id", "word"), ["site_id", "word"], "left_anti").drop("site_id")


def label_clusters(posts: DataFrame) -> DataFrame:
    """Final label, alternatives and description of every cluster."""
    titles = posts.select("site_id", "post_id", "cluster_id", "title")
    named = use_specific(raw_labels(posts), titles)
    done = repair_duplicates(named.drop("site_id").join(cluster_sites(titles), "cluster_id"), cluster_words(posts))
    return done.select("cluster_id", "label", "alternatives", description(F.col("label"), F.col("words")).alias("description"))
