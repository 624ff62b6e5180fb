"""Queries on text: cleaning, triage, tokens, keyword rules, JSON, search. Each has the SQL that must give its rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hindcast.functions import text as T
from hindcast.sources.views import table, with_views

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Phrases that are not part of an article.
BOILERPLATE = ["all rights reserved", "click here", "cookie policy", "subscribe now", "terms of service"]
#: Fixed values of the queries: rules of the event classifier, in order; the first with a keyword in the text wins.
RULES = [("conflict", ["therea", "stwh"]), ("supply", ["onthe", "tiou"]), ("demand", ["queen", "ción"]), ("policy", ["ung", "heit"]), ("macro", ["ment", "eau"])]
EXTREME = ["tion", "ness", "zz", "ththth"]
STOP = ["", "nan", "none", "unknown", "n/a"]
TRIAGE = ["the", "de", "der", "la"]


def query(sql: str = "", *names: str):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql, *names) if names else sql
        return f

    return add


PLAIN = r"regexp_replace(regexp_replace(text, '\x1b\[[0-9;]*[A-Za-z]', ' ', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g')"


def squash_sql(c: str) -> str:
    return rf"trim(regexp_replace({c}, '[ \t\n\x0b\f\r]+', ' ', 'g'))"


HTML = "html"
for _pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>"):
    HTML = f"regexp_replace({HTML}, '{_pattern}', ' ', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_entity}', '{_char}')"


@query(f"select page_id, {squash_sql(HTML)} as body from pages")
def clean_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_html(F.col("html")).alias("body"))


@query(
    rf"""select doc_id, md5({squash_sql("regexp_replace(text, '(?i)" + "|".join(BOILERPLATE) + "', ' ', 'g')")}) as cleaned_md5,
    case when length(t) > 100 then substr(t, 1, 100) || '...' else t end as short from (select *, {squash_sql(PLAIN)} as t from documents)"""
)
def light_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.light_clean(F.col("text"), BOILERPLATE)).alias("cleaned_md5"), T.clean_text(F.col("text"), 100).alias("short"))


HITS = r"len(list_filter(regexp_extract_all(lower({}), '[\p{{L}}\d]+'), lambda x: x in ('the', 'de', 'der', 'la')))"
TRIAGED = f"""select doc_id, hits, words, round(case when title then 1.6 else 1.0 end * hits / (greatest(words, 1) / 100.0), 6) as score, title from (
    select doc_id, {HITS.format("text")} as hits, case when s = '' then 0 else len(string_split(s, ' ')) end as words,
    {HITS.format("string_split(text, chr(10))[1]")} > 0 as title from (select *, {squash_sql("text")} as s from documents))"""


@query(f"select doc_id, cast(hits as int) as hits, cast(words as int) as words, score, case when title and score >= 0.5 then 'kept' when score >= 15 then 'review' else 'dropped' end as bucket from ({TRIAGED})")
def article_triage(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", T.hits(F.col("text"), TRIAGE).alias("hits"), T.words(F.col("text")).alias("words"), (T.hits(F.split("text", "\n")[0], TRIAGE) > 0).alias("title"))
    score = F.round(F.when(F.col("title"), 1.6).otherwise(1.0) * F.col("hits") / (F.greatest("words", F.lit(1)) / 100.0), 6)
    docs = docs.withColumn("score", score)
    bucket = F.when(F.col("title") & (F.col("score") >= 0.5), "kept").when(F.col("score") >= 15, "review").otherwise("dropped")
    return docs.select("doc_id", "hits", "words", "score", bucket.alias("bucket"))


BAG_SQL = r"""list_distinct(list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '[,;\n/|]+'), lambda x: trim(x)), lambda x: length(x) between 1 and 60 and x not in ('', 'nan', 'none', 'unknown', 'n/a')))"""


@query(f"select doc_id, cast(len(b) as int) as n, array_to_string(list_sort(b), '|') as bag from (select doc_id, {BAG_SQL} as b from documents)")
def tokenise_bag(spark, sf):
    bags = table(spark, sf, "documents").select("doc_id", T.bag(F.col("text"), r"[,;\n/|]+", STOP).alias("b"))
    return bags.select("doc_id", F.size("b").alias("n"), F.array_join(F.sort_array("b"), "|").alias("bag"))


@query(
    r"""select source, array_to_string(list(w order by n desc, w), ' / ') as label from (select source, w, count(*) as n, row_number() over (partition by source order by count(*) desc, w) as k
    from (select source, unnest(regexp_extract_all(lower(text), '[a-z][a-z\-]{3,}')) as w from documents) where w not in ('that', 'this', 'with') group by 1, 2) where k <= 3 group by 1"""
)
def auto_label(spark, sf):
    words = table(spark, sf, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z][a-z\-]{3,}"), F.lit(0))).alias("w")).where(~F.col("w").isin("that", "this", "with"))
    counts = words.groupBy("source", "w").agg(F.count(F.lit(1)).alias("n"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "w"))).where("k <= 3")
    return top.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]), " / ").alias("label"))


RULE_SQL = "case " + " ".join("when " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) + f" then '{n}'" for n, ws in RULES) + " else 'other' end"
SEVERITY_SQL = " + ".join(f"contains(lower(text), '{w}')::int" for w in EXTREME)


@query(f"select doc_id, {RULE_SQL} as event_type, least(1 + {SEVERITY_SQL}, 4) as severity from documents")
def keyword_classify(spark, sf):
    low = F.lower("text")
    extreme = sum((low.contains(w).cast("int") for w in EXTREME), F.lit(1))
    return table(spark, sf, "documents").select("doc_id", T.first_rule(F.col("text"), RULES, "other").alias("event_type"), F.least(extreme, F.lit(4)).alias("severity"))


@query(
    f"""select doc_id, event_type, cast(base + 10 * (severity - 1) as int) as score, case when base + 10 * (severity - 1) >= 80 then 'CRITICAL' when base + 10 * (severity - 1) >= 60 then 'HIGH'
    when base + 10 * (severity - 1) >= 40 then 'MODERATE' else 'LOW' end as label from (select *, case event_type when 'conflict' then 60 when 'supply' then 50 when 'demand' then 40 when 'policy' then 35 else 20 end as base
    from (select doc_id, {RULE_SQL} as event_type, least(1 + {SEVERITY_SQL}, 4) as severity from documents))"""
)
def headline_score(spark, sf):
    c = keyword_classify(spark, sf)
    kind = F.col("event_type")
    base = F.when(kind == "conflict", 60).when(kind == "supply", 50).when(kind == "demand", 40).when(kind == "policy", 35).otherwise(20)
    score = base + 10 * (F.col("severity") - 1)
    label = F.when(score >= 80, "CRITICAL").when(score >= 60, "HIGH").when(score >= 40, "MODERATE").otherwise("LOW")
    return c.select("doc_id", "event_type", score.alias("score"), label.alias("label"))


@query(
    """select conv_id, turn, contains(t, 'supply') or contains(t, 'tion') as supply, contains(t, 'demand') or contains(t, 'ment') as demand, case when contains(t, 'the') then 'en' when contains(t, 'der') then 'de' else 'other' end as region,
    case when length(t) < 100 then 'short' when length(t) < 400 then 'medium' else 'long' end as horizon, sign(len(string_split(t, 'good')) - len(string_split(t, 'bad')))::int as sentiment from (select *, lower(text) as t from conversations)"""
)
def attribute_fallback(spark, sf):
    t = F.col("t")
    count = lambda w: F.size(F.split(t, w))
    return table(spark, sf, "conversations").withColumn("t", F.lower("text")).select(
        "conv_id", "turn", (t.contains("supply") | t.contains("tion")).alias("supply"), (t.contains("demand") | t.contains("ment")).alias("demand"),
        F.when(t.contains("the"), "en").when(t.contains("der"), "de").otherwise("other").alias("region"),
        F.when(F.length(t) < 100, "short").when(F.length(t) < 400, "medium").otherwise("long").alias("horizon"), F.signum(count("good") - count("bad")).cast("int").alias("sentiment"),
    )


@query("select event_id, event_type, json_extract_string(props, '$.k') as k, json_valid(props) as valid from events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query(
    r"""select event_id, json_extract_string(coalesce(case when json_valid(w) then w end, regexp_extract(w, '(?s)(\{.*\})', 1)), '$.k') as k from (select event_id, case cast(event_id % 3 as int) when 0 then '{"k": "' || event_type || '"}' when 1 then '```json
{"k": "' || event_type || '"}
```' else 'Answer: {"k": "' || event_type || '"} done' end as w from events)"""
)
def model_json(spark, sf):
    body = F.concat(F.lit('{"k": "'), F.col("event_type"), F.lit('"}'))
    kind = F.col("event_id") % 3
    w = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.concat(F.lit("Answer: "), body, F.lit(" done")))
    return table(spark, sf, "events").select("event_id", T.parsed_json(w, "k string")["k"].alias("k"))


@query("select event_id, isoyear(ts) || '-W' || week(ts) as week_key from events")
def iso_week_clusters(spark, sf):
    return table(spark, sf, "events").select("event_id", T.iso_week(F.col("ts")).alias("week_key"))


@query("select doc_id, lang, source from documents where lang = 'en' and contains(lower(source), 'src1') and contains(lower(lang || ' ' || source || ' ' || text), 'the') and contains(lower(lang || ' ' || source || ' ' || text), 'and')")
def event_search(spark, sf):
    d = table(spark, sf, "documents")
    every = T.contains_all([F.col("lang"), F.col("source"), F.col("text")], ["the", "And"])
    return d.where((F.col("lang") == "en") & F.lower("source").contains("src1") & every).select("doc_id", "lang", "source")


@query(r"select event_id, ts, event_type, value from events where event_type = 'purchase' order by ts desc, event_id limit 50")
def events_endpoint(spark, sf):
    return table(spark, sf, "events").where("event_type = 'purchase'").orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts", "event_type", "value")


@query("select e.event_id from events e where not exists (select 1 from orders o where o.o_orderkey = e.event_id and o.o_orderstatus = 'F')")
def anti_resume(spark, sf):
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return table(spark, sf, "events").join(done, "event_id", "left_anti").select("event_id")


@query("select d.doc_id, d.lang from documents d where exists (select 1 from labels l where l.doc_id = d.doc_id)")
def semi_labelled(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("select doc_id as id, text from documents union all select -1 - item_id, text from benchmark")
def union_common_columns(spark, sf):
    a, b = table(spark, sf, "documents").withColumnRenamed("doc_id", "id"), table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"), "text")
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common).unionByName(b.select(*common))


@query("select d.doc_id, d.source, l.quality, l.toxic from documents d join labels l using (doc_id)")
def scorer_corpus(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", "source", "quality", "toxic")


@query(
    r"""select doc_id, case when t = '' then 0 when contains(t, '->') then len(string_split(t, '->')) when contains(t, '→') then len(string_split(t, '→')) when contains(t, ';') then len(string_split(t, ';')) when contains(t, '|') then len(string_split(t, '|')) else 1 end::int as links
    from (select doc_id, trim(coalesce(text, '')) as t from documents)"""
)
def chain_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.chain_length(F.col("text")).alias("links"))


@query(r"select doc_id, array_to_string(list_slice(regexp_extract_all(text, '[A-Za-z]+'), 1, 5), ', ') || ' ' || lang as trigger from documents")
def trigger_words(spark, sf):
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 5)
    return table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", F.array_join(words, ", "), "lang").alias("trigger"))


@query(
    r"""select doc_id, cast(k as int) as k, md5(line) as line_md5 from (select doc_id, unnest(l) as line, generate_subscripts(l, 1) - 1 as k from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') as l from documents))"""
)
def split_articles(spark, sf):
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return table(spark, sf, "documents").select("doc_id", F.posexplode(lines).alias("k", "line")).select("doc_id", "k", F.md5("line").alias("line_md5"))


@query(
    """select quality, toxic, count(*) as n, round(avg(n_chars), 4) as mean_chars from documents join labels using (doc_id) group by 1, 2"""
)
def label_crosstab(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return both.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@query("select round(corr(n_chars, quality), 6) as r, count(*) as n from documents join labels using (doc_id)")
def point_biserial(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return both.agg(F.round(F.corr("n_chars", "quality"), 6).alias("r"), F.count(F.lit(1)).alias("n"))


@query(
    """,, t as (select lang, quality, count(*) as o from documents join labels using (doc_id) group by 1, 2), l as (select lang, sum(o) as a from t group by 1), q as (select quality, sum(o) as b from t group by 1)
    select round(sum((coalesce(o, 0) - a * b / n) ** 2 / (a * b / n)), 6) as chi2 from l cross join q cross join (select sum(o) as n from t) left join t using (lang, quality)""".replace(",, t", "with t")
)
def chi_square(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("o"))
    # the table of counts is small: languages by two labels
    grid = both.select("lang").distinct().crossJoin(F.broadcast(both.select("quality").distinct())).join(both, ["lang", "quality"], "left").na.fill(0, ["o"])
    a, b, n = F.sum("o").over(Window.partitionBy("lang")), F.sum("o").over(Window.partitionBy("quality")), F.sum("o").over(Window.partitionBy(F.lit(0)))
    e = a * b / n
    return grid.select(((F.col("o") - e) ** 2 / e).alias("x")).agg(F.round(F.sum("x"), 6).alias("chi2"))


@query("select lang, array_to_string(list(source || ':' || n order by n desc, source), ', ') as top from (select lang, source, count(*) as n, row_number() over (partition by lang order by count(*) desc, source) as k from documents group by 1, 2) where k <= 3 group by 1")
def top_types(spark, sf):
    n = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source"))).where("k <= 3")
    return top.groupBy("lang").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "source", "n"))), lambda x: F.concat_ws(":", x["source"], x["n"].cast("string"))), ", ").alias("top"))


@query("select doc_id, 'Document ' || doc_id || ' (' || lang || '): ' || case when quality = 1 then 'accepted' else 'rejected' end || ', ' || n_chars || ' characters.' as report from documents join labels using (doc_id)")
def template_report(spark, sf):
    both = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return both.select("doc_id", F.concat(F.format_string("Document %d (%s): ", "doc_id", "lang"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected"), F.format_string(", %d characters.", "n_chars")).alias("report"))


def lda_topics(spark, sf):
    """Dominant topic of each document; what it gives is random but for the seed."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer, RegexTokenizer, StopWordsRemover

    docs = RegexTokenizer(inputCol="text", outputCol="raw", pattern="[^A-Za-z]+", minTokenLength=4).transform(table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    docs = StopWordsRemover(inputCol="raw", outputCol="words").transform(docs)
    counts = CountVectorizer(inputCol="words", outputCol="features", vocabSize=15000, minDF=3, maxDF=0.7).fit(docs).transform(docs)
    model = LDA(k=10, maxIter=5, seed=42, optimizer="online").fit(counts.select("features"))
    from pyspark.ml.functions import vector_to_array

    p = vector_to_array("topicDistribution")
    return model.transform(counts.select("doc_id", "features")).select("doc_id", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("topic"), F.round(F.array_max(p), 6).alias("share"))


QUERIES["lda_topics"] = lda_topics
