"""Queries of document retrieval: benchmark texts are the queries, all documents are searched."""

from pyspark.sql import functions as F

from ..operators import retrieval as rt
from ..operators import vector_lsh as lsh
from .inputs import FEED, STORED, feed_docs, stored_docs, table
from .registry import query

DOCS = """docs AS (
  SELECT doc_id, text, lang, source, n_chars, coalesce(quality, 1) = 1 AS is_active, coalesce(toxic, 0) AS toxic,
         DATE '2024-01-01' + (n_chars % 28)::INT AS published_at FROM documents LEFT JOIN labels USING (doc_id))"""


def docs(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.select(
        "doc_id", "text", "lang", "source", "n_chars", (F.coalesce("quality", F.lit(1)) == 1).alias("is_active"),
        F.coalesce("toxic", F.lit(0)).alias("toxic"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 28).cast("int")).alias("published_at"))


@query("R1_filter_docs", f"""
WITH {DOCS} SELECT doc_id FROM docs WHERE is_active AND lang IN ('en', 'fr') AND source LIKE '%src1%'
  AND published_at > DATE '2024-01-03' AND published_at < DATE '2024-01-20' AND published_at >= DATE '2024-01-05' AND published_at <= DATE '2024-01-19'""")
def filtered(spark, d):
    x = docs(spark, d).withColumn("player_ids", F.array("lang")).withColumn("teams", F.array("source"))
    return rt.filter_docs(x, any_ids=["en", "fr"], any_teams=[], source="SRC1", after="2024-01-03", before="2024-01-20",
                          start="2024-01-05", end="2024-01-19").select("doc_id")


@query("R1_filter_docs_by_name", f"""
WITH {DOCS} SELECT doc_id FROM docs WHERE is_active AND lang IN ('en', 'fr') AND (source LIKE '%c1%' OR lang LIKE '%c1%')
  AND lower(lang) IN ('en', 'de') AND source = 'src1'""")
def filtered_by_name(spark, d):
    x = docs(spark, d).withColumns({
        "players": F.array("lang", "source"), "teams": F.array("lang"), "storyline": F.col("source"), "document_type": F.col("source")})
    return rt.filter_docs(x, any_names=["EN", "Fr"], name_part="C1", any_teams=["En", "DE"], kind="SRC1", storyline="Src1").select("doc_id")


_STOP = ", ".join(f"'{w}'" for w in rt.STOP_WORDS)
_TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"


def bm25(name: str, source: str, k: int) -> str:
    """The same ranking written out in SQL, over the rows of a named source."""
    return f"""
{name}_q AS (SELECT item_id AS query_id, list_distinct({_TOK.format("text")}) AS ws FROM benchmark),
{name}_qt AS (SELECT query_id, unnest(CASE WHEN len(list_filter(ws, lambda x: x NOT IN ({_STOP}))) > 0
    THEN list_filter(ws, lambda x: x NOT IN ({_STOP})) ELSE ws END) AS term FROM {name}_q),
{name}_t AS (SELECT doc_id, unnest({_TOK.format("source")}) AS term, 5.0::DOUBLE AS w FROM {source}
  UNION ALL SELECT doc_id, unnest({_TOK.format("text")}), 1.0 FROM {source}),
{name}_len AS (SELECT doc_id, len({_TOK.format("source")}) + len({_TOK.format("text")}) AS len FROM {source}),
{name}_n AS (SELECT count(*) AS n, avg(len) AS al FROM {name}_len),
{name}_p AS (SELECT term, doc_id, sum(w) AS tf FROM {name}_t WHERE term IN (SELECT term FROM {name}_qt) GROUP BY term, doc_id),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / al))), 6) AS score
  FROM {name}_p JOIN {name}_df USING (term) JOIN {name}_qt USING (term) JOIN {name}_len USING (doc_id), {name}_n GROUP BY query_id, doc_id),
{name} AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {name}_s
  QUALIFY rank <= {k})"""


ENGLISH = "english AS (SELECT * FROM docs WHERE lang = 'en' AND is_active)"


def hit_lists(spark, d, k, *names):
    """Keyword hits among all documents and among active English ones, from one pass over the documents."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    lists = {"all": None, "english": (F.col("lang") == "en") & F.col("is_active")}
    return rt.keyword_lists(docs(spark, d), "doc_id", {"title": F.col("source"), "content": F.col("text")}, q, "query_id", "q", k,
                            {n: lists[n] for n in names})


def hits(spark, d, k):
    return hit_lists(spark, d, k, "all")["all"]


@query("R2_keyword_search", f"WITH {DOCS}, {bm25('a', 'docs', 10)} SELECT * FROM a")
def keyword(spark, d):
    return hits(spark, d, 10)


@query("R2_keyword_search_bounded", f"WITH {DOCS}, {bm25('a', 'docs', 10)} SELECT * FROM a")
def keyword_bounded(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    return rt.keyword_search_bounded(docs(spark, d), "doc_id", {"title": F.col("source"), "content": F.col("text")}, q, "query_id", "q", 10)


CENTROIDS = """parts AS (SELECT label, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings),
dims AS (SELECT label, i, avg(v) AS v FROM parts GROUP BY label, i),
centroids AS (SELECT label AS query_id, list(v ORDER BY i) AS q FROM dims GROUP BY label),
scored AS (SELECT query_id, vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, centroids),
vec AS (SELECT query_id::BIGINT AS query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
  FROM scored QUALIFY rank <= 20)"""


def vector_hits(spark, d, threshold=None):
    """Every label's mean vector against all vectors."""
    e = table(spark, d, "embeddings")
    dims = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    # As many entries per label as the vectors have dimensions.
    q = dims.groupBy(F.col("label").alias("query_id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("q"))
    # The model of a vector is known by its dimension.
    model = lambda c: F.concat(F.lit("d"), F.size(c).cast("string")).alias("model")
    return rt.vector_search(e.select(F.col("vec_id").alias("doc_id"), "embedding", model("embedding")), "doc_id", "embedding",
                            q.select("query_id", "q", model("q")), "query_id", "q", 20, threshold=threshold)


@query("R3_vector_search", f"WITH {CENTROIDS} SELECT * FROM vec")
def vector(spark, d):
    return vector_hits(spark, d)


@query("R3_vector_search_threshold", f"WITH {CENTROIDS} SELECT * FROM vec WHERE score >= 0.2")
def vector_threshold(spark, d):
    return vector_hits(spark, d, 0.2)


@query("R3_vector_search_lsh", """
WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round(list_cosine_similarity(d.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings d)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= 0.9 QUALIFY rank <= 20""")
def vector_lsh(spark, d):
    """Every vector's near neighbours, itself among them, among all vectors of its model."""
    e = table(spark, d, "embeddings").withColumn("model", F.concat(F.lit("d"), F.size("embedding").cast("string")))
    docs_ = e.select(F.col("vec_id").alias("doc_id"), "embedding", "model")
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "model")
    return lsh.vector_search_lsh(docs_, "doc_id", "embedding", asked, "query_id", "q", 20, threshold=0.9)


@query("R4_rank_fusion", f"""
WITH {DOCS}, {ENGLISH}, {bm25('a', 'docs', 20)}, {bm25('b', 'english', 20)},
f AS (SELECT query_id, doc_id, round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score,
        a.rank AS all_rank, b.rank AS english_rank FROM a FULL JOIN b USING (query_id, doc_id))
SELECT query_id, doc_id, score, all_rank, english_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, published_at DESC, doc_id) AS rank
FROM f JOIN docs USING (doc_id) QUALIFY rank <= 5""")
def fusion(spark, d):
    n = rt.pool_size(5)
    return rt.rrf(hit_lists(spark, d, n, "all", "english"), "query_id", "doc_id", docs(spark, d), 5)


@query("R5_recent_docs", """
SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events QUALIFY place <= 10""")
def recent(spark, d):
    return rt.recent_docs(table(spark, d, "events"), "user_id", "event_id", "ts", 10, ["event_type"]).withColumn(
        "ts", F.col("ts").cast("timestamp"))


@query("R5_mentions_in_order", """
WITH m AS (SELECT l_orderkey, l_partkey, min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 3 END) AS o FROM lineitem GROUP BY ALL)
SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY o, l_partkey) AS ids FROM m GROUP BY l_orderkey""")
def mention_order(spark, d):
    role = F.expr("CASE l_returnflag WHEN 'A' THEN 'primary_subject' WHEN 'N' THEN 'mentioned' ELSE 'other' END")
    order = F.expr("CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 ELSE 3 END")
    m = table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min_by(role, order).alias("role"))
    lists = m.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("player_id"), "role")).alias("m"))
    return lists.select("l_orderkey", F.array_join(rt.mentions_in_order(F.col("m")), ",").alias("ids"))


@query("R6_newest_first", f"""
WITH {DOCS}, {bm25('a', 'docs', 10)} SELECT query_id, doc_id, published_at, score,
  row_number() OVER (PARTITION BY query_id ORDER BY published_at DESC, score DESC, doc_id) AS place FROM a JOIN docs USING (doc_id)""")
def newest(spark, d):
    h = hits(spark, d, 10).join(docs(spark, d).select("doc_id", "published_at"), "doc_id")
    return rt.newest_first(h, "query_id", "doc_id", "published_at", "score").drop("rank")


@query("R7_merge_branches", f"""
WITH {DOCS}, {ENGLISH}, {bm25('a', 'docs', 8)}, {bm25('b', 'english', 8)},
u AS (SELECT 0 AS branch, * FROM a UNION ALL SELECT 1, * FROM b),
o AS (SELECT query_id, doc_id, max(score) AS score, string_agg(DISTINCT branch::VARCHAR, ',' ORDER BY branch::VARCHAR) AS branches,
   min((CASE WHEN rank = 1 THEN 0 ELSE 1 END, CASE WHEN rank = 1 THEN branch ELSE -1 END, CASE WHEN rank = 1 THEN 0 ELSE -score END, branch, rank)) AS key FROM u GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, branches, row_number() OVER (PARTITION BY query_id ORDER BY key) AS place FROM o QUALIFY place <= 10""")
def branches(spark, d):
    lists = hit_lists(spark, d, 8, "all", "english")
    u = lists["all"].withColumn("branch", F.lit(0)).unionByName(lists["english"].withColumn("branch", F.lit(1)))
    return rt.merge_branches(u, "query_id", "branch", "doc_id", "score", 10).withColumn("branches", F.array_join("branches", ","))


@query("R8_demote_negative", f"""
WITH {DOCS}, {bm25('a', 'docs', 10)}, f AS (SELECT query_id, doc_id, rank, lang = 'de' AND source <> 'src1' AS demoted FROM a JOIN docs USING (doc_id))
SELECT query_id, doc_id, demoted, row_number() OVER (PARTITION BY query_id ORDER BY demoted, rank) AS new_place FROM f""")
def demote(spark, d):
    h = hits(spark, d, 10).join(docs(spark, d).select("doc_id", F.array("lang", F.upper("source")).alias("names")), "doc_id")
    h = h.withColumns({"neg": F.array(F.lit("DE")), "pos": F.array(F.lit("src1"))})
    return rt.demote_negative(h, "query_id", "rank", "names", "neg", "pos").select("query_id", "doc_id", "demoted", "new_place")


# Judgments: labels and lengths of the hit documents; a copy is redundant with the first hit of its text.
JUDGED = f"""{bm25('a', 'docs', 30)}, h AS (
  SELECT query_id, doc_id, rank, published_at, lang, (n_chars % 101)::BIGINT AS score,
    CASE WHEN NOT is_active THEN 'irrelevant' WHEN toxic = 1 THEN 'contradictory' WHEN n_chars % 3 = 0 THEN 'supporting_context' ELSE 'direct' END AS relation,
    CASE WHEN n_chars % 2 = 0 THEN 'current' ELSE 'baseline' END AS role,
    min(doc_id) OVER (PARTITION BY query_id, sha256(text)) AS first_copy FROM a JOIN docs USING (doc_id)),
j AS (SELECT *, CASE WHEN first_copy <> doc_id THEN first_copy END AS redundant_with,
  score + CASE relation WHEN 'direct' THEN 8 WHEN 'contradictory' THEN 5 WHEN 'supporting_context' THEN 2 ELSE -40 END AS adjusted FROM h)"""


def judged(spark, d):
    x = docs(spark, d).select("doc_id", "published_at", "lang", "n_chars", "is_active", "toxic", F.sha2("text", 256).alias("hash"))
    h = hits(spark, d, 30).drop("score").join(x, "doc_id")
    first = h.groupBy("query_id", "hash").agg(F.min("doc_id").alias("first_copy"))
    j = h.join(first, ["query_id", "hash"]).select(
        "query_id", "doc_id", "rank", "published_at", F.array("lang").alias("names"), (F.col("n_chars") % 101).alias("score"),
        F.when(~F.col("is_active"), "irrelevant").when(F.col("toxic") == 1, "contradictory")
        .when(F.col("n_chars") % 3 == 0, "supporting_context").otherwise("direct").alias("relation"),
        F.when(F.col("n_chars") % 2 == 0, "current").otherwise("baseline").alias("role"),
        F.when(F.col("first_copy") != F.col("doc_id"), F.col("first_copy")).alias("redundant_with"))
    keys = ["query_id", "doc_id"]
    return j.select(*keys, "rank", "published_at", "names"), j.select(*keys, "score", "relation", "role", "redundant_with")


@query("R9_compose_best", f"""
WITH {DOCS}, {JUDGED}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, rank) AS ord FROM j WHERE relation <> 'irrelevant'),
k AS (SELECT o.* FROM o LEFT JOIN o c ON c.query_id = o.query_id AND c.doc_id = o.redundant_with AND c.ord < o.ord WHERE c.doc_id IS NULL)
SELECT query_id, doc_id, adjusted, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS place FROM k QUALIFY place <= 8""")
def compose(spark, d):
    h, j = judged(spark, d)
    return rt.adjust_and_compose(h, j, "query_id", "doc_id", 8)


@query("R9_compose_latest", f"""
WITH {DOCS}, {JUDGED}, w AS (SELECT * REPLACE (adjusted + CASE role WHEN 'current' THEN 6 ELSE -4 END AS adjusted) FROM j),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, published_at DESC, rank) AS ord FROM w WHERE relation <> 'irrelevant'),
k AS (SELECT o.* FROM o LEFT JOIN o c ON c.query_id = o.query_id AND c.doc_id = o.redundant_with AND c.ord < o.ord WHERE c.doc_id IS NULL)
SELECT query_id, doc_id, adjusted, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS place FROM k QUALIFY place <= 8""")
def compose_latest(spark, d):
    h, j = judged(spark, d)
    return rt.adjust_and_compose(h, j, "query_id", "doc_id", 8, latest=True)


@query("R9_compose_timeline")
def compose_timeline(spark, d):
    h, j = judged(spark, d)
    return rt.adjust_and_compose(h, j, "query_id", "doc_id", 6, strategy="timeline")


@query("R9_compose_per_entity")
def compose_entities(spark, d):
    h, j = judged(spark, d)
    langs = F.explode(F.lit(["en", "fr", "de"]))
    e = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), langs.alias("entity")).withColumn(
        "priority", F.array_position(F.lit(["en", "fr", "de"]), F.col("entity")))
    return rt.adjust_and_compose(h, j, "query_id", "doc_id", 6, strategy="per_entity", entities=e)


@query("R10_evidence_gate", f"""
WITH {DOCS}, {JUDGED}, e AS (SELECT query_id, count(*) AS n FROM j WHERE relation = 'direct' GROUP BY query_id),
q AS (SELECT item_id AS query_id, CASE WHEN length(text) < 200 THEN 'weak' WHEN length(text) < 400 THEN 'partial' ELSE 'sufficient' END AS s FROM benchmark)
SELECT query_id, CASE WHEN s = 'weak' OR coalesce(n, 0) = 0 THEN 'no_evidence' WHEN s = 'partial' THEN 'partial' ELSE 'ready' END AS status,
  CASE WHEN s = 'weak' THEN 0 ELSE coalesce(n, 0) END AS n_evidence FROM q LEFT JOIN e USING (query_id)""")
def gate(spark, d):
    n = F.length("text")
    q = table(spark, d, "benchmark").select(
        F.col("item_id").alias("query_id"), F.when(n < 200, "weak").when(n < 400, "partial").otherwise("sufficient").alias("s"))
    return rt.evidence_gate(q, "query_id", "s", judged(spark, d)[1].filter("relation = 'direct'"))


@query("R11_judgment_contract", f"""
WITH {DOCS}, {JUDGED}, g AS (SELECT query_id, doc_id + CASE WHEN lang = 'es' THEN 5000000 ELSE 0 END AS doc_id, score + CASE WHEN lang = 'fr' THEN 40 ELSE 0 END AS score, redundant_with FROM j)
SELECT query_id, doc_id, 'candidate not judged' AS rule FROM j WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM g)
UNION ALL SELECT query_id, doc_id, 'judged but no candidate' FROM g WHERE (query_id, doc_id) NOT IN (SELECT query_id, doc_id FROM j)
UNION ALL SELECT query_id, doc_id, 'score out of range' FROM g WHERE NOT score BETWEEN 0 AND 100
UNION ALL SELECT query_id, doc_id, 'redundant target not valid' FROM g WHERE redundant_with IS NOT NULL AND (query_id, redundant_with) NOT IN (SELECT query_id, doc_id FROM j)""")
def judging(spark, d):
    h, j = judged(spark, d)
    lang = docs(spark, d).select("doc_id", "lang")
    g = j.join(lang, "doc_id").select(
        "query_id", (F.col("doc_id") + F.when(F.col("lang") == "es", 5000000).otherwise(0)).alias("doc_id"),
        (F.col("score") + F.when(F.col("lang") == "fr", 40).otherwise(0)).alias("score"), "redundant_with")
    return rt.judgment_contract(h, g, "query_id", "doc_id")


@query("A16_hit_at_k", f"""
WITH {DOCS}, {ENGLISH}, {bm25('a', 'docs', 3)}, {bm25('b', 'english', 2)}
SELECT query_id, EXISTS (SELECT 1 FROM a JOIN b b2 USING (query_id, doc_id) WHERE a.query_id = c.query_id) AS passed FROM (SELECT DISTINCT query_id FROM b) c""")
def hit_rate(spark, d):
    from ..operators.aggregates import hit_at_k

    lists = hit_lists(spark, d, 10, "all", "english")
    cases = lists["english"].filter("rank <= 2").groupBy("query_id").agg(F.collect_list("doc_id").alias("expected"))
    return hit_at_k(lists["all"], cases, 3)


@query("R16_needs_embedding", f"""
WITH {FEED}, {STORED}, e AS (SELECT doc_id, hash FROM stored WHERE toxic = 0), x AS (SELECT f.doc_id, e.doc_id IS NOT NULL AS reused FROM feed f LEFT JOIN e ON e.doc_id = f.doc_id AND e.hash = f.hash)
SELECT doc_id, (SELECT count(*) FROM x WHERE NOT reused) AS n_new, (SELECT count(*) FROM x WHERE reused) AS n_reused FROM x WHERE NOT reused""")
def embed(spark, d):
    chunks = feed_docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("hash").alias("content_hash"))
    have = stored_docs(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("hash").alias("content_hash"),
                                        F.when(F.col("toxic") == 0, "m1").otherwise("m0").alias("embedding_model"))
    rows, counts = rt.needs_embedding(chunks, have, F.lit("m1"))
    return rows.select(F.col("chunk_id").alias("doc_id")).withColumns(
        {c: counts.select(c).scalar() for c in ("n_new", "n_reused")})
