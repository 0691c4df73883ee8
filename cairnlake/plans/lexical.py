"""Queries on duplicates, the lexical index and BM25."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnlake.functions.text import family_key, jaccard, round_to, word_sequence, words
from cairnlake.operators import dedupe as dd
from cairnlake.operators import lexical as lx
from cairnlake.plans.registry import Plan
from cairnlake.session import read_table as t
from cairnlake.session import written

WORDS_SQL = r"list_distinct(list_concat(list_filter(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) BETWEEN 2 AND 128), list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) BETWEEN 2 AND 64)))"
LEN_SQL = r"greatest(len(regexp_extract_all({0}, '[\p{{L}}\p{{N}}]')), 1)"
KEYWORDS = ["the", "ing", "license", "token", "stone"]
MAPPING = [("the", "THE"), ("ing", "ING"), ("tion", "TION"), ("er", "ER"), ("an", "AN")]
PASSAGE_SQL = r"regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '\\([#*_])', '\1', 'g'), '\s+', '', 'g')"


def _chunks(s, d):
    return t(s, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("kb_id"), "text")


def _queries(s, d):
    return t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


BM25_SQL = f"""
WITH ch AS MATERIALIZED (SELECT doc_id AS chunk_id, {LEN_SQL.format("text")} AS len, {WORDS_SQL.format("text")} AS ws FROM documents),
q AS (SELECT query_id, ws[i] AS term FROM (SELECT query_id, ws, unnest(range(1, least(len(ws), 256) + 1)) AS i FROM (SELECT item_id AS query_id, {WORDS_SQL.format("text")} AS ws FROM benchmark))),
tot AS (SELECT greatest(count(*), 1)::DOUBLE AS n, greatest(sum(len) / greatest(count(*), 1)::DOUBLE, 1.0) AS avgdl FROM ch),
post AS (SELECT chunk_id, len, unnest(ws) AS term FROM ch),
df AS (SELECT term, count(*)::DOUBLE AS df FROM post WHERE term IN (SELECT term FROM q) GROUP BY term),
tm AS (SELECT q.query_id, q.term, coalesce(df.df, 0) AS df, n, avgdl, coalesce(df.df, 0) >= 1 AND coalesce(df.df, 0) <= greatest(0.5 * n, 1) AS telling FROM q LEFT JOIN df USING (term) CROSS JOIN tot),
w AS (SELECT *, bool_or(telling) OVER (PARTITION BY query_id) AS any_telling, min(CASE WHEN telling THEN df END) OVER (PARTITION BY query_id) AS rarest FROM tm),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS nth, sum(df) OVER (PARTITION BY query_id ORDER BY df, term ROWS UNBOUNDED PRECEDING) AS running
      FROM w WHERE (telling OR NOT any_telling) AND coalesce(rarest, 0) <= greatest(0.3 * n, 1)),
s AS (SELECT query_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * len / avgdl))) AS score
      FROM k JOIN post USING (term) WHERE running <= 8000 OR nth <= 1 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10
"""


def _postings(s, d):
    return lx.postings(_chunks(s, d), ["kb_id", "chunk_id"])


def _bm25(s, d):
    found = lx.bm25_search(_chunks(s, d), _queries(s, d))
    return found.select("query_id", "chunk_id", round_to(F.col("score")).alias("score"), "rank")


def _cover(s, d, terms, all_terms):
    """Each benchmark item's rarest terms among all documents, and the documents that hold them most densely. Frequencies come first, so
    that positions are kept of the rarest terms alone."""
    asked = _queries(s, d).select("query_id", F.explode(F.array_distinct(word_sequence("text"))).alias("term"))
    held = _chunks(s, d).select(F.explode(F.array_distinct(word_sequence("text"))).alias("term"))
    stats = held.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rarest = written(lx.rarest_terms(asked, stats, terms), "rarest")
    density = lx.cover_density(lx.positional_postings(_chunks(s, d), ["chunk_id"], terms=rarest), rarest, ["chunk_id"], all_terms)
    return lx.density_window(density, 20, ["chunk_id"]).withColumn("density", round_to(F.col("density"), 9))


#: Words at their positions, those of benchmark items, and each item's two rarest.
COVER_SQL = r"""WITH w AS (SELECT doc_id AS chunk_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) BETWEEN 2 AND 128) AS ws FROM documents),
p AS MATERIALIZED (SELECT chunk_id, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS pos FROM w),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) BETWEEN 2 AND 128)) AS term FROM benchmark),
df AS (SELECT term, count(DISTINCT chunk_id) AS df FROM p WHERE term IN (SELECT term FROM q) GROUP BY term),
k AS MATERIALIZED (SELECT query_id, term, nth, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY df, term) AS nth FROM q JOIN df USING (term)) WHERE nth <= {0}),
o AS MATERIALIZED (SELECT query_id, chunk_id, nth, n, pos, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS place FROM k JOIN p USING (term)),
"""
COVER_ALL_SQL = (
    COVER_SQL.replace("{0}", "2")
    + """e AS (SELECT *, greatest(min(CASE WHEN nth = 1 THEN pos END) OVER f, CASE WHEN n = 2 THEN min(CASE WHEN nth = 2 THEN pos END) OVER f ELSE pos END) AS stop, n = 1 OR min(CASE WHEN nth = 2 THEN pos END) OVER f IS NOT NULL AND min(CASE WHEN nth = 1 THEN pos END) OVER f IS NOT NULL AS whole
 FROM o WINDOW f AS (PARTITION BY query_id, chunk_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
c AS (SELECT query_id, chunk_id, any_value(n) AS n, stop, max(pos) AS start FROM e WHERE whole GROUP BY query_id, chunk_id, stop),
s AS (SELECT c.query_id, c.chunk_id, any_value(c.n) AS matched, 0.1::DOUBLE * sum(1.0::DOUBLE / (1 + (c.stop - c.start) - (b.place - a.place))) AS density FROM c JOIN o a ON a.query_id = c.query_id AND a.chunk_id = c.chunk_id AND a.pos = c.start JOIN o b ON b.query_id = c.query_id AND b.chunk_id = c.chunk_id AND b.pos = c.stop GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(density, 9) DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, matched, round(density, 9) AS density, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20"""
)
COVER_ANY_SQL = (
    COVER_SQL.replace("{0}", "5")
    + """s AS (SELECT query_id, chunk_id, count(DISTINCT nth) AS matched, 0.1::DOUBLE * count(*) AS density FROM o GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(density, 9) DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, matched, round(density, 9) AS density, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20"""
)


def _near(s, d):
    prints = dd.with_simhash(t(s, d, "documents"), "doc_id", "text", ["source"])
    return dd.near_pairs(prints, "doc_id", ["source"])


def _delta(s, d):
    docs = _chunks(s, d)
    old, new = (lx.postings(docs.where(w), ["kb_id", "chunk_id"]) for w in ("chunk_id % 5 <> 0", "chunk_id % 5 <> 1"))
    return lx.df_delta(old, new, ["kb_id"])


def _applied(s, d):
    docs = _chunks(s, d)
    old, new = (lx.postings(docs.where(w), ["kb_id", "chunk_id"]) for w in ("chunk_id % 5 <> 0", "chunk_id % 5 <> 1"))
    return lx.apply_delta(lx.term_stats(old, ["kb_id"]), lx.df_delta(old, new, ["kb_id"]), ["kb_id"])


def _with_next(s, d):
    """Every document's term set is made once and then compared with the next one's."""
    own = t(s, d, "documents").select("doc_id", words("text").alias("a"))
    after = t(s, d, "documents").select((F.col("doc_id") - 1).alias("doc_id"), words("text").alias("b"))
    return own.join(after, "doc_id").select("doc_id", round_to(jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


#: Fingerprints by hand: each token's polynomial modulo 2**64 from its characters, then 64 counts of set bits.
PRINTS_SQL = """k AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[a-z0-9]{2,}')) AS w FROM documents),
h AS (SELECT doc_id, source, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(range(1, length(w) + 1), lambda i: CAST(ord(w[i:i]) AS HUGEINT))), lambda a, c: (a * 131 + c) % 18446744073709551616) AS UBIGINT) AS x FROM k),
v AS (SELECT doc_id, source, count(*) AS n, """ + ", ".join(f"sum((x >> {b}) & 1) AS b{b}" for b in range(64)) + """ FROM h GROUP BY ALL),
sums AS (SELECT doc_id, source, n, """ + " + ".join(f"CASE WHEN 2 * b{b} > n THEN {1 << b}::HUGEINT ELSE 0 END" for b in range(64)) + """ AS x FROM v),
prints AS (SELECT doc_id, d.source, coalesce(n, 0) AS n, CAST(CASE WHEN x >= 9223372036854775808 THEN x - 18446744073709551616 ELSE coalesce(x, 0) END AS BIGINT) AS simhash FROM documents d LEFT JOIN sums USING (doc_id))"""
_KEPT = [k.lower() for k in KEYWORDS if len(k) >= 2]
POOL_SQL = (
    r"WITH r AS (SELECT doc_id AS id, greatest(length(text), 1) AS len, lower(text) AS low, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents), "
    + "c AS (SELECT id, len, " + ", ".join(f"contains(low, '{k}') AS p{i}, len(list_filter(ws, lambda w: w = '{k}')) AS f{i}" for i, k in enumerate(_KEPT)) + " FROM r), "
    + "s AS (SELECT count(*) AS n, avg(len) AS mean, " + ", ".join(f"count(*) FILTER (p{i}) AS d{i}" for i in range(len(_KEPT))) + " FROM c), "
    + "o AS (SELECT id, " + " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (1 - 0.75 + 0.75 * len / mean))" for i in range(len(_KEPT))) + " AS score FROM c, s) "
    + "SELECT id, round(score, 6) AS score FROM o WHERE score > 0"
)


PLANS = [
    Plan("lx_bm25_search", _bm25, BM25_SQL),
    Plan(
        "dd1_exact_dedupe",
        lambda s, d: dd.first_by_hash(t(s, d, "documents").select("doc_id", "source", "text"), ["source"], "text", ["doc_id"]).select("doc_id", "source", "content_hash", "copies", "is_first"),
        "SELECT doc_id, source, sha256(coalesce(text, '')) AS content_hash, count(*) OVER w AS copies, doc_id = min(doc_id) OVER w AS is_first FROM documents WINDOW w AS (PARTITION BY source, sha256(coalesce(text, '')))",
    ),
    Plan("dd2_simhash", lambda s, d: dd.with_simhash(t(s, d, "documents"), "doc_id", "text", ["source"]), f"WITH {PRINTS_SQL} SELECT doc_id, source, CAST(n AS INTEGER) AS n_tokens, simhash FROM prints"),
    Plan(
        "dd4_near_pairs",
        _near,
        f"""WITH {PRINTS_SQL}, u AS (SELECT source, simhash, min(doc_id) AS id FROM prints WHERE n >= 200 GROUP BY ALL)
SELECT source, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance FROM u a JOIN u b USING (source) WHERE a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3""",
    ),
    Plan(
        "dd5_distinct_passages",
        lambda s, d: dd.distinct_passages(t(s, d, "documents").select("doc_id", "source", "text"), ["source"], [F.col("doc_id")]).select("doc_id", "source", "evidence_id"),
        f"""WITH e AS (SELECT doc_id, source, {PASSAGE_SQL} AS raw FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY source, raw ORDER BY doc_id) AS nth FROM e WHERE raw <> '')
SELECT doc_id, source, sha256(raw) AS evidence_id FROM n WHERE nth = 1""",
    ),
    Plan(
        "dd6_embedding_reuse",
        lambda s, d: dd.reuse_embeddings(
            t(s, d, "documents").where("doc_id % 2 = 0").select(F.md5(F.col("text").cast("binary")).alias("md5"), F.lit("m1").alias("fp")),
            t(s, d, "documents").where("doc_id % 2 = 1").select(F.md5(F.col("text").cast("binary")).alias("md5"), F.lit("m1").alias("fp")),
            ["md5", "fp"],
        ),
        "WITH a AS (SELECT DISTINCT md5(text) AS md5, 'm1' AS fp FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT md5(text) AS md5 FROM documents WHERE doc_id % 2 = 1) SELECT a.md5, a.fp, b.md5 IS NOT NULL AS reused FROM a LEFT JOIN b USING (md5)",
    ),
    Plan(
        "dd7_jaccard_with_next",
        _with_next,
        f"""WITH w AS (SELECT doc_id, {WORDS_SQL.format("text")} AS ws FROM documents), p AS (SELECT a.doc_id, len(a.ws) AS na, len(b.ws) AS nb, len(list_intersect(a.ws, b.ws)) AS n FROM w a JOIN w b ON a.doc_id + 1 = b.doc_id)
SELECT doc_id, round(CASE WHEN na = 0 OR nb = 0 THEN 0.0 ELSE n / (na + nb - n) END, 6) AS jaccard FROM p""",
    ),
    Plan("dd10_md5_sample", lambda s, d: dd.sample_by_md5(t(s, d, "documents"), "doc_id", 50).select("doc_id", "source"), "SELECT doc_id, source FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50"),
    Plan("lx1_postings", _postings, f"SELECT source AS kb_id, doc_id AS chunk_id, unnest({WORDS_SQL.format('text')}) AS term, 1 AS tf FROM documents"),
    Plan("lx2_normalized_terms", lambda s, d: t(s, d, "documents").select("doc_id", F.md5(lx.normalize_term("text").cast("binary")).alias("terms_md5"))),
    Plan("lx3_lexical_length", lambda s, d: t(s, d, "documents").select("doc_id", lx.lexical_length("text").alias("len")), f"SELECT doc_id, {LEN_SQL.format('text')} AS len FROM documents"),
    Plan(
        "lx4_term_stats",
        lambda s, d: lx.term_stats(_postings(s, d), ["kb_id"]),
        f"SELECT kb_id, term, count(*) AS df FROM (SELECT source AS kb_id, unnest({WORDS_SQL.format('text')}) AS term FROM documents) GROUP BY ALL",
    ),
    Plan(
        "lx5_corpus_stats",
        lambda s, d: lx.corpus_stats(_chunks(s, d), ["kb_id"]).withColumn("avgdl", round_to(F.col("avgdl"))),
        f"SELECT source AS kb_id, count(*) AS n, CAST(sum({LEN_SQL.format('text')}) AS BIGINT) AS total_len, round(greatest(sum({LEN_SQL.format('text')}) / count(*), 1.0), 6) AS avgdl FROM documents GROUP BY 1",
    ),
    Plan(
        "lx6_df_delta",
        _delta,
        f"""WITH p AS (SELECT source AS kb_id, doc_id, unnest({WORDS_SQL.format('text')}) AS term FROM documents), c AS (SELECT kb_id, term, count(*) FILTER (doc_id % 5 <> 1) - count(*) FILTER (doc_id % 5 <> 0) AS delta FROM p GROUP BY ALL)
SELECT * FROM c WHERE delta <> 0""",
    ),
    Plan("lx7_stats_after_delta", _applied, f"SELECT source AS kb_id, term, count(*) AS df FROM (SELECT source, unnest({WORDS_SQL.format('text')}) AS term FROM documents WHERE doc_id % 5 <> 1) GROUP BY ALL"),
    Plan("lx10_cover_density", lambda s, d: _cover(s, d, 2, True), COVER_ALL_SQL),
    Plan("lx10_occurrences", lambda s, d: _cover(s, d, 5, False), COVER_ANY_SQL),
    Plan("lx11_pool_bm25", lambda s, d: lx.pool_bm25(t(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), KEYWORDS).withColumn("score", round_to(F.col("score"))), POOL_SQL),
    Plan(
        "lx12_index_health",
        lambda s, d: lx.index_health(_chunks(s, d), lx.postings(_chunks(s, d).where("chunk_id % 3 > 0"), ["kb_id", "chunk_id"]), ["kb_id"]),
        f"WITH c AS (SELECT source AS kb_id, count(*) AS chunks, count(*) FILTER (doc_id % 3 > 0 AND len({WORDS_SQL.format('text')}) > 0) AS indexed FROM documents GROUP BY 1) SELECT *, round(indexed / chunks, 6) AS coverage FROM c",
    ),
    Plan(
        "lx13_keyword_recall",
        lambda s, d: lx.keyword_recall(_chunks(s, d), KEYWORDS, 40).select("keyword", "chunk_id", "nth"),
        f"WITH h AS (SELECT k AS keyword, doc_id AS chunk_id, CAST(row_number() OVER (PARTITION BY k ORDER BY doc_id) AS INTEGER) AS nth FROM documents, unnest({KEYWORDS}) AS u(k) WHERE contains(lower(text), k)) SELECT * FROM h WHERE nth <= 40",
    ),
    Plan(
        "lx14_title_affinity",
        lambda s, d: lx.title_affinity(t(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), ["a", "st", "1"], "part 1").withColumn("matched", F.col("matched").cast("int")),
        """WITH h AS (SELECT p_partkey AS id, p_name AS title, regexp_replace(lower(p_name), '\\.[a-z0-9]+$', '') = 'part 1' AS exact, contains(lower(p_name), 'a')::INT + contains(lower(p_name), 'st')::INT + contains(lower(p_name), '1')::INT AS matched FROM part)
SELECT * FROM h WHERE matched > 0 ORDER BY exact DESC, matched DESC, length(title), id LIMIT 20""",
    ),
    Plan(
        "lx16_expand_terms",
        lambda s, d: lx.expand_terms(_queries(s, d), MAPPING),
        "WITH m(plain, formal) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in MAPPING) + """), f AS (SELECT item_id AS query_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY plain) AS INTEGER) AS nth, replace(text, plain, formal) AS variant FROM benchmark JOIN m ON contains(text, plain))
SELECT * FROM f WHERE nth <= 4""",
    ),
    Plan(
        "lx17_similar_names",
        lambda s, d: lx.similar_names(*(t(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name")),) * 2, 0.85).withColumn("similarity", round_to(F.col("similarity"))),
        """WITH g AS (SELECT p_partkey AS id, list_distinct([substr(s, i, 3) FOR i IN range(1, length(s) - 1)]) AS g FROM (SELECT p_partkey, '  ' || lower(p_name || ' ' || p_brand || ' ' || p_type) || ' ' AS s FROM part)),
u AS (SELECT id, len(g) AS n, unnest(g) AS x FROM g), p AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n, any_value(a.n + b.n) AS m FROM u a JOIN u b USING (x) WHERE a.id <> b.id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) GROUP BY ALL)
SELECT id_a, id_b, round(n / (m - n), 6) AS similarity FROM p WHERE n / (m - n) >= 0.85""",
    ),
    Plan("lx18_phrases", lambda s, d: t(s, d, "documents").select("doc_id", F.explode(lx.phrases("text")).alias("phrase")), r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\p{Lu}[\p{L}\p{N}''-]+(?:\s+\p{Lu}[\p{L}\p{N}''-]+){1,6}')) AS phrase FROM documents"),
    Plan(
        "tm6_family_key",
        lambda s, d: t(s, d, "part").select("p_partkey", family_key(F.concat("p_name", F.lit(" v2.1.pdf"))).alias("family")),
        "SELECT p_partkey, regexp_replace(regexp_replace(p_name, '[(_\\-\\s]*[vV]\\d+(?:\\.\\d+)*[)\\]_\\-\\s]*', '', 'g'), '\\s+', '', 'g') AS family FROM (SELECT p_partkey, regexp_replace(p_name || ' v2.1', 'zzz', '') AS p_name FROM part)",
    ),
]
