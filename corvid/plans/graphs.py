"""Text units, their graph, chunks and expansion."""

from pyspark.sql import functions as F

from corvid.config import GraphConfig
from corvid.functions import text as T
from corvid.operators import chunking, graph, vector
from corvid.plans.catalog import Tables, query
from corvid.functions.text import STOPWORDS

SENT = r"list_filter(list_transform(string_split(regexp_replace(s, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')"
UNITS = rf"""seg AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, unnest(string_split(text, chr(10))) AS s0, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS seg FROM documents),
seg2 AS (SELECT document_id, seg, trim(s0) AS s FROM seg WHERE trim(s0) <> ''), parts AS (SELECT document_id, seg, s, {SENT} AS parts FROM seg2),
flat AS (SELECT document_id, seg, length(s) > 400 AND len(parts) > 1 AS many, CASE WHEN length(s) > 400 AND len(parts) > 1 THEN parts ELSE [s] END AS a FROM parts),
each AS (SELECT document_id, seg, many, unnest(a) AS text, unnest(generate_series(1, len(a))) AS pos FROM flat),
u AS (SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY seg, pos) - 1 AS INTEGER) AS idx, text, CASE WHEN many THEN 'sentence' ELSE 'paragraph' END AS unit_type FROM each),
units AS (SELECT document_id, document_id || '_unit_' || CAST(idx AS VARCHAR) AS unit_id, idx, text, unit_type FROM u)"""
STOP = "(" + ", ".join(f"'{w}'" for w in sorted(set(STOPWORDS))) + ")"
KEYWORDS = rf"""kt AS (SELECT document_id, unit_id, list_filter(regexp_extract_all(lower(text), '[a-zA-Z0-9à-ỹÀ-Ỹ]{{4,}}'), lambda w: w NOT IN {STOP}) AS a FROM units),
kw AS (SELECT document_id, unit_id, unnest(a) AS word, unnest(generate_series(1, len(a))) AS pos FROM kt), kc AS (SELECT document_id, unit_id, word, count(*) AS count, min(pos) AS first FROM kw GROUP BY ALL),
kr AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY count DESC, length(word) DESC, first) AS rank FROM kc), keywords AS (SELECT * FROM kr WHERE rank <= 12)"""
STRUCT = "nx AS (SELECT document_id, unit_id AS a, lead(unit_id) OVER (PARTITION BY document_id ORDER BY idx) AS b FROM units), structural AS (SELECT document_id, a AS src, b AS dst, 'structural' AS edge_type, 1.0 AS weight FROM nx WHERE b IS NOT NULL UNION ALL SELECT document_id, b, a, 'structural', 1.0 FROM nx WHERE b IS NOT NULL), hierarchical AS (SELECT document_id, a AS src, b AS dst, 'hierarchical' AS edge_type, 0.5 AS weight FROM nx WHERE b IS NOT NULL)"
KEDGES = "ks AS (SELECT a.document_id, a.unit_id AS src, b.unit_id AS dst, count(*) AS shared FROM keywords a JOIN keywords b ON a.document_id = b.document_id AND a.word = b.word AND a.unit_id <> b.unit_id GROUP BY ALL HAVING count(*) >= 3), kb AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY shared DESC, dst DESC) AS rn FROM ks), kedges AS (SELECT document_id, src, dst, 'keyword' AS edge_type, round(least(0.6, 0.3 + 0.1 * shared), 6) AS weight FROM kb WHERE rn <= 5)"
EDGES = f"{UNITS}, {KEYWORDS}, {STRUCT}, {KEDGES}, edges AS (SELECT * FROM structural UNION ALL SELECT * FROM hierarchical UNION ALL SELECT * FROM kedges)"
W = "CAST(weight AS DOUBLE) AS weight"


def units(t: Tables):
    return chunking.text_units(t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")), "\n")


def keywords(t: Tables):
    return graph.unit_keywords(units(t))


def edges(t: Tables):
    u = units(t).withColumn("section", F.lit(None).cast("string"))
    return graph.structural_edges(u).unionByName(graph.hierarchical_edges(u)).unionByName(graph.keyword_edges(keywords(t)))


@query(rf"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(10) || ' ')), lambda x: x <> '')) AS n FROM documents")
def sentences(t: Tables):
    return t.documents.select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n"))


@query(f"WITH {UNITS} SELECT document_id, unit_id, idx, md5(text) AS text_md5, unit_type FROM units")
def text_units(t: Tables):
    return units(t).select("document_id", "unit_id", F.col("index").alias("idx"), F.md5("text").alias("text_md5"), "unit_type")


@query(f"WITH {UNITS}, {KEYWORDS} SELECT unit_id, word, count FROM keywords")
def unit_keywords(t: Tables):
    return graph.unit_keywords(units(t)).select("unit_id", "word", "count")


@query(f"WITH {UNITS}, {STRUCT} SELECT document_id, src, dst, edge_type, {W} FROM structural")
def structural_edges(t: Tables):
    return graph.structural_edges(units(t))


@query(f"WITH {UNITS}, n AS (SELECT document_id, unit_id AS src, lead(unit_id) OVER (PARTITION BY document_id, unit_type ORDER BY idx) AS dst FROM units) SELECT document_id, src, dst, 'hierarchical' AS edge_type, CAST(0.5 AS DOUBLE) AS weight FROM n WHERE dst IS NOT NULL")
def hierarchical_edges(t: Tables):
    return graph.hierarchical_edges(units(t).withColumn("section", F.col("unit_type")))


@query(f"WITH {UNITS}, {KEYWORDS}, {KEDGES} SELECT document_id, src, dst, edge_type, {W} FROM kedges")
def keyword_edges(t: Tables):
    return graph.keyword_edges(keywords(t))


@query(f"WITH {EDGES} SELECT document_id, src, dst, edge_type, {W} FROM edges")
def graph_edges(t: Tables):
    return edges(t)


@query(f"WITH {EDGES}, x AS (SELECT document_id, src AS unit_id, weight FROM edges UNION ALL SELECT document_id, dst, weight FROM edges) SELECT document_id, unit_id, round(CAST(sum(weight) AS DOUBLE), 6) AS degree FROM x GROUP BY ALL")
def unit_degree(t: Tables):
    return graph.unit_degree(edges(t))


@query("WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT a.label, a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.e, b.e), 6) AS weight FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.3")
def semantic_edges(t: Tables):
    rows = t.embeddings.select(F.col("label").alias("document_id"), F.col("vec_id").alias("unit_id"), F.col("vec_id").alias("index"), "embedding")
    return vector.semantic_edges(rows, 0.3).select(F.col("document_id").alias("label"), "src", "dst", "weight")


@query(f"""WITH {UNITS}, {STRUCT}, s AS (SELECT unit_id AS id FROM units WHERE idx = 0), h1 AS (SELECT DISTINCT dst AS id, 1 AS hop FROM structural JOIN s ON src = id WHERE dst NOT IN (SELECT id FROM s)),
h2 AS (SELECT DISTINCT dst AS id, 2 AS hop FROM structural JOIN h1 ON src = id WHERE dst NOT IN (SELECT id FROM s) AND dst NOT IN (SELECT id FROM h1)) SELECT * FROM h1 UNION ALL SELECT * FROM h2""")
def unit_neighbors(t: Tables):
    u = units(t)
    return graph.neighbours(graph.structural_edges(u), u.where("index = 0").select(F.col("unit_id").alias("id")), 2)


# Adjacency of chunks: vectors of one label are linked when they are alike.
ADJ = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS src, b.vec_id AS dst, round(list_cosine_similarity(a.e, b.e), 6) AS weight FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.2)"
SEEDS = "s AS (SELECT vec_id AS id FROM embeddings WHERE label = 3)"


def adjacency(t: Tables):
    rows = t.embeddings.select(F.col("label").alias("document_id"), F.col("vec_id").alias("unit_id"), F.col("vec_id").alias("index"), "embedding")
    return vector.edges_from(rows, 0.2)


def seeds(t: Tables):
    return t.embeddings.groupBy("label").agg(F.min("vec_id").alias("id")).select("id")


@query(f"WITH {ADJ}, s AS (SELECT min(vec_id) AS id FROM embeddings GROUP BY label), a AS (SELECT src, dst FROM p WHERE weight >= 0.25), h1 AS (SELECT DISTINCT dst AS id, 1 AS hop FROM a JOIN s ON src = id WHERE dst NOT IN (SELECT id FROM s)), h2 AS (SELECT DISTINCT dst AS id, 2 AS hop FROM a JOIN h1 ON src = id WHERE dst NOT IN (SELECT id FROM s) AND dst NOT IN (SELECT id FROM h1)) SELECT id, 0 AS hop FROM s UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2")
def graph_expand(t: Tables):
    return graph.expand(adjacency(t), seeds(t), 2, 0.25)


@query(f"""WITH {ADJ}, s AS (SELECT min(vec_id) AS id FROM embeddings GROUP BY label), a AS (SELECT src, dst FROM p WHERE weight >= 0.25), h1 AS (SELECT DISTINCT dst AS id FROM a JOIN s ON src = id), h2 AS (SELECT DISTINCT dst AS id FROM a JOIN h1 ON src = id),
w AS (SELECT vec_id, lag(vec_id) OVER o AS x, lead(vec_id) OVER o AS y FROM embeddings WINDOW o AS (PARTITION BY label ORDER BY vec_id)), n AS (SELECT x AS id FROM w WHERE vec_id IN (SELECT id FROM s) UNION SELECT y FROM w WHERE vec_id IN (SELECT id FROM s)),
every AS (SELECT id FROM s UNION SELECT id FROM h1 UNION SELECT id FROM h2 UNION SELECT id FROM n WHERE id IS NOT NULL) SELECT id, id IN (SELECT id FROM s) AS is_seed FROM every""")
def expand_candidates(t: Tables):
    from corvid.operators.retrieval import expand_candidates as expanded

    chunks = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("document_id"))
    return expanded(chunks, seeds(t), adjacency(t), [F.col("id")], GraphConfig(decay=0.25))


@query("SELECT vec_id AS id FROM embeddings WHERE label < 3 UNION SELECT doc_id FROM labels")
def candidate_union(t: Tables):
    return t.embeddings.where("label < 3").select(F.col("vec_id").alias("id")).union(t.labels.select("doc_id")).distinct()


@query(f"""WITH {EDGES}, m AS (SELECT unit_id, document_id || '_graph_' || CAST(idx // 4 AS VARCHAR) AS chunk FROM units) SELECT a.chunk AS src, b.chunk AS dst, CAST(max(weight) AS DOUBLE) AS weight FROM edges JOIN m a ON src = a.unit_id JOIN m b ON dst = b.unit_id WHERE a.chunk <> b.chunk GROUP BY ALL""")
def chunk_adjacency(t: Tables):
    members = units(t).select("unit_id", F.concat_ws("_graph_", "document_id", F.floor(F.col("index") / 4).cast("string")).alias("chunk_id"))
    return graph.chunk_adjacency(edges(t), members)


@query(f"WITH {UNITS} SELECT document_id, CAST(idx // 4 AS BIGINT) AS part, md5(string_agg(text, ' ' ORDER BY idx)) AS text_md5 FROM units GROUP BY ALL")
def community_text(t: Tables):
    u = units(t).groupBy("document_id", F.floor(F.col("index") / 4).alias("part")).agg(F.array_sort(F.collect_list(F.struct("index", "text"))).alias("u"))
    return u.select("document_id", "part", F.md5(F.array_join(F.transform("u", lambda x: x["text"]), " ")).alias("text_md5"))


@query(f"WITH {UNITS} SELECT unit_id AS id, document_id, idx AS chunk_index FROM units")
def chunk_index(t: Tables):
    return units(t).select(F.col("unit_id").alias("id"), "document_id", F.col("index").alias("chunk_index"))


@query()
def linear_chunks(t: Tables):
    return chunking.linear_chunks(t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")))


@query()
def communities(t: Tables):
    return chunking.communities(units(t), edges(t))


@query()
def graph_chunks(t: Tables):
    return chunking.graph_chunks_of(t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")), "\n")


@query()
def regraph(t: Tables):
    """Documents rebuilt from their linear chunks, cut into units and grouped again."""
    rebuilt = chunking.rejoined(chunking.linear_chunks(t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content")))).select(F.col("document_id").alias("id"), "content")
    u = chunking.text_units(rebuilt, "\n\n")
    e = graph.structural_edges(u).unionByName(graph.hierarchical_edges(u.withColumn("section", F.lit(None).cast("string"))))
    return chunking.graph_chunks(u, e)
