"""Named queries of the training-data operators and their SQL.

Parameters here are the production parameters: they are the same at every size
of input.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semframe.llm.density_clusters import density_clusters, describe_clusters
from semframe.llm.leaks import leaked_passages
from semframe.llm.listings import same_listings
from semframe.llm.matching import match_products, match_songs
from semframe.llm.mixing import Mix, mix_sources, token_counts
from semframe.llm.names import link_names, typed_names
from semframe.llm.pieces import cut_pieces
from semframe.llm.shared_spans import maximal_spans, shared_share, shared_spans, sharing_pairs
from semframe.llm.similar_vectors import most_similar, nearest_of
from semframe.runtime import staged, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


# ---------------------------------------------------------------- problem 1

VECTORS = {"chunks": ("chunks", ["id", "chunk_id"], "embedding"), "documents": ("documents", ["doc_id"], "text_embedding"), "tables": ("table_vectors", ["table_id"], "embedding")}
WANTED = 1024  # entries a walk gathers before it ends


def _second_key(df: DataFrame, names: list[str]) -> DataFrame:
    """Give collections with one key -1 as the second."""
    for name in names:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(-1).cast("long"))
    return df


@query("""
WITH items AS (
  SELECT 'chunks' AS collection, id, chunk_id, any_value(embedding)::DOUBLE[] AS e FROM chunks GROUP BY ALL
  UNION ALL SELECT 'documents', doc_id, -1, any_value(text_embedding)::DOUBLE[] FROM documents GROUP BY ALL
  UNION ALL SELECT 'tables', table_id, -1, any_value(embedding)::DOUBLE[] FROM table_vectors GROUP BY ALL),
usable AS (SELECT * FROM items WHERE e IS NOT NULL AND isfinite(list_inner_product(e, e)) AND list_inner_product(e, e) > 0),
pairs AS (SELECT a.collection, a.id AS a_id, a.chunk_id AS a_chunk, b.id AS b_id, b.chunk_id AS b_chunk, list_cosine_similarity(a.e, b.e) AS c
  FROM usable a JOIN usable b ON a.collection = b.collection AND (a.id <> b.id OR a.chunk_id <> b.chunk_id)),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY collection, a_id, a_chunk ORDER BY c DESC, b_id, b_chunk) <= 5)
SELECT DISTINCT collection, CASE WHEN (a_id, a_chunk) < (b_id, b_chunk) THEN a_id ELSE b_id END AS id_a, CASE WHEN (a_id, a_chunk) < (b_id, b_chunk) THEN a_chunk ELSE b_chunk END AS chunk_a,
  CASE WHEN (a_id, a_chunk) < (b_id, b_chunk) THEN b_id ELSE a_id END AS id_b, CASE WHEN (a_id, a_chunk) < (b_id, b_chunk) THEN b_chunk ELSE a_chunk END AS chunk_b
FROM best WHERE c >= 0.97
""")
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, (source, keys, vector) in VECTORS.items():
        pairs = most_similar(table(spark, folder, source), keys, vector, k=5, min_cosine=0.97, wanted=2 * WANTED)
        pairs = pairs.withColumnsRenamed({f"a_{keys[0]}": "id_a", f"b_{keys[0]}": "id_b", "a_chunk_id": "chunk_a", "b_chunk_id": "chunk_b"})
        parts.append(_second_key(pairs, ["chunk_a", "chunk_b"]).select(F.lit(name).alias("collection"), "id_a", "chunk_a", "id_b", "chunk_b"))
    return reduce(DataFrame.union, parts)


@query("""
WITH items AS (
  SELECT 'chunks' AS collection, id, chunk_id, any_value(embedding)::DOUBLE[] AS e FROM chunks GROUP BY ALL
  UNION ALL SELECT 'documents', doc_id, -1, any_value(text_embedding)::DOUBLE[] FROM documents GROUP BY ALL
  UNION ALL SELECT 'tables', table_id, -1, any_value(embedding)::DOUBLE[] FROM table_vectors GROUP BY ALL),
usable AS (SELECT collection, id, chunk_id, list_transform(e, lambda x: (x / sqrt(list_inner_product(e, e)))::FLOAT) AS u FROM items WHERE e IS NOT NULL AND isfinite(list_inner_product(e, e)) AND list_inner_product(e, e) > 0),
classes AS MATERIALIZED (SELECT collection, u, min((id, chunk_id)) AS low, count(*) AS copies FROM usable GROUP BY collection, u),
asked AS (SELECT DISTINCT collection, u FROM usable WHERE id % 50 = 0),
near AS (SELECT a.collection, a.u, c.low, c.copies, list_inner_product(a.u::DOUBLE[], c.u::DOUBLE[]) AS cosine FROM asked a JOIN classes c ON a.collection = c.collection AND a.u <> c.u),
best AS (SELECT *, row_number() OVER (PARTITION BY collection, u ORDER BY cosine DESC, low) AS rank FROM near QUALIFY rank <= 5)
SELECT collection, id, chunk_id, rank, low[1] AS near_id, low[2] AS near_chunk_id, copies, round(cosine, 3) AS cosine FROM best JOIN usable USING (collection, u) WHERE id % 50 = 0
""")
def p1_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors, whatever their cosine, of the rows whose id is
    divisible by 50, against all rows."""
    parts = []
    for name, (source, keys, vector) in VECTORS.items():
        rows = nearest_of(table(spark, folder, source), keys, vector, every=50, k=5, wanted=32 * WANTED)
        rows = rows.withColumnsRenamed({keys[0]: "id", f"near_{keys[0]}": "near_id"})
        parts.append(_second_key(rows, ["chunk_id", "near_chunk_id"]).select(F.lit(name).alias("collection"), "id", "chunk_id", "rank", "near_id", "near_chunk_id", "copies", F.round("cosine", 3).alias("cosine")))
    return reduce(DataFrame.union, parts)


# ---------------------------------------------------------------- problem 2


@query()
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    names = typed_names(table(spark, folder, "entity"), table(spark, folder, "companies"), [table(spark, folder, "songs_left"), table(spark, folder, "songs_right")])
    return link_names(names, "kind", "key", "name", "k", "mark", "place", "year").withColumnRenamed("group", "kind")


# ---------------------------------------------------------------- problem 3

CLUSTERED = {"documents": ("documents", ["doc_id"], "title_embedding"), "chunks": ("chunks", ["id", "chunk_id"], "embedding")}


@query("""
WITH RECURSIVE items AS (
  SELECT 'chunks' AS collection, id, chunk_id, any_value(embedding)::DOUBLE[] AS e FROM chunks GROUP BY ALL
  UNION ALL SELECT 'documents', doc_id, -1, any_value(title_embedding)::DOUBLE[] FROM documents GROUP BY ALL),
usable AS (SELECT collection, (id, chunk_id) AS k, e FROM items WHERE e IS NOT NULL AND isfinite(list_inner_product(e, e)) AND list_inner_product(e, e) > 0),
near AS MATERIALIZED (SELECT a.collection, a.k AS x, b.k AS y FROM usable a JOIN usable b ON a.collection = b.collection WHERE list_cosine_similarity(a.e, b.e) >= 0.8),
reach(collection, x, y) AS (SELECT collection, x, y FROM near UNION SELECT r.collection, r.x, n.y FROM reach r JOIN near n ON r.collection = n.collection AND r.y = n.x),
label AS (SELECT collection, x, min(y) AS low, count(*) AS size FROM reach GROUP BY collection, x)
SELECT collection, x[1] AS id, x[2] AS chunk_id, low[1] AS first_id, low[2] AS first_chunk_id FROM label WHERE size >= 5
""")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = []
    for name, (source, keys, vector) in CLUSTERED.items():
        rows = density_clusters(table(spark, folder, source), keys, vector, min_cosine=0.8, min_size=5, wanted=WANTED, block_rows=4096)
        rows = rows.withColumnsRenamed({keys[0]: "id", f"first_{keys[0]}": "first_id"})
        parts.append(_second_key(rows, ["chunk_id", "first_chunk_id"]).select(F.lit(name).alias("collection"), "id", "chunk_id", "first_id", "first_chunk_id"))
    return reduce(DataFrame.union, parts)


@query()
def p3_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Size and most typical titles or chunks of each cluster."""
    parts = []
    for (name, (source, keys, vector)), shown in zip(CLUSTERED.items(), ("title", "content")):
        rows = table(spark, folder, source)
        told = describe_clusters(density_clusters(rows, keys, vector, min_cosine=0.8, min_size=5, wanted=WANTED, block_rows=4096), keys)
        told = told.select(*[F.col(f"first_{k}") for k in keys], "size", F.explode("typical").alias("t")).select(*[F.col(f"first_{k}") for k in keys], "size", "t.place", *[f"t.{k}" for k in keys])
        told = told.join(rows.groupBy(*keys).agg(F.min(shown).alias("shown")), keys)
        told = told.withColumnsRenamed({keys[0]: "typical_id", "chunk_id": "typical_chunk_id", f"first_{keys[0]}": "first_id"})
        parts.append(_second_key(told, ["first_chunk_id", "typical_chunk_id"]).select(F.lit(name).alias("collection"), "first_id", "first_chunk_id", "size", "place", "typical_id", "typical_chunk_id", "shown"))
    return reduce(DataFrame.union, parts)


# ---------------------------------------------------------------- problem 4


@query()
def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_listings([(table(spark, folder, "abt_products"), "id_abt"), (table(spark, folder, "buy_products"), "id_buy")])


# ---------------------------------------------------------------- problem 5

PIECE, OVERLAP = 2000, 200


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = cut_pieces(table(spark, folder, "documents"), ["doc_id"], "text", PIECE, OVERLAP).withColumnsRenamed({"doc_id": "id"})
    chunks = cut_pieces(table(spark, folder, "chunks"), ["id", "chunk_id"], "content", PIECE, OVERLAP)
    docs = docs.select(F.lit("document").alias("item_kind"), "id", F.lit(-1).cast("long").alias("chunk_id"), *docs.columns[1:])
    return docs.union(chunks.select(F.lit("chunk"), *chunks.columns))


@query("""
with items as (
  select 'document' item_kind, doc_id id, -1::bigint chunk_id, text from documents
  union all select 'chunk', id, chunk_id, content from chunks)
select distinct 'oversized' case_kind, item_kind, id, chunk_id from items where length(text) > 2000
union
select distinct 'unbreakable', item_kind, id, chunk_id from items where length(text) > 2000
and list_max(list_transform(regexp_split_to_array(text, '[ \t\r\n]'), lambda x: length(x))) > 2000
""")
def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    items = _pieces(spark, folder).select("item_kind", "id", "chunk_id", "longest_run").distinct()
    kinds = F.explode(F.array_compact(F.array(F.lit("oversized"), F.when(F.col("longest_run") > PIECE, F.lit("unbreakable")))))
    return items.select(kinds.alias("case_kind"), "item_kind", "id", "chunk_id")


@query()
def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


# ---------------------------------------------------------------- problem 6


def _matches(spark: SparkSession, folder: str) -> DataFrame:
    songs = match_songs(table(spark, folder, "songs_left"), table(spark, folder, "songs_right"), expand=None)
    products = match_products(table(spark, folder, "abt_products"), table(spark, folder, "buy_products"), expand=None)
    return songs.select(F.lit("songs").alias("kind"), *songs.columns).union(products.select(F.lit("products"), *products.columns))


@query()
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _matches(spark, folder).select("kind", "left_key", "right_key")


@query()
def p6_matches(spark: SparkSession, folder: str) -> DataFrame:
    """The matches with their scores and confidences."""
    return _matches(spark, folder)


# ---------------------------------------------------------------- problem 8


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_passages(table(spark, folder, "documents"), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "passage")


@query()
def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where("not reparameterised").select("doc_id", "item_id")


@query()
def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Also passages with other values in them."""
    return _leaks(spark, folder)


# ---------------------------------------------------------------- problem 9

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _mix(spark: SparkSession, folder: str) -> Mix:
    counted = staged(token_counts(table(spark, folder, "documents"), "doc_id", "text", "source", VOCABULARY), "tokens")
    return mix_sources(counted, table(spark, folder, "mix_targets"))


@query("""
with docs as (select distinct doc_id, lower(trim(source)) source, coalesce(length(text), 0) size from documents),
sums as (select source, sum(size) size from docs group by source)
select distinct t.source from mix_targets t left join sums s on s.source = t.source
where coalesce(s.size, 0) * t.max_repeats < t.target_share * (select sum(size) from docs)
""")
def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report.where("not reachable").select("source")


@query()
def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).report


@query()
def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).placed


# --------------------------------------------------------------- problem 10


@query("""
WITH keys AS MATERIALIZED (SELECT DISTINCT doc_id, md5_number(substring(text, i, 250)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 248)) AS i FROM documents WHERE length(text) >= 250)),
shared AS (SELECT * FROM keys WHERE h IN (SELECT h FROM keys GROUP BY h HAVING count(*) > 1))
SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM shared a JOIN shared b ON a.h = b.h AND a.doc_id < b.doc_id
""")
def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return sharing_pairs(shared_spans(table(spark, folder, "documents"), "doc_id", "text", length=250))


_P10_MARKS = """
WITH docs AS MATERIALIZED (SELECT doc_id, any_value(text) AS text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
windows AS MATERIALIZED (SELECT doc_id, i - 1 AS low, md5_number(substring(text, i, 250)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 248)) AS i FROM docs WHERE length(text) >= 250)),
shared AS (SELECT doc_id, low FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(DISTINCT doc_id) > 1)),
broken AS (SELECT doc_id, low, CASE WHEN low - lag(low) OVER line <= 250 THEN 0 ELSE 1 END AS fresh FROM shared WINDOW line AS (PARTITION BY doc_id ORDER BY low)),
counted AS (SELECT doc_id, low, sum(fresh) OVER (PARTITION BY doc_id ORDER BY low) AS island FROM broken),
stretches AS (SELECT doc_id, min(low) AS start, max(low) + 250 - min(low) AS size FROM counted GROUP BY doc_id, island)
"""


@query(_P10_MARKS + "SELECT doc_id AS doc, start, size FROM stretches")
def p10_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The maximal stretches that stand in more than one document."""
    return maximal_spans(shared_spans(table(spark, folder, "documents"), "doc_id", "text", length=250))


@query(_P10_MARKS + """
SELECT d.doc_id AS doc, length(d.text) AS size, coalesce(sum(s.size), 0)::BIGINT AS shared_chars, coalesce(sum(s.size), 0)::BIGINT / greatest(length(d.text), 1) AS share, count(s.size) AS stretches
FROM docs d LEFT JOIN stretches s USING (doc_id) GROUP BY d.doc_id, d.text
""")
def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document is shared elsewhere."""
    return shared_share(shared_spans(table(spark, folder, "documents"), "doc_id", "text", length=250))
