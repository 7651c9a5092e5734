"""Named queries of sources, sinks, vector forms, clusters, metrics and streams,
and their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semframe.functions.models import EchoGenerator, LetterEmbedding, OverlapValidator
from semframe.functions.serialize import plain
from semframe.functions.vector import vector_topk
from semframe.operators.aggregate import Count, CustomAgg, SetAgg, Sum, hash_aggregate, principal, soft_aggregate
from semframe.operators.cluster import CallableClusterer, DBSCANClusterer, HDBSCANClusterer, KMeansClusterer
from semframe.operators.criteria import Col, Const, GreaterThan, HardEqual, SoftEqual, select
from semframe.operators.joins import hash_join, similar_pairs, soft_join
from semframe.operators.metrics import bleu_representativeness, calc_bleu, prompt_study
from semframe.operators.nested import child_cells, nested_nodes
from semframe.operators.project import Concat, Custom, Math, project
from semframe.plans.queries import PART_VECTORS, UNIT, _letters, _part_names, _registry, _scan, query
from semframe.relation import Relation
from semframe.runtime import shared_dir, table
from semframe.sources.scan import read_csv, read_jdbc, read_json, read_json_lines, read_parquet, read_wiki_dump, values
from semframe.sources.sinks import document_vectors, table_name_vectors, write_csv, write_parquet, write_table
from semframe.streaming.streams import run_available, session_aggregate, stream_folder, windowed_aggregate


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/semframe/{name}-{uuid4().hex}"


# ------------------------------------------------------------ sources and sinks


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def source_csv(spark: SparkSession, folder: str) -> DataFrame:
    """The CSV sink read by the CSV source."""
    path = _path(spark, "csv")
    write_csv(table(spark, folder, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return read_csv(spark, path, "p_partkey long, p_name string, p_retailprice double")


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def source_compressed(spark: SparkSession, folder: str) -> DataFrame:
    """Compressed text with a tab between cells, every cell as text."""
    path = _path(spark, "tsv")
    table(spark, folder, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority").write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    return read_csv(spark, path, separator="\t")


@query("SELECT event_id, event_type, replace(props, ': ', ':') AS props FROM events")
def source_json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """One record a line; nested JSON stays text."""
    path = _path(spark, "jsonl")
    events = table(spark, folder, "events").select("event_id", "event_type", F.parse_json("props").alias("props"))
    events.write.json(path)
    return read_json_lines(spark, path, ("props",), "event_id long, event_type string, props string").select("event_id", "event_type", "props")


@query("SELECT n_nationkey, n_name FROM nation")
def source_json(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one array each."""
    path = _path(spark, "json")
    rows = table(spark, folder, "nation").select(F.struct("n_nationkey", "n_name").alias("r"), (F.col("n_nationkey") % 3).alias("part"))
    rows.groupBy("part").agg(F.to_json(F.collect_list("r")).alias("value")).select("value").repartition(3).write.text(path)
    return read_json(spark, path, "n_nationkey int, n_name string")


@query("SELECT n_name AS title, n_nationkey::BIGINT AS revision_id, 'on ' || n_regionkey AS text FROM nation")
def source_xml(spark: SparkSession, folder: str) -> DataFrame:
    """A dump of pages, split at its pages."""
    path = _path(spark, "xml")
    pages = table(spark, folder, "nation").select(F.col("n_name").alias("title"), F.struct(F.col("n_nationkey").alias("id"), F.struct(F.concat(F.lit("on "), "n_regionkey").alias("_VALUE"), F.lit("x").alias("_kind")).alias("text")).alias("revision"))
    pages.write.format("xml").option("rowTag", "page").option("rootTag", "dump").save(path)
    return read_wiki_dump(spark, path)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey > 20")
def source_jdbc(spark: SparkSession, folder: str) -> DataFrame:
    """A database's table in four ranges of its key; the database is one in the
    memory of a local session."""
    url, properties = f"jdbc:derby:memory:{uuid4().hex};create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    table(spark, folder, "supplier").select("s_suppkey", "s_name").write.jdbc(url, "supplier", properties=properties)
    rows = read_jdbc(spark, url, "(SELECT * FROM supplier) t", properties, "S_SUPPKEY", (1, 100), 4)
    return rows.toDF("s_suppkey", "s_name").where("s_suppkey > 20")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def sink_parquet(spark: SparkSession, folder: str) -> DataFrame:
    """Parts by a column; the filter prunes them."""
    path = _path(spark, "parquet")
    write_parquet(table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment"), path, partition_by=("c_mktsegment",))
    return read_parquet(spark, path).where("c_mktsegment = 'BUILDING'")


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def sink_table(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables bucketed by the key they are joined on."""
    names = [f"semframe_{uuid4().hex}" for _ in range(2)]
    write_table(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), names[0], bucket_by=("o_custkey",), buckets=8)
    write_table(table(spark, folder, "customer").select("c_custkey", "c_name"), names[1], bucket_by=("c_custkey",), buckets=8)
    joined = hash_join(Relation(spark.table(names[0]), "o"), Relation(spark.table(names[1]), "c"), "o_custkey", "c_custkey")
    return project(joined, ["o_orderkey", "o_custkey", "c_name"]).df


@query(f"SELECT doc_id, {_letters('title')} AS title_embedding, {_letters('text')} AS text_embedding FROM (SELECT DISTINCT doc_id, title, text FROM documents WHERE title IS NOT NULL AND text IS NOT NULL)")
def sink_document_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "title", "text").where("title is not null and text is not null").distinct()
    return document_vectors(rows, "title", "text", LetterEmbedding()).select("doc_id", "title_embedding", "text_embedding")


_TABLES = "(VALUES ('region'), ('nation'), ('customer'), ('supplier'), ('part'), ('orders'), ('lineitem'), ('events')) t(n)"


@query(f"SELECT 'public' AS schemaname, n AS tablename, {_letters(chr(40) + chr(39) + 'public.' + chr(39) + ' || n' + chr(41))} AS embedding FROM {_TABLES}")
def sink_table_vectors(spark: SparkSession, folder: str) -> DataFrame:
    told = table_name_vectors(_registry(spark, folder), LetterEmbedding())
    return told.withColumn("embedding", F.col("embedding").cast("array<double>"))


@query(f"SELECT 'public.' || n AS name FROM {_TABLES}")
def catalog_tables(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _registry(spark, folder).names()], "name string")


@query("SELECT DISTINCT c_mktsegment AS sample FROM customer")
def catalog_samples(spark: SparkSession, folder: str) -> DataFrame:
    found = _registry(spark, folder).samples("public.customer", "c_mktsegment", n=100, share=1.0)
    return spark.createDataFrame([(x,) for x in found], "sample string")


# ------------------------------------------------------------- results, algebra


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def relation_fetch_all(spark: SparkSession, folder: str) -> DataFrame:
    rows = project(select(_scan(spark, folder, "nation"), HardEqual(Col("n_regionkey"), Const(1))), ["n_nationkey", "n_name"]).fetch_all()
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey int, n_name string")


@query("SELECT count(*) AS n, sum(o_orderkey) AS total FROM orders")
def relation_fetch_one(spark: SparkSession, folder: str) -> DataFrame:
    row = hash_aggregate(_scan(spark, folder, "orders"), [], [Count("o_orderkey", "n"), Sum("o_orderkey", "total")]).fetch_one()
    return spark.createDataFrame([(row["n"], row["total"])], "n long, total long")


@query("SELECT i // 40 AS batch, count(*) AS size FROM (SELECT row_number() OVER () - 1 AS i FROM supplier) GROUP BY ALL")
def relation_batches(spark: SparkSession, folder: str) -> DataFrame:
    told = [(i, len(b)) for i, b in enumerate(_scan(spark, folder, "supplier").batches(40))]
    return spark.createDataFrame(told, "batch long, size long")


@query("SELECT * FROM (VALUES (0, 'project [c_name, o_orderkey]'), (1, '  hash join [c_custkey = o_custkey]'), (2, '    scan public.customer'), (3, '    scan public.orders limit 10')) t(line, algebra)")
def relation_describe(spark: SparkSession, folder: str) -> DataFrame:
    plan = project(hash_join(_scan(spark, folder, "customer"), _scan(spark, folder, "orders", limit=10), "c_custkey", "o_custkey"), ["c_name", "o_orderkey"])
    return spark.createDataFrame(list(enumerate(plan.describe().split("\n"))), "line int, algebra string")


@query("SELECT s_suppkey, s_nationkey * 2 AS twice FROM supplier WHERE s_acctbal > 0")
def custom_operator(spark: SparkSession, folder: str) -> DataFrame:
    """An operator of one's own between two of the library."""
    rows = select(_scan(spark, folder, "supplier"), GreaterThan(Col("s_acctbal"), Const(0)))
    return project(rows.transform(lambda df: df.withColumn("twice", F.col("s_nationkey") * 2), "double"), ["s_suppkey", "twice"]).df


@query("SELECT p_partkey, upper(p_name[1:3]) AS head, p_size % 7 AS rest FROM part")
def project_python(spark: SparkSession, folder: str) -> DataFrame:
    """Functions of single values and of pandas columns."""
    return project(_scan(spark, folder, "part"), ["p_partkey", Custom(["p_name"], "head", "string", lambda s: s[:3].upper(), kind="python"), Custom(["p_size"], "rest", "int", lambda s: s % 7)]).df


# ----------------------------------------------------------------- soft filters


@query("SELECT p_partkey, p_name FROM part WHERE len(list_intersect(list_distinct(string_split(lower(p_name), ' ')), ['small', 'copper', 'ring'])) >= 1")
def soft_filter_zero_few_shot(spark: SparkSession, folder: str) -> DataFrame:
    rows = project(_scan(spark, folder, "part"), ["p_partkey", "p_name"])
    return select(rows, SoftEqual(Col("p_name"), Const("small copper ring"), None, OverlapValidator(), method="zero-few-shot")).df


# -------------------------------------------------------------------- soft joins


def _unit(text: str) -> str:
    """SQL: the letters of a text at length 1, zeros for a text without any."""
    counts = _letters(text)
    return f"list_transform({counts}, lambda c: c / greatest(1e-300, sqrt(list_inner_product({counts}, {counts}))))"


_GOODS = f"""
l AS (SELECT DISTINCT name AS ln, seller AS ls FROM abt_products), r AS (SELECT DISTINCT name AS rn, seller AS rs FROM buy_products),
lv AS MATERIALIZED (SELECT *, CASE WHEN ln IS NOT NULL THEN {_unit('ln')} END AS x, CASE WHEN ls IS NOT NULL THEN {_unit('ls')} END AS y FROM l),
rv AS MATERIALIZED (SELECT *, CASE WHEN rn IS NOT NULL THEN {_unit('rn')} END AS x, CASE WHEN rs IS NOT NULL THEN {_unit('rs')} END AS y FROM r)
"""


def _goods(spark: SparkSession, folder: str) -> tuple[Relation, Relation]:
    left = table(spark, folder, "abt_products").select(F.col("name").alias("ln"), F.col("seller").alias("ls")).distinct()
    right = table(spark, folder, "buy_products").select(F.col("name").alias("rn"), F.col("seller").alias("rs")).distinct()
    return Relation(left, "abt"), Relation(right, "buy")


@query(f"""
WITH {_GOODS},
lm AS MATERIALIZED (SELECT ln, ls, CASE WHEN y IS NULL THEN x WHEN x IS NULL THEN y ELSE list_transform(list_zip(x, y), lambda p: (p[1] + p[2]) / 2) END AS v FROM lv),
rm AS MATERIALIZED (SELECT rn, rs, CASE WHEN y IS NULL THEN x WHEN x IS NULL THEN y ELSE list_transform(list_zip(x, y), lambda p: (p[1] + p[2]) / 2) END AS v FROM rv)
SELECT ln, ls, rn, rs FROM lm JOIN rm ON list_inner_product(lm.v, rm.v) > 0.9123
""")
def soft_join_two_fields(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of the vectors of two fields, not normalised again."""
    left, right = _goods(spark, folder)
    return soft_join(left, right, method="threshold", form="FIELD_SERIALIZED", columns_left=["ln", "ls"], columns_right=["rn", "rs"], threshold=0.9123, model=UNIT).df


@query(f"""
WITH {_GOODS}
SELECT ln, ls, rn, rs FROM lv JOIN rv ON (coalesce(list_inner_product(lv.x, rv.x), 0) + coalesce(list_inner_product(lv.y, rv.y), 0)) / 2 > 0.9423
""")
def soft_join_two_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The mean of the cosines of two columns, 0 where a cell is null."""
    left, right = _goods(spark, folder)
    return soft_join(left, right, method="threshold", comparison="COLUMN_WISE", columns_left=["ln", "ls"], columns_right=["rn", "rs"], threshold=0.9423, model=UNIT).df


@query(f"SELECT a.n AS l, b.n AS r FROM {PART_VECTORS} a, {PART_VECTORS} b WHERE list_distance(a.v, b.v) < 2.9123")
def soft_join_l2(spark: SparkSession, folder: str) -> DataFrame:
    """Squared distances below a bound in place of inner products above it."""
    return soft_join(_part_names(spark, folder, "l", "a"), _part_names(spark, folder, "r", "b"), method="threshold", threshold=2.9123**2, metric="l2", model=LetterEmbedding(), serializer=plain).df


@query("SELECT a.vec_id AS l, b.vec_id AS r FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < 1.1")
def soft_join_vectors_l2(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return similar_pairs(rows.withColumnRenamed("vec_id", "l"), rows.withColumnRenamed("vec_id", "r"), 1.1**2, "l2").where("l < r").select("l", "r")


_Q = "(SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)"
_SIGNS = f"(SELECT list_transform(list_zip(embedding, {_Q}), lambda p: [(p[1] > 0)::INT, (p[2] > 0)::INT])"
_MEASURES = {
    "l2": f"list_distance(embedding::DOUBLE[], {_Q})",
    "ip": f"-list_inner_product(embedding::DOUBLE[], {_Q})",
    "cosine": f"1 - list_cosine_similarity(embedding::DOUBLE[], {_Q})",
    "l1": f"list_sum(list_transform(list_zip(embedding::DOUBLE[], {_Q}), lambda p: abs(p[1] - p[2])))",
    "hamming": f"list_sum(list_transform(list_zip(embedding::DOUBLE[], {_Q}), lambda p: ((p[1] > 0) <> (p[2] > 0))::INT))",
    "jaccard": f"1 - list_sum(list_transform(list_zip(embedding::DOUBLE[], {_Q}), lambda p: (p[1] > 0 AND p[2] > 0)::INT)) / list_sum(list_transform(list_zip(embedding::DOUBLE[], {_Q}), lambda p: (p[1] > 0 OR p[2] > 0)::INT))::DOUBLE",
}


@query(" UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS metric, vec_id FROM embeddings ORDER BY round({value}, 9), vec_id LIMIT 10)" for name, value in _MEASURES.items()))
def topk_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest by each of six distances."""
    rows = table(spark, folder, "embeddings")
    asked = rows.orderBy("vec_id").select("embedding").first()[0]
    out = None
    for name in _MEASURES:
        near = vector_topk(rows, "embedding", asked, 10, name, tie="vec_id").select(F.lit(name).alias("metric"), "vec_id")
        out = near if out is None else out.union(near)
    return out


# ---------------------------------------------------------------------- clusters

_BLOBS = [("aaaa", 1), ("aaab", 2), ("aaba", 4), ("zzzz", 8), ("zzzy", 16), ("zzyz", 32), ("mmmmmmmmmmmmmmmmmmmm", 64)]
_TWO = "(['aaaa', 'aaab', 'aaba'], 7), (['zzyz', 'zzzy', 'zzzz'], 56)"


def _blobs(spark: SparkSession, rows=tuple(_BLOBS)) -> Relation:
    return values(spark, "blobs", ["word", "n"], list(rows), "word string, n long")


@query(f"SELECT * FROM (VALUES {_TWO}) t(word, n)")
def soft_agg_kmeans_blobs(spark: SparkSession, folder: str) -> DataFrame:
    return soft_aggregate(_blobs(spark, _BLOBS[:6]), ["word"], [Sum("n", "n")], LetterEmbedding(), KMeansClusterer(2)).df


@query(f"SELECT * FROM (VALUES {_TWO}, (['mmmmmmmmmmmmmmmmmmmm'], 64)) t(word, n)")
def soft_agg_hdbscan_blobs(spark: SparkSession, folder: str) -> DataFrame:
    """Noise is a group of its own."""
    return soft_aggregate(_blobs(spark), ["word"], [Sum("n", "n")], LetterEmbedding(), HDBSCANClusterer(3, 2), serializer=lambda c: F.col(c[0])).df


@query(f"SELECT * FROM (VALUES {_TWO}, (['mmmmmmmmmmmmmmmmmmmm'], 64)) t(word, n)")
def soft_agg_noise(spark: SparkSession, folder: str) -> DataFrame:
    return soft_aggregate(_blobs(spark), ["word"], [Sum("n", "n")], LetterEmbedding(), DBSCANClusterer(2.0, 3), serializer=lambda c: F.col(c[0])).df


@query(f"SELECT * FROM (VALUES {_TWO}) t(word, n)")
def soft_agg_reduced(spark: SparkSession, folder: str) -> DataFrame:
    """On two principal components."""
    return soft_aggregate(_blobs(spark, _BLOBS[:6]), ["word"], [Sum("n", "n")], LetterEmbedding(), DBSCANClusterer(2.0, 1), serializer=lambda c: F.col(c[0]), reduce_dimensions=2).df


@query("SELECT * FROM (VALUES ('find one short name for all of these: aaaa, aaab, aaba', 7), ('find one short name for all of these: zzyz, zzzy, zzzz', 56)) t(key, n)")
def soft_agg_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One key that a generator writes."""
    return soft_aggregate(_blobs(spark, _BLOBS[:6]), ["word"], [Sum("n", "n")], LetterEmbedding(), KMeansClusterer(2), summary=EchoGenerator()).df


@query("SELECT n_regionkey % 2 AS part, count(*) AS n, list_sort(list(DISTINCT n_name)) AS n_name FROM nation GROUP BY ALL")
def soft_agg_custom_clusterer(spark: SparkSession, folder: str) -> DataFrame:
    """A function from a matrix to labels in place of a clusterer."""
    rows = project(_scan(spark, folder, "nation"), ["n_name", Math(Col("n_regionkey"), "*", Const(1), "part")]).transform(lambda df: df.withColumn("part", F.col("part") % 2), "parity")
    model = LetterEmbedding()
    told = soft_aggregate(rows, ["n_name"], [Count("n_name", "n"), SetAgg("part", "parts")], model, CallableClusterer(lambda m: m[:, 0].astype(int)), serializer=lambda c: F.when(F.col("n_name").isin(*[r[0] for r in rows.df.where("part = 1").select("n_name").collect()]), "a").otherwise("b"))
    return told.df.select(F.col("parts")[0].alias("part"), "n", "n_name")


@query(f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT c_mktsegment AS s, c_nationkey AS k, min(c_custkey) AS low, count(*) AS n, {_letters('c_mktsegment')} || {_letters('c_nationkey::VARCHAR')} AS v FROM customer GROUP BY ALL),
near AS MATERIALIZED (SELECT a.s AS s1, a.k AS k1, b.s AS s2, b.k AS k2 FROM v a, v b WHERE list_distance(a.v, b.v) <= 0.5),
label AS (SELECT s1, k1, min(s2) AS low FROM near GROUP BY ALL)
SELECT list_sort(list(DISTINCT s1)) AS c_mktsegment, list_sort(list(DISTINCT k1)) AS c_nationkey, sum(n) AS n FROM label JOIN v ON s1 = s AND k1 = k GROUP BY label.low
""")
def soft_agg_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Two keys, a text and a number, with vectors of their own."""
    rows = project(_scan(spark, folder, "customer"), ["c_mktsegment", "c_nationkey", "c_custkey"])
    grouped = hash_aggregate(rows, ["c_mktsegment", "c_nationkey"], [Count("c_custkey", "n")])
    return soft_aggregate(grouped, ["c_mktsegment", "c_nationkey"], [Sum("n", "n")], LetterEmbedding(), DBSCANClusterer(0.5, 1), form="FIELD_SERIALIZED").df


@query("""
WITH RECURSIVE near AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM embeddings a, embeddings b WHERE a.vec_id = b.vec_id OR list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.6),
core AS MATERIALIZED (SELECT x FROM near GROUP BY x HAVING count(*) >= 4),
links AS MATERIALIZED (SELECT x, y FROM near WHERE x IN (FROM core) AND y IN (FROM core)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
label AS MATERIALIZED (SELECT x, min(y) AS cluster FROM reach GROUP BY x),
border AS (SELECT near.x, min(cluster) AS cluster FROM near JOIN label ON near.y = label.x WHERE near.x NOT IN (FROM core) GROUP BY near.x)
SELECT vec_id AS id, coalesce(label.cluster, border.cluster, -1) AS cluster FROM embeddings LEFT JOIN label ON vec_id = label.x LEFT JOIN border ON vec_id = border.x
""")
def cluster_dbscan(spark: SparkSession, folder: str) -> DataFrame:
    """Core points, border points and noise."""
    points = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return DBSCANClusterer(0.4, 4, "cosine").fit(points)


@query("SELECT count(*) AS n, true AS kept FROM embeddings")
def vectors_reduced(spark: SparkSession, folder: str) -> DataFrame:
    """Principal components keep the order of variance."""
    points = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    told = principal(points, 3)
    spread = told.agg(F.count(F.lit(1)).alias("n"), *[F.var_samp(F.col("v")[i]).alias(f"s{i}") for i in range(3)])
    return spread.select("n", ((F.col("s0") >= F.col("s1")) & (F.col("s1") >= F.col("s2"))).alias("kept"))


@query("SELECT c_mktsegment, sum(c_custkey * c_custkey) AS squares, max(c_custkey) AS most FROM customer GROUP BY ALL")
def agg_custom_fold(spark: SparkSession, folder: str) -> DataFrame:
    """A fold in parts that are merged, and one as an expression."""
    rows = _scan(spark, folder, "customer")
    return hash_aggregate(rows, ["c_mktsegment"], [CustomAgg("c_custkey", "squares", "long", native=lambda c: F.sum(c * c)), CustomAgg("c_custkey", "most", "long", native=F.max)]).df


# ------------------------------------------------------------------------ metrics

def _prf(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> str:
    p, r = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
    return f"{p} AS precision, {r} AS recall, coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0) AS f1"


@query(f"""
WITH asked AS (SELECT p_size > 25 AS truth, lower(p_name) AS n, lower(p_type) AS t FROM part),
told AS (SELECT 'name' AS prompt, truth, len(list_intersect(list_distinct(string_split(n, ' ')), ['small', 'steel', 'ring'])) >= 1 AS yes FROM asked
  UNION ALL SELECT 'type', truth, len(list_intersect(list_distinct(string_split(t, ' ')), ['promo', 'standard'])) >= 1 FROM asked),
counts AS (SELECT prompt, count_if(truth AND yes) AS tp, count_if(NOT truth AND yes) AS fp, count_if(truth AND NOT yes) AS fn FROM told GROUP BY prompt)
SELECT *, {_prf()} FROM counts
""")
def prompts_compared(spark: SparkSession, folder: str) -> DataFrame:
    """Which prompt gets the better answers."""
    rows = table(spark, folder, "part").select((F.col("p_size") > 25).alias("truth"), "p_name", "p_type")
    return prompt_study(rows, {"name": 'Does "{p_name}" mean "small steel ring"?', "type": 'Is "{p_type}" one of "promo standard"?'}, "truth", OverlapValidator())


@query("""
WITH w AS (SELECT n_regionkey, n_name, 'the ' || lower(n_name) || ' of ' || n_regionkey || ' here' AS x, 'the ' || lower(n_name) || ' of ' || n_regionkey || ' there' AS y FROM nation)
SELECT n_regionkey, (0.8 * 0.75 * (2.0 / 3) * 0.5) ** 0.25 AS bleu FROM w GROUP BY n_regionkey
""")
def bleu_of_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of five words of which four are in the best output."""
    nation = table(spark, folder, "nation")
    told = lambda end: F.concat(F.lit("the "), F.regexp_replace(F.lower("n_name"), " ", ""), F.lit(" of "), "n_regionkey", F.lit(f" {end}"))
    return bleu_representativeness(nation.select("n_regionkey", told("here").alias("x")), "x", nation.select("n_regionkey", told("there").alias("y")), "y", "n_regionkey")


@query("SELECT * FROM (VALUES ('all', 1.0, 1.0, 1.0, 1.0), ('none', -1.0, -1.0, -1.0, -1.0), ('some', (1 + 0.5) / 2, (1 + (0.5 * 0.1) ** 0.5) / 2, ((0.1) ** (1 / 3.0) + (0.5 * 0.1 * 0.1) ** (1 / 3.0)) / 2, ((0.1 * 0.1) ** 0.25 + (0.5 * 0.1 * 0.1 * 0.1) ** 0.25) / 2)) t(case_name, bleu1, bleu2, bleu3, bleu4)")
def bleu_of_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Everything, nothing and a part of the truth predicted."""
    truth = spark.createDataFrame([("red bolt",), ("blue ring",)], "t string")
    some = spark.createDataFrame([("red bolt",), ("blue nut",)], "t string")
    cases = {"all": truth, "none": truth.limit(0), "some": some}
    out = None
    for name, predicted in cases.items():
        one = calc_bleu(truth, predicted, ["t"]).select(F.lit(name).alias("case_name"), *[f"bleu{i}" for i in range(1, 5)])
        out = one if out is None else out.union(one)
    return out


# ------------------------------------------------------------------------ streams


@query("SELECT event_id, user_id, c_name, 'type: ' || event_type AS label FROM events JOIN customer ON user_id = c_custkey WHERE event_type = 'click'")
def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files as a stream through filter, join with a table and projection, into
    files that are written exactly once."""
    path = _path(spark, "incoming")
    events = table(spark, folder, "events")
    write_parquet(events.repartition(4), path)
    stream = stream_folder(spark, "events", path, events.schema)
    clicks = select(stream, HardEqual(Col("event_type"), Const("click")))
    joined = hash_join(clicks, _scan(spark, folder, "customer"), "user_id", "c_custkey")
    return run_available(project(joined, ["event_id", "user_id", "c_name", Concat(["type:", Col("event_type")], "label", " ")]), _path(spark, "stream"))


@query("""
WITH w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT * FROM w WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL '1 day'
""")
def stream_windows_real(spark: SparkSession, folder: str) -> DataFrame:
    """A stream's windows, as far as the watermark has closed them."""
    path = _path(spark, "incoming")
    events = table(spark, folder, "events")
    write_parquet(events.repartition(3), path)
    windows = windowed_aggregate(stream_folder(spark, "events", path, events.schema), "ts", "1 day", "1 day", ["event_type"], [Count("event_type", "n")])
    told = run_available(windows, _path(spark, "stream"))
    return told.select(*[F.to_timestamp_ntz(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit("yyyy-MM-dd HH:mm:ss")).alias(c) for c in ("window_start", "window_end")], "event_type", "n")


@query("""
WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
c AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT min(ts) AS window_start, max(ts) + INTERVAL '6 hours' AS window_end, user_id, count(*) AS n FROM c GROUP BY user_id, session
""")
def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions that end after six hours without an event."""
    return session_aggregate(_scan(spark, folder, "events"), "ts", "6 hours", "1 day", ["user_id"], [Count("user_id", "n")]).df


@query("SELECT a.event_id AS view_id, b.event_id AS buy_id FROM events a JOIN events b ON a.user_id = b.user_id WHERE a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL '1 hour'")
def stream_join(spark: SparkSession, folder: str) -> DataFrame:
    """Two streams joined within an hour, both with a watermark: the state that
    is kept is bounded by it."""
    path = _path(spark, "incoming")
    events = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    write_parquet(events.repartition(2), path)
    sides = [stream_folder(spark, n, path, events.schema).df.withWatermark("ts", "400 days").where(F.col("event_type") == kind).select(F.col("event_id").alias(f"{n}_id"), F.col("user_id").alias(f"{n}_user"), F.col("ts").alias(f"{n}_ts")) for n, kind in (("view", "view"), ("buy", "purchase"))]
    near = sides[0].join(sides[1], F.expr("view_user = buy_user and buy_ts >= view_ts and buy_ts <= view_ts + interval 1 hour"))
    return run_available(Relation(near.select("view_id", "buy_id"), "near"), _path(spark, "stream"))


# ---------------------------------------------------------------- problem 7


@query()
def p7_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The flat tables of the nested columns, one below the other: surrogate and
    parent keys, ordinal and the cells of the merged schema.  ``table_name`` is
    the property; it is null for what stands in none, the records' own objects
    and plain values."""
    nodes = nested_nodes(table(spark, folder, "entity"), "id", ["properties", "referents", "datasets"])
    return child_cells(nodes).withColumnRenamed("prop", "table_name")
