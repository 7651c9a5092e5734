"""Named queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semframe.functions.models import CallableValidator, EchoGenerator, HashedNgramEmbedding, LetterEmbedding, OverlapValidator
from semframe.functions.models.offline import LETTERS
from semframe.functions.serialize import plain
from semframe.functions.vector import vector_topk
from semframe.operators.aggregate import Avg, Count, CountDistinct, CustomAgg, Max, Min, SetAgg, StringAgg, Sum, hash_aggregate, soft_aggregate
from semframe.operators.cluster import DBSCANClusterer, HDBSCANClusterer, KMeansClusterer
from semframe.operators.criteria import All, AnyOf, Col, Const, FuzzyEqual, GreaterThan, HardEqual, IsNotNull, IsNull, Not, Predicate, SmallerThan, SoftEqual, SoftValidate, select
from semframe.operators.joins import fuzzy_join, hash_join, similar_pairs, soft_join, tfidf_join, theta_join
from semframe.operators.metrics import classify_one_vs_all, cluster_scores, match_metrics, threshold_sweep
from semframe.operators.nested import nested_nodes, nested_objects, nested_strings
from semframe.operators.project import Concat, Custom, Generate, Math, project
from semframe.operators.union import union
from semframe.relation import Relation
from semframe.runtime import table
from semframe.sources.catalog import TableRegistry
from semframe.sources.scan import scan, values
from semframe.streaming.streams import windowed_aggregate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function ``(spark, folder)`` under its name."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add

# ---------------------------------------------------- values, scans, selection

ORDER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _registry(spark: SparkSession, folder: str) -> TableRegistry:
    return TableRegistry.from_folder(spark, folder, ORDER_TABLES)


def _scan(spark: SparkSession, folder: str, name: str, **options) -> Relation:
    return scan(_registry(spark, folder), f"public.{name}", semantic=False, **options)


def _abc(spark: SparkSession) -> Relation:
    return values(spark, "abc", ["a", "b", "c"], [(i, i + 1, i + 2) for i in range(0, 111, 3)])


@query("SELECT i AS a, i + 1 AS b, i + 2 AS c FROM range(0, 111, 3) t(i)")
def values_inline(spark: SparkSession, folder: str) -> DataFrame:
    return _abc(spark).df


@query("SELECT * FROM orders")
def scan_exact(spark: SparkSession, folder: str) -> DataFrame:
    return _scan(spark, folder, "orders").df


@query("SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def scan_annex(spark: SparkSession, folder: str) -> DataFrame:
    return _scan(spark, folder, "orders", annex="WHERE o_orderstatus = 'F' AND o_totalprice > 300000").df


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def scan_limit_ordered(spark: SparkSession, folder: str) -> DataFrame:
    return _scan(spark, folder, "orders", annex="ORDER BY o_totalprice DESC, o_orderkey", limit=25).df


@query("SELECT * FROM orders")
def scan_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """The name ``order`` bound to ``public.orders`` by its letters, and by a
    validator that wants one quoted word to begin the other."""

    def begins(prompt: str) -> bool:
        found, asked = prompt.split('"')[1:4:2]
        return found.rpartition(".")[2].startswith(asked)

    return scan(_registry(spark, folder), "order", model=LetterEmbedding(unit=True), threshold=0.3, validator=CallableValidator(begins)).df


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'")
def select_equal(spark: SparkSession, folder: str) -> DataFrame:
    return select(_scan(spark, folder, "customer"), HardEqual(Col("c_mktsegment"), Const("BUILDING"))).df


@query("SELECT * FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'")
def select_not_equal(spark: SparkSession, folder: str) -> DataFrame:
    return select(_scan(spark, folder, "customer"), Not(HardEqual(Col("c_mktsegment"), Const("BUILDING")))).df


@query("SELECT * FROM orders WHERE (o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_totalprice > 200000")
def select_and_or(spark: SparkSession, folder: str) -> DataFrame:
    either = AnyOf([HardEqual(Col("o_orderstatus"), Const("F")), HardEqual(Col("o_orderpriority"), Const("1-URGENT"))])
    return select(_scan(spark, folder, "orders"), All([either, GreaterThan(Col("o_totalprice"), Const(200000))])).df


@query("SELECT id, name, domain, country FROM companies WHERE domain IS NULL AND country IS NOT NULL")
def select_null(spark: SparkSession, folder: str) -> DataFrame:
    rows = Relation(table(spark, folder, "companies").select("id", "name", "domain", "country"), "companies")
    return select(rows, All([IsNull(Col("domain")), IsNotNull(Col("country"))])).df


@query("SELECT * FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
def select_gt_lt(spark: SparkSession, folder: str) -> DataFrame:
    return select(_scan(spark, folder, "lineitem"), All([GreaterThan(Col("l_quantity"), Const(45)), SmallerThan(Col("l_discount"), Const(0.02))])).df


@query("SELECT p_partkey, p_name FROM part WHERE levenshtein(p_name, (SELECT min(p_name) FROM part)) <= 6")
def select_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    first = table(spark, folder, "part").agg(F.min("p_name")).first()[0]
    return project(select(_scan(spark, folder, "part"), FuzzyEqual(Col("p_name"), Const(first), 6)), ["p_partkey", "p_name"]).df


# ------------------------------------------------------------------ projection


@query("SELECT o_orderkey, o_totalprice AS price FROM orders")
def project_identity_rename(spark: SparkSession, folder: str) -> DataFrame:
    return project(_scan(spark, folder, "orders"), ["o_orderkey", ("o_totalprice", "price")]).df


@query("SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS next, l_linenumber - 1 AS prev, l_quantity * 2 AS twice, l_linenumber / 2 AS half, 10 - l_linenumber AS rest FROM lineitem")
def project_math(spark: SparkSession, folder: str) -> DataFrame:
    n = Col("l_linenumber")
    return project(_scan(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber", Math(n, "+", Const(1), "next"), Math(n, "-", Const(1), "prev"), Math(Col("l_quantity"), "*", Const(2), "twice"), Math(n, "/", Const(2), "half"), Math(Const(10), "-", n, "rest")]).df


@query('SELECT r_regionkey, 42 AS "42", 6 * 7 AS answer FROM region')
def project_const(spark: SparkSession, folder: str) -> DataFrame:
    return project(_scan(spark, folder, "region"), ["r_regionkey", Math(Const(6), "*", Const(7)), Math(Const(6), "*", Const(7), "answer")]).df


@query("SELECT id, 'name: ' || ' | ' || coalesce(name, 'None') || ' | ' || coalesce(domain, 'None') AS label FROM companies")
def project_concat(spark: SparkSession, folder: str) -> DataFrame:
    rows = Relation(table(spark, folder, "companies").select("id", "name", "domain"), "companies")
    return project(rows, ["id", Concat(["name: ", Col("name"), Col("domain")], "label", " | ")]).df


@query("SELECT p_partkey, length(p_name) AS size, upper(p_brand) AS brand FROM part")
def project_custom(spark: SparkSession, folder: str) -> DataFrame:
    return project(_scan(spark, folder, "part"), ["p_partkey", Custom(["p_name"], "size", "long", lambda s: s.str.len()), Custom(["p_brand"], "brand", "string", F.upper, kind="native")]).df


@query("SELECT p_retailprice AS price, p_partkey AS part_key FROM part")
def project_semantic(spark: SparkSession, folder: str) -> DataFrame:
    """Declared names bound to the nearest columns by letters."""
    model = LetterEmbedding(unit=True)
    return project(_scan(spark, folder, "part"), [("retail price", "price"), ("part key", "part_key")], model).df


@query("SELECT n_nationkey, lower('Tell something about ' || n_name || ' in region ' || n_regionkey) AS told FROM nation")
def project_generate(spark: SparkSession, folder: str) -> DataFrame:
    return project(_scan(spark, folder, "nation"), ["n_nationkey", Generate(["n_name", "n_regionkey"], "told", EchoGenerator(), "Tell something about {} in region {}", temperature=0)]).df


# ----------------------------------------------------------------------- joins


@query("SELECT * FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > 5000")
def join_theta(spark: SparkSession, folder: str) -> DataFrame:
    return theta_join(_scan(spark, folder, "supplier"), _scan(spark, folder, "nation"), All([SmallerThan(Col("s_nationkey"), Col("n_nationkey")), GreaterThan(Col("s_acctbal"), Const(5000))])).df


@query("SELECT * FROM customer JOIN orders ON c_custkey = o_custkey")
def join_hash(spark: SparkSession, folder: str) -> DataFrame:
    return hash_join(_scan(spark, folder, "customer"), _scan(spark, folder, "orders"), "c_custkey", "o_custkey").df


@query("SELECT * FROM (VALUES (1, 'one'), (NULL, 'none'), (2, 'two')) l(x, left_name) JOIN (VALUES (1, 'eins'), (NULL, 'nichts'), (3, 'drei')) r(y, right_name) ON x IS NOT DISTINCT FROM y")
def join_hash_nullsafe(spark: SparkSession, folder: str) -> DataFrame:
    left = values(spark, "l", ["x", "left_name"], [(1, "one"), (None, "none"), (2, "two")], "x int, left_name string")
    right = values(spark, "r", ["y", "right_name"], [(1, "eins"), (None, "nichts"), (3, "drei")], "y int, right_name string")
    return hash_join(left, right, "x", "y").df


@query('SELECT l.i AS "d1.x", l.i + 1 AS y, r.i AS "d2.x", r.i + 1 AS z FROM range(0, 100, 2) l(i) JOIN range(0, 100, 2) r(i) ON l.i = r.i')
def join_clash_names(spark: SparkSession, folder: str) -> DataFrame:
    d1 = values(spark, "d1", ["x", "y"], [(i, i + 1) for i in range(0, 100, 2)])
    d2 = values(spark, "d2", ["x", "z"], [(i, i + 1) for i in range(0, 100, 2)])
    return hash_join(d1, d2, "d1.x", "d2.x").df


DISTINCT_PARTS = "(SELECT DISTINCT p_name AS n FROM part)"


@query(f"SELECT a.n AS l, b.n AS r FROM {DISTINCT_PARTS} a, {DISTINCT_PARTS} b WHERE levenshtein(a.n, b.n) <= 3")
def join_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select("p_name").distinct()
    return fuzzy_join(Relation(names.withColumnRenamed("p_name", "l"), "a"), Relation(names.withColumnRenamed("p_name", "r"), "b"), "l", "r", 3).df


@query(f"""
WITH n AS (SELECT n, list_filter(regexp_split_to_array(lower(n), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS ws FROM {DISTINCT_PARTS}),
tf AS (SELECT n, w, count(*) AS tf FROM (SELECT n, unnest(ws) AS w FROM n) GROUP BY ALL),
idf AS (SELECT w, ln((1 + 2 * (SELECT count(*) FROM n)) / (1 + 2 * count(*))) + 1 AS idf FROM tf GROUP BY w),
x AS (SELECT n, w, tf * idf AS x FROM tf JOIN idf USING (w)), u AS (SELECT n, w, x / sqrt(sum(x * x) OVER (PARTITION BY n)) AS u FROM x)
SELECT a.n AS l, b.n AS r FROM u a JOIN u b USING (w) GROUP BY ALL HAVING sum(a.u * b.u) > 0.6
""")
def join_tfidf(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select("p_name").distinct()
    return tfidf_join(Relation(names.withColumnRenamed("p_name", "l"), "a"), Relation(names.withColumnRenamed("p_name", "r"), "b"), "l", "r", 0.6).df


# ----------------------------------------------------------------- aggregation


def _lines(spark: SparkSession, folder: str) -> Relation:
    return _scan(spark, folder, "lineitem")


@query("SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS total FROM lineitem GROUP BY ALL")
def agg_sum(spark: SparkSession, folder: str) -> DataFrame:
    return hash_aggregate(_lines(spark, folder), ["l_returnflag", "l_linestatus"], [Sum("l_linenumber", "total")]).df


@query("SELECT l_returnflag, min(l_extendedprice) AS least, max(l_shipdate) AS latest FROM lineitem GROUP BY ALL")
def agg_min_max(spark: SparkSession, folder: str) -> DataFrame:
    return hash_aggregate(_lines(spark, folder), ["l_returnflag"], [Min("l_extendedprice", "least"), Max("l_shipdate", "latest")]).df


@query("SELECT country, count(*) AS n, count(domain) AS known FROM companies GROUP BY ALL")
def agg_count(spark: SparkSession, folder: str) -> DataFrame:
    rows = Relation(table(spark, folder, "companies").select("country", "domain"), "companies")
    return hash_aggregate(rows, ["country"], [Count("domain", "n"), Count("domain", "known", skip_nulls=True)]).df


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def agg_count_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return hash_aggregate(_scan(spark, folder, "events"), ["event_type"], [CountDistinct("user_id", "users")]).df


@query("SELECT l_returnflag, avg(l_quantity) AS mean FROM lineitem GROUP BY ALL")
def agg_avg(spark: SparkSession, folder: str) -> DataFrame:
    return hash_aggregate(_lines(spark, folder), ["l_returnflag"], [Avg("l_quantity", "mean")]).df


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY ALL")
def agg_string(spark: SparkSession, folder: str) -> DataFrame:
    return hash_aggregate(_scan(spark, folder, "nation"), ["n_regionkey"], [StringAgg("n_name", "names", "; ")]).df


@query("SELECT c_mktsegment, list_sort(list(DISTINCT c_nationkey)) AS nations FROM customer GROUP BY ALL")
def agg_set(spark: SparkSession, folder: str) -> DataFrame:
    return hash_aggregate(_scan(spark, folder, "customer"), ["c_mktsegment"], [SetAgg("c_nationkey", "nations")]).df


@query("SELECT sum(o_orderkey) AS total, count(*) AS n FROM orders")
def agg_global(spark: SparkSession, folder: str) -> DataFrame:
    return hash_aggregate(_scan(spark, folder, "orders"), [], [Sum("o_orderkey", "total"), Count("o_orderkey", "n")]).df


@query("SELECT * FROM (SELECT sum(o_orderkey) AS total, count(*) AS n FROM orders WHERE o_orderkey < 0) WHERE n > 0")
def agg_global_empty(spark: SparkSession, folder: str) -> DataFrame:
    none = select(_scan(spark, folder, "orders"), SmallerThan(Col("o_orderkey"), Const(0)))
    return hash_aggregate(none, [], [Sum("o_orderkey", "total"), Count("o_orderkey", "n")]).df


@query("SELECT s_nationkey, max(s_suppkey) - min(s_suppkey) AS spread, sum(s_suppkey) AS folded FROM supplier GROUP BY ALL")
def agg_custom(spark: SparkSession, folder: str) -> DataFrame:
    return hash_aggregate(_scan(spark, folder, "supplier"), ["s_nationkey"], [CustomAgg("s_suppkey", "spread", "long", function=lambda v: max(v) - min(v)), CustomAgg("s_suppkey", "folded", "long", fold=lambda a, b: a + b)]).df


@query("SELECT c_mktsegment, sum(o_orderkey) AS total, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY ALL")
def pipeline_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Hash join, filter, projection and grouping in one plan."""
    joined = hash_join(_scan(spark, folder, "customer"), _scan(spark, folder, "orders"), "c_custkey", "o_custkey")
    finished = project(select(joined, HardEqual(Col("o_orderstatus"), Const("F"))), ["c_mktsegment", "o_orderkey"])
    return hash_aggregate(finished, ["c_mktsegment"], [Sum("o_orderkey", "total"), Count("o_orderkey", "orders")]).df


# ------------------------------------------------------------------------ sets


@query("SELECT s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def union_all(spark: SparkSession, folder: str) -> DataFrame:
    a = project(_scan(spark, folder, "supplier"), [("s_suppkey", "key"), ("s_name", "name")])
    b = project(_scan(spark, folder, "customer"), [("c_custkey", "id"), ("c_name", "title")])
    return union([a, b]).df


@query("SELECT n_nationkey AS a, n_regionkey AS b FROM nation UNION ALL SELECT n_regionkey, n_nationkey FROM nation")
def union_renamed(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the first relation, positions of the second."""
    nation = _scan(spark, folder, "nation")
    return union([project(nation, [("n_nationkey", "a"), ("n_regionkey", "b")]), project(nation, [("n_regionkey", "b"), ("n_nationkey", "a")])]).df


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark: SparkSession, folder: str) -> DataFrame:
    return union([project(_scan(spark, folder, "supplier"), [("s_nationkey", "k")]), project(_scan(spark, folder, "customer"), [("c_nationkey", "k")])], distinct=True).df


# ------------------------------------------------------------------------ soft


def _letters(text: str) -> str:
    """SQL for the letter counts of a text."""
    return "[" + ", ".join(f"(length(lower({text})) - length(replace(lower({text}), '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


PART_VECTORS = f"(SELECT n, {_letters('n')} AS v FROM {DISTINCT_PARTS})"
UNIT = LetterEmbedding(unit=True)


def _part_names(spark: SparkSession, folder: str, column: str, name: str) -> Relation:
    return Relation(table(spark, folder, "part").select(F.col("p_name").alias(column)).distinct(), name)


@query(f"SELECT p_partkey, p_name FROM part WHERE list_cosine_similarity({_letters('p_name')}, {_letters(chr(39) + 'small copper ring' + chr(39))}) >= 0.7123")
def soft_filter_threshold(spark: SparkSession, folder: str) -> DataFrame:
    rows = project(_scan(spark, folder, "part"), ["p_partkey", "p_name"])
    return select(rows, SoftEqual(Col("p_name"), Const("small copper ring"), LetterEmbedding(), method="threshold", threshold=0.7123)).df


@query(f"SELECT p_partkey, p_name FROM part WHERE list_cosine_similarity({_letters('p_name')}, {_letters(chr(39) + 'small copper ring' + chr(39))}) >= 0.5123 AND len(list_intersect(string_split(lower(p_name), ' '), ['small', 'copper', 'ring'])) >= 1")
def soft_filter_both(spark: SparkSession, folder: str) -> DataFrame:
    rows = project(_scan(spark, folder, "part"), ["p_partkey", "p_name"])
    return select(rows, SoftEqual(Col("p_name"), Const("small copper ring"), LetterEmbedding(), OverlapValidator(), threshold=0.5123)).df


@query(f"SELECT p_partkey, p_name, p_brand FROM part WHERE list_cosine_similarity({_letters(chr(40) + 'p_name || ' + chr(39) + ', ' + chr(39) + ' || p_brand' + chr(41))}, {_letters(chr(39) + 'steel brand' + chr(39))}) >= 0.6123")
def soft_filter_record(spark: SparkSession, folder: str) -> DataFrame:
    rows = project(_scan(spark, folder, "part"), ["p_partkey", "p_name", "p_brand"])
    return select(rows, SoftEqual(["p_name", "p_brand"], Const("steel brand"), LetterEmbedding(), method="threshold", threshold=0.6123)).df


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%' AND len(list_intersect(string_split(lower(p_name), ' '), ['large', 'small', 'red', 'blue', 'steel'])) >= 1")
def soft_validate(spark: SparkSession, folder: str) -> DataFrame:
    rows = project(_scan(spark, folder, "part"), ["p_partkey", "p_name"])
    asked = SoftValidate('Is "{p_name}" one of "large small red blue steel"?', OverlapValidator())
    return select(rows, All([asked, Predicate(["p_name"], lambda n: n.contains("e"))])).df


@query(f"SELECT a.n AS l, b.n AS r FROM {PART_VECTORS} a, {PART_VECTORS} b WHERE list_cosine_similarity(a.v, b.v) > 0.85")
def soft_join_full(spark: SparkSession, folder: str) -> DataFrame:
    return soft_join(_part_names(spark, folder, "l", "a"), _part_names(spark, folder, "r", "b"), method="threshold", threshold=0.85, model=UNIT, serializer=plain).df


@query(f"SELECT a.n AS l, b.n AS r FROM {PART_VECTORS} a, {PART_VECTORS} b WHERE list_cosine_similarity(a.v, b.v) > 0.85")
def soft_join_field(spark: SparkSession, folder: str) -> DataFrame:
    """One field: the mean of its vectors is its vector."""
    return soft_join(_part_names(spark, folder, "l", "a"), _part_names(spark, folder, "r", "b"), method="threshold", form="FIELD_SERIALIZED", threshold=0.85, model=UNIT).df


@query(f"SELECT a.n AS l, b.n AS r FROM {PART_VECTORS} a, {PART_VECTORS} b WHERE list_cosine_similarity(a.v, b.v) > 0.85")
def soft_join_column(spark: SparkSession, folder: str) -> DataFrame:
    return soft_join(_part_names(spark, folder, "l", "a"), _part_names(spark, folder, "r", "b"), method="threshold", comparison="COLUMN_WISE", columns_left=["l"], columns_right=["r"], threshold=0.85, model=UNIT).df


@query(f"SELECT a.n AS l, b.r FROM {DISTINCT_PARTS} a, (VALUES ('large red'), ('steel'), ('a small one')) b(r) WHERE len(list_intersect(list_distinct(string_split(lower(a.n), ' ')), string_split(b.r, ' '))) >= 1")
def soft_join_zero_shot(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair is asked about, which is what the method is."""
    asked = values(spark, "asked", ["r"], [("large red",), ("steel",), ("a small one",)])
    return soft_join(_part_names(spark, folder, "l", "a"), asked, method="zero-shot-prompting", validator=OverlapValidator()).df


@query(f"SELECT a.n AS l, b.n AS r FROM {PART_VECTORS} a, {PART_VECTORS} b WHERE list_cosine_similarity(a.v, b.v) > 0.7123 AND len(list_intersect(string_split(lower(a.n), ' '), string_split(lower(b.n), ' '))) >= 1")
def soft_join_both(spark: SparkSession, folder: str) -> DataFrame:
    return soft_join(_part_names(spark, folder, "l", "a"), _part_names(spark, folder, "r", "b"), threshold=0.7123, model=UNIT, validator=OverlapValidator(), serializer=plain).df


@query("SELECT a.vec_id AS l, b.vec_id AS r FROM embeddings a, embeddings b WHERE a.vec_id < b.vec_id AND list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.4")
def soft_join_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Stored vectors in place of a model."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return similar_pairs(rows.withColumnRenamed("vec_id", "l"), rows.withColumnRenamed("vec_id", "r"), 0.4).where("l < r").select("l", "r")


@query("SELECT vec_id, label FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), vec_id LIMIT 10")
def topk_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    asked = rows.orderBy("vec_id").select("embedding").first()[0]
    return vector_topk(rows, "embedding", asked, 10, "l2", tie="vec_id").select("vec_id", "label")


@query(f"""
WITH RECURSIVE v AS (SELECT * FROM {PART_VECTORS}),
near AS (SELECT a.n AS x, b.n AS y FROM v a, v b WHERE list_distance(a.v, b.v) <= 2.1),
reach(x, y) AS (SELECT x, y FROM near UNION SELECT r.x, n.y FROM reach r JOIN near n ON r.y = n.x),
label AS (SELECT x, min(y) AS low FROM reach GROUP BY x)
SELECT list_sort(list(x)) AS p_name, count(*) AS n FROM label GROUP BY low
""")
def soft_agg_dbscan(spark: SparkSession, folder: str) -> DataFrame:
    names = _part_names(spark, folder, "p_name", "part")
    return soft_aggregate(names, ["p_name"], [Count("p_name", "n")], LetterEmbedding(), DBSCANClusterer(2.1, 1), serializer=plain).df


@query()
def soft_agg_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return soft_aggregate(_part_names(spark, folder, "p_name", "part"), ["p_name"], [Count("p_name", "n")], HashedNgramEmbedding(64), KMeansClusterer(relative=0.2), summary=EchoGenerator()).df


@query()
def soft_agg_hdbscan(spark: SparkSession, folder: str) -> DataFrame:
    return soft_aggregate(_part_names(spark, folder, "p_name", "part"), ["p_name"], [Count("p_name", "n")], HashedNgramEmbedding(64), HDBSCANClusterer(3)).df


# ------------------------------------------------------------------ evaluation


@query(f"SELECT a.n AS p_name, c.class FROM {PART_VECTORS} a, (SELECT class, {_letters('class')} AS v FROM (VALUES ('steel'), ('copper'), ('ring'), ('bolt')) t(class)) c WHERE list_cosine_similarity(a.v, c.v) > 0.6123")
def classify(spark: SparkSession, folder: str) -> DataFrame:
    classes = values(spark, "classes", ["class"], [("steel",), ("copper",), ("ring",), ("bolt",)])
    return classify_one_vs_all(_part_names(spark, folder, "p_name", "part"), classes, ["p_name"], "class", UNIT, 0.6123).df


@query("""
WITH s AS (SELECT o_totalprice / 500000 AS score, o_orderstatus = 'F' AS truth FROM orders),
t AS (SELECT unnest([0.2, 0.4, 0.6]) AS threshold),
c AS (SELECT threshold, count_if(score >= threshold AND truth) AS tp, count_if(score >= threshold AND NOT truth) AS fp, count_if(score < threshold AND truth) AS fn FROM t, s GROUP BY threshold)
SELECT threshold, tp, fp, fn, tp / greatest(tp + fp, 1) AS precision, tp / greatest(tp + fn, 1) AS recall, 2 * tp / greatest(2 * tp + fp + fn, 1) AS f1 FROM c
""")
def sweep(spark: SparkSession, folder: str) -> DataFrame:
    scored = table(spark, folder, "orders").select((F.col("o_totalprice") / 500000).alias("score"), (F.col("o_orderstatus") == "F").alias("truth"))
    return threshold_sweep(scored, "score", "truth", [0.2, 0.4, 0.6]).withColumn("threshold", F.col("threshold").cast("decimal(2,1)"))


@query("""
WITH t AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT o_orderkey FROM orders WHERE o_orderpriority < '3')
, c AS (SELECT (SELECT count(*) FROM t SEMI JOIN p USING (o_orderkey)) AS tp, (SELECT count(*) FROM p ANTI JOIN t USING (o_orderkey)) AS fp, (SELECT count(*) FROM t ANTI JOIN p USING (o_orderkey)) AS fn)
SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c
""")
def prf_metrics(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    return match_metrics(orders.where("o_orderstatus = 'F'"), orders.where("o_orderpriority < '3'"), ["o_orderkey"])


@query("""
WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*)::DOUBLE AS n FROM lineitem GROUP BY ALL),
r AS (SELECT a, sum(n) AS n FROM c GROUP BY a), s AS (SELECT b, sum(n) AS n FROM c GROUP BY b),
t AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS met, sum(n * ln(n)) AS nlog FROM c),
u AS (SELECT t.*, (SELECT sum(n * (n - 1) / 2) FROM r) AS pa, (SELECT sum(n * (n - 1) / 2) FROM s) AS pb, (SELECT sum(n * ln(n)) FROM r) AS alog, (SELECT sum(n * ln(n)) FROM s) AS blog, n * (n - 1) / 2 AS pairs FROM t),
v AS (SELECT *, greatest(0, (nlog - alog - blog) / n + ln(n)) AS mi, ln(n) - alog / n AS ha, ln(n) - blog / n AS hb, pa * pb / pairs AS ex FROM u),
k AS (SELECT r.n AS a, s.n AS b, u.n AS n, unnest(range(greatest(1, r.n + s.n - u.n)::BIGINT, least(r.n, s.n)::BIGINT + 1)) AS k FROM r, s, u),
e AS (SELECT sum(k / n * ln(n * k / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(n - a + 1) + lgamma(n - b + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(a - k + 1) - lgamma(b - k + 1) - lgamma(n - a - b + k + 1))) AS emi FROM k)
SELECT unnest(['rand', 'ari', 'fmi', 'mi', 'ami', 'nmi', 'homogeneity', 'completeness', 'v_measure']) AS score,
  unnest([round((pairs + 2 * met - pa - pb) / pairs, 6), round((met - ex) / ((pa + pb) / 2 - ex), 6), round(met / sqrt(pa * pb), 6), round(mi, 6), round((mi - emi) / ((ha + hb) / 2 - emi), 6), round(mi / ((ha + hb) / 2), 6), round(mi / ha, 6), round(mi / hb, 6), round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6)]) AS value FROM v, e
""")
def scores_of_clusters(spark: SparkSession, folder: str) -> DataFrame:
    told = cluster_scores(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")
    return spark.createDataFrame([(k, round(v, 6)) for k, v in sorted(told.items())], "score string, value double")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS window_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The batch form of the windowed stream."""
    return windowed_aggregate(_scan(spark, folder, "events"), "ts", "1 day", "1 day", ["event_type"], [Count("event_type", "n")]).df


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Soft filter, hash join, grouping and text generation in one plan."""
    parts = select(_scan(spark, folder, "part"), SoftEqual(Col("p_name"), Const("small copper ring"), LetterEmbedding(), method="threshold", threshold=0.6))
    sold = hash_join(project(parts, ["p_partkey", "p_name"]), project(_lines(spark, folder), ["l_partkey", "l_quantity"]), "p_partkey", "l_partkey")
    totals = hash_aggregate(sold, ["p_name"], [Sum("l_quantity", "quantity"), Count("p_partkey", "lines")])
    return project(totals, ["p_name", "quantity", "lines", Generate(["p_name"], "told", EchoGenerator(), "Describe {}", temperature=0)]).df


# ---------------------------------------------------------------- problem 7


def _readable(text: str) -> str:
    """SQL for the JSON value of a text, unwrapped three times, or null."""
    value = f"CASE WHEN json_valid({text}) THEN {text}::JSON END"
    for _ in range(3):
        value = f"(SELECT CASE WHEN json_type(v) = 'VARCHAR' AND json_valid(v->>'$') THEN (v->>'$')::JSON ELSE v END FROM (SELECT {value} AS v))"
    return value


def _strings(column: str) -> str:
    """SQL for the strings of a JSON column of lists or single values."""
    return f"""SELECT id AS record_id, id AS parent_id, '{column}' AS prop, x->>'$' AS child_id FROM (
        SELECT id, unnest(CASE WHEN json_type(v) = 'ARRAY' THEN v::JSON[] ELSE [v] END) AS x FROM (SELECT id, {_readable(column)} AS v FROM entity)
    ) WHERE json_type(x) = 'VARCHAR'"""


@query(f"""
WITH RECURSIVE node(record_id, parent_id, prop, v) AS (
    SELECT id, id, NULL::VARCHAR, {_readable("properties")} FROM entity
    UNION ALL
    SELECT record_id, coalesce(CASE WHEN json_type(v) = 'OBJECT' THEN v->>'id' END, parent_id), CASE WHEN json_type(v) = 'ARRAY' THEN prop ELSE part.k END, part.x
    FROM (SELECT record_id, parent_id, prop, v, unnest(CASE json_type(v)
        WHEN 'ARRAY' THEN list_transform(v::JSON[], lambda x: {{'k': NULL::VARCHAR, 'x': x}})
        WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: {{'k': k, 'x': json_extract(v, '$."' || k || '"')}})
        END) AS part FROM node WHERE json_type(v) IN ('ARRAY', 'OBJECT')))
SELECT DISTINCT record_id, parent_id, prop, v->>'id' AS child_id FROM node WHERE json_type(v) = 'OBJECT' AND v->>'id' IS NOT NULL AND prop IS NOT NULL
UNION {_strings("referents")}
UNION {_strings("datasets")}
""")
def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    nodes = nested_nodes(table(spark, folder, "entity"), "id", ["properties", "referents", "datasets"])
    found = nested_objects(nodes.where("source = 'properties'")).select("record_id", "parent_id", "prop", "child_id")
    strings = nested_strings(nodes.where("source <> 'properties'"))
    found = found.union(strings.select("record_id", F.col("record_id").alias("parent_id"), F.col("source").alias("prop"), "child_id"))
    return found.where("record_id is not null").distinct()
