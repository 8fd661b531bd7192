"""The catalogue: each operator on the tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric, text
from .operators import aggregate as agg
from .operators import categorical, folds, joins, missing, partitions, statistics, variations
from .operators.position import POS, with_position
from .spec import selectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        ORACLE[name or f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _order_features(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"), (F.max("l_discount") + F.lit(0.0)).alias("discount"))


@query("""
WITH x AS (SELECT l_orderkey, count(*) AS n_lines, round(sum(l_quantity), 2) AS quantity, max(l_discount) + 0.0 AS discount FROM lineitem GROUP BY 1)
SELECT l_orderkey, n_lines, quantity, discount, o_totalprice, c_mktsegment, n_name,
  CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'test' ELSE 'predict' END AS partition
FROM x JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
""")
def flagship(spark, sf):
    x, orders = _order_features(spark, sf), table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    customers, nations = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), table(spark, sf, "nation").select("n_nationkey", "n_name")
    x, _ = joins.contract_join(x, orders, ["l_orderkey"], ["o_orderkey"], "1:1", "complete", "targets")
    x, _ = joins.contract_join(x, customers, ["o_custkey"], ["c_custkey"], "m:1", "complete", "customers")
    x, _ = joins.contract_join(x, nations, ["c_nationkey"], ["n_nationkey"], "m:1", "complete", "nations")
    x = partitions.by_column(x, "o_orderstatus", {"train": ["F"], "test": ["O"], "predict": ["P"]}, out="partition")
    return x.select("l_orderkey", "n_lines", "quantity", "discount", "o_totalprice", "c_mktsegment", "n_name", "partition")


def _selected(name: str, source: str, selector, sql: str) -> None:
    def run(spark, sf):
        df = table(spark, sf, source)
        return df.select(*selectors.resolve(selector, selectors.headers(df)))

    query(sql, name)(run)


_selected("select_positional", "part", [0, -1], "SELECT p_partkey, p_retailprice FROM part")
_selected("select_slice", "lineitem", "0:8:2", "SELECT l_orderkey, l_suppkey, l_quantity, l_discount FROM lineitem")
_selected("select_names", "part", ["p_name", "p_size"], "SELECT p_name, p_size FROM part")
_selected("select_range", "lineitem", {"name_range": ["l_tax", "l_quantity"]}, "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
_selected("select_regex", "part", {"regex": "(name|brand)$"}, "SELECT p_name, p_brand FROM part")
_selected("select_dtype", "part", {"dtype": "string"}, "SELECT p_name, p_brand, p_type FROM part")
_selected("select_auto", "part", {"auto": "features"}, "SELECT p_partkey, p_size, p_retailprice FROM part")


@query("SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def select_rest(spark, sf):
    df = table(spark, sf, "lineitem")
    roles = selectors.split_roles(selectors.headers(df), [("ignore", {"regex": "key$|number$"}), ("features", "rest")])
    return df.select(*roles["features"])


@query("SELECT * FROM (VALUES ('features', 4), ('metadata', 5), ('targets', 2)) t(role, n_columns)")
def role_split(spark, sf):
    df = table(spark, sf, "lineitem")
    roles = selectors.split_roles(selectors.headers(df), [("features", {"name_range": ["l_quantity", "l_tax"]}), ("targets", ["l_returnflag", "l_linestatus"]), ("metadata", "rest")])
    return spark.createDataFrame([(r, len(c)) for r, c in sorted(roles.items()) if c], "role string, n_columns int")


@query("SELECT doc_id, quality, toxic, lang, n_chars FROM labels JOIN documents USING (doc_id)")
def join_1to1_complete(spark, sf):
    return joins.contract_join(table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"], coverage="complete")[0]


@query("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def join_1to1_warn(spark, sf):
    return joins.contract_join(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"], coverage="warn")[0]


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id)")
def join_1to1_drop(spark, sf):
    return joins.contract_join(table(spark, sf, "documents").select("doc_id", "lang"), table(spark, sf, "labels"), ["doc_id"], coverage="drop")[0]


@query("SELECT DISTINCT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def join_drop_audit(spark, sf):
    return joins.unmatched_keys(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"], ["doc_id"])


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_m1_lookup(spark, sf):
    x = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    for name, left, right in (("customer", "o_custkey", "c_custkey"), ("nation", "c_nationkey", "n_nationkey"), ("region", "n_regionkey", "r_regionkey")):
        x, _ = joins.contract_join(x, table(spark, sf, name), [left], [right], "m:1", "complete", name)
    return x.select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_1m_expand(spark, sf):
    return joins.contract_join(table(spark, sf, "orders").select("o_orderkey"), table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["o_orderkey"], ["l_orderkey"], "1:m", "warn")[0]


@query("""
WITH a AS (SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, l_partkey, max(l_quantity) AS most FROM lineitem GROUP BY ALL)
SELECT l_suppkey, l_partkey, n, most FROM a JOIN b USING (l_suppkey, l_partkey)
""")
def join_composite(spark, sf):
    items = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey")
    return joins.contract_join(items.agg(F.count("*").alias("n")), items.agg(F.max("l_quantity").alias("most")), ["l_suppkey", "l_partkey"])[0]


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON CAST(c_nationkey AS DOUBLE) = n_nationkey")
def join_typed_keys(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("double").alias("k"))
    return joins.contract_join(left, table(spark, sf, "nation").select("n_nationkey", "n_name"), ["k"], ["n_nationkey"], "m:1")[0].drop("k")


@query("SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON nullif(c_nationkey, 3) = n_nationkey")
def join_missing_keys(spark, sf):
    left = table(spark, sf, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("k"))
    return joins.contract_join(left, table(spark, sf, "nation").select("n_nationkey", "n_name"), ["k"], ["n_nationkey"], "m:1", "warn")[0].drop("k")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_key_report(spark, sf):
    return joins.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
WITH a AS (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS m FROM lineitem GROUP BY 1)
SELECT count(n) AS n_left, count(m) AS n_right, count(*) FILTER (m IS NULL) AS n_missing, count(*) FILTER (n IS NULL) AS n_extra, count(*) FILTER (n > 1) AS n_duplicates FROM a FULL JOIN b USING (k)
""")
def coverage_audit(spark, sf):
    return statistics.coverage_audit(table(spark, sf, "orders"), table(spark, sf, "lineitem"), "o_orderkey", "l_orderkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def position_stamp(spark, sf):
    return with_position(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", out="pos")


@query("""
WITH a AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_custkey, max(o_totalprice) AS most FROM orders GROUP BY 1), c AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY 1)
SELECT o_custkey, n, most, first FROM a JOIN b USING (o_custkey) JOIN c USING (o_custkey)
""")
def by_key_merge(spark, sf):
    by = table(spark, sf, "orders").groupBy("o_custkey")
    return joins.merge_by_key([by.agg(F.count("*").alias("n")), by.agg(F.max("o_totalprice").alias("most")), by.agg(F.min("o_orderkey").alias("first"))], ["o_custkey"])


@query("""
SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS __pos, p_partkey, p_size, p_retailprice, p_size AS b__p_size FROM part
""")
def concat_features_row_order(spark, sf):
    p = with_position(table(spark, sf, "part"), "p_partkey")
    return joins.concat_features([p.select(POS, "p_partkey", "p_size"), p.select(POS, "p_retailprice", "p_size")], ["a", "b"])


@query("""
SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment, CAST(NULL AS DOUBLE) AS balance, 'customer' AS origin FROM customer
UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal, 'supplier' FROM supplier
""")
def concat_samples(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_name AS name", "c_mktsegment AS segment")
    s = table(spark, sf, "supplier").selectExpr("s_suppkey AS k", "s_name AS name", "s_acctbal AS balance")
    return joins.concat_samples({"customer": c, "supplier": s})


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(\.[A-Za-z0-9]+)\.(gz|zip)$', ''), '\.[A-Za-z0-9]+$', '') AS stem FROM pages
""")
def filename_stem(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.filename_stem(F.col("url")).alias("stem"))


@query(r"SELECT regexp_replace(c_name, '\d{2}$', '') AS base, count(*) AS n FROM customer GROUP BY 1")
def derive_strip_suffix(spark, sf):
    return table(spark, sf, "customer").groupBy(text.strip_suffix(F.col("c_name"), r"\d{2}$").alias("base")).agg(F.count("*").alias("n"))


def _partial(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")


_PARTIAL = "(SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"""
SELECT 'doc_id' AS column_name, count(*) - count(doc_id) AS n_missing FROM {_PARTIAL} UNION ALL SELECT 'lang', count(*) - count(lang) FROM {_PARTIAL}
UNION ALL SELECT 'quality', count(*) - count(quality) FROM {_PARTIAL} UNION ALL SELECT 'toxic', count(*) - count(toxic) FROM {_PARTIAL}
""")
def na_report(spark, sf):
    return missing.na_report(_partial(spark, sf), ["doc_id", "lang", "quality", "toxic"])


@query(f"SELECT * FROM {_PARTIAL} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def na_remove_sample(spark, sf):
    return missing.remove_sample(_partial(spark, sf), ["quality", "toxic"])


@query(f"SELECT doc_id, lang FROM {_PARTIAL}")
def na_remove_feature(spark, sf):
    return missing.remove_feature(_partial(spark, sf), ["lang", "quality", "toxic"])


_HOLES = "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 5 <> 0 THEN value * 2 END AS b, CASE WHEN event_id % 7 <> 0 THEN value * 4 END AS c FROM events"


def _holes(spark, sf) -> DataFrame:
    e, v = table(spark, sf, "events"), F.col("value")
    return e.select("event_id", *[F.when(F.col("event_id") % m != 0, v * k).alias(n) for n, m, k in (("a", 3, 1), ("b", 5, 2), ("c", 7, 4))])


@query(f"SELECT event_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM ({_HOLES})")
def na_fill_value(spark, sf):
    return missing.fill_value(_holes(spark, sf), ["a", "b", "c"])


@query(f"SELECT event_id, a, coalesce(b, a) AS b, coalesce(c, b, a) AS c FROM ({_HOLES})")
def na_ffill(spark, sf):
    return missing.fill_across(_holes(spark, sf), ["a", "b", "c"])


@query(f"SELECT event_id, coalesce(a, b, c) AS a, coalesce(b, c) AS b, c FROM ({_HOLES})")
def na_bfill(spark, sf):
    return missing.fill_across(_holes(spark, sf), ["a", "b", "c"], backward=True)


@query(f"SELECT event_id FROM ({_HOLES}) WHERE a IS NULL OR b IS NULL")
def na_deferred_flag(spark, sf):
    return missing.flag_for_removal(_holes(spark, sf), ["a", "b"], "gone").where("gone").select("event_id")


_CELL = "CASE WHEN event_id % 4 = 0 THEN ' 12' WHEN event_id % 4 = 1 THEN '1d' WHEN event_id % 4 = 2 THEN 'NaN' ELSE CAST(event_id AS VARCHAR) || '.5e1' END"


@query(f"SELECT event_id, CASE WHEN event_id % 4 = 3 THEN (event_id + 0.5::DOUBLE) * 10 END AS x, event_id % 4 = 2 AS missing FROM events")
def numeric_text_parse(spark, sf):
    cell = F.expr(_CELL.replace("VARCHAR", "STRING"))
    e = table(spark, sf, "events").withColumn("cell", cell)
    return e.select("event_id", numeric.parse_number(F.col("cell")).alias("x"), missing.na_to_null("cell").isNull().alias("missing"))


@query("SELECT o_orderkey, (9007199254740992 + o_orderkey) % 2 = 0 AS exact FROM orders")
def exact_integer_gate(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", numeric.exact_in_double(F.lit(2**53) + F.col("o_orderkey")).alias("exact"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS FLOAT) AS DOUBLE) AS x FROM orders")
def f32_round(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", numeric.to_float32(F.col("o_totalprice")).cast("double").alias("x"))


_BOOK = "SELECT o_orderpriority AS label, CAST(row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS DOUBLE) AS code FROM orders GROUP BY 1"


@query(f"SELECT o_orderkey, code FROM orders JOIN ({_BOOK}) ON label = o_orderpriority")
def factorize_target(spark, sf):
    return categorical.factorize(table(spark, sf, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "code")


@query("SELECT o_orderkey, o_orderpriority AS label FROM orders")
def decode_codebook(spark, sf):
    o = table(spark, sf, "orders")
    coded = categorical.factorize(o, "o_orderpriority", "o_orderkey")
    return categorical.decode(coded, "code", categorical.codebook(o, "o_orderpriority", "o_orderkey")).select("o_orderkey", "label")


_LISTS = {"train": ["f"], "test": ["O"]}


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' ELSE 'test' END AS partition FROM orders WHERE o_orderstatus IN ('F', 'O')")
def partition_by_column_drop(spark, sf):
    return partitions.by_column(table(spark, sf, "orders"), "o_orderstatus", _LISTS, "drop", "partition").select("o_orderkey", "partition")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'test' ELSE 'train' END AS partition FROM orders")
def partition_by_column_train(spark, sf):
    return partitions.by_column(table(spark, sf, "orders"), "o_orderstatus", _LISTS, "train", "partition").select("o_orderkey", "partition")


@query("SELECT n_nationkey, n_name, CASE WHEN n_nationkey < 12 THEN 'train' ELSE 'test' END AS partition FROM nation WHERE n_nationkey < 20")
def partition_by_index(spark, sf):
    n = with_position(table(spark, sf, "nation"), "n_nationkey", out="pos")
    return partitions.by_index(n, "pos", {"train": list(range(12)), "test": list(range(12, 20))}, "partition").select("n_nationkey", "n_name", "partition")


@query("""
WITH f AS (SELECT DISTINCT c_mktsegment AS v, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS fold FROM customer)
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN v = c_mktsegment THEN 'val' ELSE 'train' END AS side, c_custkey FROM customer, f
""")
def folds_by_column(spark, sf):
    return partitions.folds_by_column(table(spark, sf, "customer"), "c_mktsegment", "c_custkey")


@query("SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN c_custkey % 5 = fold THEN 'val' ELSE 'train' END AS side, c_custkey FROM customer, range(5) f(fold)")
def folds_assignment(spark, sf):
    return partitions.folds_by_assignment(table(spark, sf, "customer"), F.col("c_custkey") % 5, 5, "c_custkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS train_pos FROM orders WHERE o_orderstatus = 'F'")
def fold_positions(spark, sf):
    o = partitions.by_column(with_position(table(spark, sf, "orders"), "o_orderkey"), "o_orderstatus", _LISTS, "drop")
    return partitions.fold_positions(o, POS).select("o_orderkey", "train_pos")


@query("""
WITH n AS (SELECT fold, n_nationkey, CASE WHEN n_nationkey % 3 = fold THEN 'val' ELSE 'train' END AS side FROM nation, range(3) f(fold) WHERE n_nationkey < 18)
SELECT CAST(fold AS INTEGER) AS fold, side, n_nationkey FROM n
""")
def folds_inline(spark, sf):
    n = partitions.by_index(with_position(table(spark, sf, "nation"), "n_nationkey"), POS, {"train": list(range(18)), "test": list(range(18, 25))})
    listed = folds.listed(spark, [{"train": [i for i in range(18) if i % 3 != k], "val": list(range(k, 18, 3))} for k in range(3)])
    return folds.provenance(n, folds.translated(n, listed), "n_nationkey")


@query("SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN o_orderkey % 4 = fold THEN 'val' ELSE 'train' END AS side, o_orderkey AS pos FROM orders, range(4) f(fold)")
def folds_of_assignments(spark, sf):
    rows = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("fold"), F.col("o_orderkey").alias("sample_id"))
    return folds.from_assignments(rows)


@query("""
WITH l AS (SELECT o_orderkey AS pos, o_orderkey % 2 = 0 AS a, o_orderkey % 3 = 0 AS b FROM orders)
SELECT CAST(0 AS INTEGER) AS fold, CASE WHEN a THEN 'train' ELSE 'val' END AS side, pos FROM l WHERE a OR b
UNION ALL SELECT CAST(1 AS INTEGER), CASE WHEN b THEN 'train' ELSE 'val' END, pos FROM l WHERE a OR b
""")
def folds_complement(spark, sf):
    key = F.col("o_orderkey")
    return folds.from_columns(table(spark, sf, "orders").select(F.when(key % 2 == 0, key).alias("fold_0"), F.when(key % 3 == 0, key).alias("fold_1")))


@query("SELECT c_custkey, c_acctbal, c_acctbal * 2 AS snv__c_acctbal FROM customer")
def variation_columns(spark, sf):
    c = with_position(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    other = c.select(POS, (F.col("c_acctbal") * 2).alias("value"))
    return variations.with_variation(c, other, "snv", ["c_acctbal"]).select("c_custkey", "c_acctbal", "snv__c_acctbal")


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n_partitions FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def leakage_groups(spark, sf):
    return partitions.leaking_groups(partitions.by_column(table(spark, sf, "orders"), "o_orderstatus", _LISTS, "drop"), "o_custkey")


@query("SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_unique, count(*) / count(DISTINCT l_orderkey) AS avg_repeats, count(*) / count(DISTINCT l_orderkey) >= 1.5 AS is_repetition FROM lineitem")
def repetition_profile(spark, sf):
    return agg.repetition_profile(table(spark, sf, "lineitem"), "l_orderkey")


@query("SELECT count(*) FILTER (regexp_matches(c_name, '\\d$')) AS n_matched, count(*) AS n_rows, count(DISTINCT regexp_replace(c_name, '\\d$', '')) AS n_groups, count(*) / count(DISTINCT regexp_replace(c_name, '\\d$', '')) AS avg_repeats FROM customer")
def replicate_grouping(spark, sf):
    return statistics.replicate_groups(table(spark, sf, "customer"), "c_name", r"\d$")


@query("SELECT l_orderkey, round(avg(l_quantity), 4) AS l_quantity FROM lineitem GROUP BY 1")
def aggregate_mean(spark, sf):
    return agg.aggregate(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity"]).select("l_orderkey", F.round("l_quantity", 4).alias("l_quantity"))


@query("SELECT l_orderkey, median(l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def aggregate_median(spark, sf):
    return agg.aggregate(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity"], "median")


@query("""
SELECT l_orderkey, l_returnflag FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY 1, 2) WHERE r = 1
""")
def aggregate_vote(spark, sf):
    return agg.vote(table(spark, sf, "lineitem"), ["l_orderkey"], "l_returnflag")


@query("""
WITH m AS (SELECT l_orderkey, median(l_quantity) AS m FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey, any_value(m) AS m, median(abs(l_quantity - m)) AS s FROM lineitem JOIN m USING (l_orderkey) GROUP BY 1)
SELECT l_orderkey, round(avg(l_quantity) FILTER (s = 0 OR abs(l_quantity - m) <= 3.0 * 1.4826 * s), 4) AS l_quantity FROM lineitem JOIN s USING (l_orderkey) GROUP BY 1
""")
def aggregate_robust_mean(spark, sf):
    return agg.robust_mean(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_quantity"]).select("l_orderkey", F.round("l_quantity", 4).alias("l_quantity"))


def _profile_sql(t: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT) AS n_unique, count(*) - count({c}) AS n_missing, (count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT)) / count(*) AS uniqueness FROM {t}" for c in columns)


_PROFILED = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(_profile_sql("orders", _PROFILED))
def column_profile(spark, sf):
    return agg.profile_columns(table(spark, sf, "orders"), _PROFILED)


@query("SELECT bool_and(CAST(label AS DOUBLE) = floor(label)) AS integral, count(DISTINCT label) AS n_distinct, min(CAST(label AS DOUBLE)) + 0.0 AS low, max(CAST(label AS DOUBLE)) + 0.0 AS high, count(label) AS n FROM embeddings")
def task_type_stats(spark, sf):
    return statistics.task_type_stats(table(spark, sf, "embeddings"), "label")


@query("WITH x AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT min(x) + 0.0 AS low, max(x) + 0.0 AS high, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM x")
def signal_stats(spark, sf):
    return statistics.block_stats(table(spark, sf, "embeddings"), "embedding")


@query("SELECT CAST(idx AS INTEGER) AS idx, round(avg(CAST(embedding[idx + 1] AS DOUBLE)), 6) AS mean FROM embeddings, range(64) r(idx) GROUP BY 1")
def mean_spectrum(spark, sf):
    return statistics.mean_spectrum(table(spark, sf, "embeddings"), "embedding")


@query("SELECT doc_id, quality, toxic, quality IS NOT NULL AS present FROM documents LEFT JOIN labels USING (doc_id)")
def cohort_left_presence(spark, sf):
    return joins.align_cohort(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("SELECT conv_id, count(*) AS n_points FROM conversations GROUP BY 1")
def ragged_lengths(spark, sf):
    return agg.ragged_lengths(table(spark, sf, "conversations"), "conv_id")


@query("SELECT conv_id, count(DISTINCT turn) = count(*) AS increasing FROM conversations GROUP BY 1")
def ragged_time_check(spark, sf):
    return agg.increasing_within(table(spark, sf, "conversations"), "conv_id", "turn")


@query("SELECT vec_id, CAST(idx AS INTEGER) AS idx, CAST(embedding[idx + 1] AS DOUBLE) AS x FROM embeddings, range(64) r(idx)")
def tensor_long_form(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "x")).withColumn("x", F.col("x").cast("double"))


@query("SELECT n_nationkey, sha256(concat_ws(chr(31), CAST(n_nationkey AS VARCHAR), n_name, CAST(n_regionkey AS VARCHAR))) AS digest FROM nation")
def row_hash(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", agg.row_hash("n_nationkey", "n_name", "n_regionkey").alias("digest"))


from . import queries_of_files  # noqa: E402, F401  (adds the queries that need files or whole datasets)
