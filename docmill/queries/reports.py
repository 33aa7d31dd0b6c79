"""Queries of synchronisation, joins, set operations and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docmill.operators import reports, sync, trees
from docmill.operators.chunks import keep_first
from docmill.operators.understanding import last_before
from docmill.plans.shared import table


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier state of the documents: some missing, some with other text, some hidden."""
    docs = table(spark, sf_dir, "documents")
    state = F.when(F.col("doc_id") % 7 == 0, "hidden").when(F.col("doc_id") % 5 == 0, "updated").otherwise("active")
    old = docs.filter("doc_id % 10 != 1").select(F.col("doc_id").cast("string").alias("source_id"), F.sha1(F.concat("text", F.when(F.col("doc_id") % 4 == 0, "old").otherwise("")).cast("binary")).alias("content_hash"), state.alias("status"), F.lit(0).alias("miss_count"), F.lit(False).alias("is_pinned"))
    gone = docs.select(F.concat(F.lit("gone-"), "doc_id").alias("source_id"), F.lit("h").alias("content_hash"), state.alias("status"), (F.col("doc_id") % 3).cast("int").alias("miss_count"), (F.col("doc_id") % 2 == 0).alias("is_pinned"))
    return old.unionByName(gone)


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.sha1(F.col("text").cast("binary")).alias("content_hash"), (F.col("doc_id") % 50 == 3).alias("failed"))


def sync_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.diff(_snapshot(spark, sf_dir), _incoming(spark, sf_dir))


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.run_status(sync.diff(_snapshot(spark, sf_dir), _incoming(spark, sf_dir)))


def sync_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after one run, synchronised with the same records: nothing is new and nothing is indexed but what failed before."""
    first = sync.diff(_snapshot(spark, sf_dir), _incoming(spark, sf_dir))
    state = first.select("source_id", "content_hash", "status", "miss_count", F.lit(False).alias("is_pinned"))
    return sync.diff(state, _incoming(spark, sf_dir)).groupBy("change", "status").agg(F.count(F.lit(1)).alias("n"))


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    own = docs.select("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("lang")).alias("title"), F.when(F.col("doc_id") % 8 > 0, "u").otherwise(" ").alias("detail_url"), F.col("source").alias("board_name"), F.col("source").alias("board_code"), F.when(F.col("doc_id") % 5 > 0, "2024-01-01").alias("published_at"), F.when(F.col("doc_id") % 6 > 0, F.col("text")).alias("content_text"), (F.col("doc_id") % 11 == 0).alias("attachments_parse_failed"))
    return sync.quality_checks(own, "doc_id").select("doc_id", "check_type", "severity")


def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return sync.upsert(parts, parts.filter("p_size > 25").select("p_partkey", F.upper("p_name").alias("p_name"), F.lit(1).alias("extra")), ["p_partkey"]).na.fill(-1, ["p_size", "extra"])


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left after the orders of one segment's customers, and these, are deleted."""
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = table(spark, sf_dir, "orders")
    left = sync.cascade_delete(gone, {"orders": (orders, "o_custkey")}, "c_custkey")["orders"]
    lines = sync.cascade_delete(orders.join(left, "o_orderkey", "left_anti"), {"lines": (table(spark, sf_dir, "lineitem"), "l_orderkey")}, "o_orderkey")["lines"]
    return lines.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def latest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with its newest order."""
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate", "o_totalprice")
    return reports.with_latest(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), log, "c_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("c_custkey", "c_name", F.coalesce("o_orderkey", F.lit(0)).alias("o_orderkey"), "o_totalprice")


def outer_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), "p_name").filter("code % 3 > 0")
    right = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 2).alias("code"), "s_name")
    return left.join(right, "code", "full_outer").na.fill("", ["p_name", "s_name"])


def left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user name; users without a customer are guests."""
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name").filter("user_id % 3 > 0")
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).join(names, "user_id", "left")
    return own.select("user_id", F.coalesce("c_name", F.lit("게스트")).alias("name"), "n")


def semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels")
    with_label = docs.join(labels, "doc_id", "left_semi").withColumn("side", F.lit("labelled"))
    return with_label.unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("side", F.lit("plain")))


def union_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return a.unionByName(b, allowMissingColumns=True)


def dedupe_prefer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One order per customer, urgent ones first, then the oldest."""
    return keep_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate"), ["o_custkey"], ["o_orderpriority", "o_orderdate", "o_orderkey"])


def admin_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: statuses, feedback and grounding per type, in one pass."""
    rows = table(spark, sf_dir, "events").withColumns({"rating": F.when(F.col("event_id") % 3 == 0, F.when(F.col("value") > 50, 1).otherwise(-1)), "grounded": F.when(F.col("event_id") % 4 > 0, F.col("value") > 20)})
    up = reports.feedback_rollup(rows, "rating", ["event_type"])
    return up.join(reports.grounding_rollup(rows, F.col("grounded").isNotNull(), F.col("grounded"), ["event_type"]), "event_type")


def fallback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus"))
    return reports.counted(table(spark, sf_dir, "orders"), reason, "reason")


def visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.visitors(table(spark, sf_dir, "events"), "user_id", "ts").withColumn("day", F.col("day").cast("string"))


def manager_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supplier name of each nation, '-' without one."""
    first = table(spark, sf_dir, "supplier").filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.min_by("s_name", "s_suppkey").alias("manager"))
    return table(spark, sf_dir, "nation").join(first, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_name", F.coalesce("manager", F.lit("-")).alias("manager"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return labels.select(F.when(F.col("lang") != "es", F.col("lang")).alias("dataset"), F.col("quality").alias("hit"), F.col("quality").alias("context_recall_proxy"), (F.col("n_chars") / 40000).alias("keyword_score"), F.col("toxic").alias("fallback"))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.evaluation(_results(spark, sf_dir), "dataset")


def eval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.gates(reports.evaluation(_results(spark, sf_dir)))


def dataset_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("n_chars").alias("longest"))
    return docs.select("source", reports.health(F.col("n") % 4, F.col("n") % 7 == 0, F.col("longest") < 9000, F.col("longest") < 12000).alias("health"))


def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cost(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.when(F.col("l_linenumber") > 1, F.round((F.col("l_quantity") * 2 + F.col("l_linenumber")) / 1e6, 8)))


def streak_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user as a crawl: purchases reset the streak of views, others leave it."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = reports.streaks(rows, "user_id", ["ts", "event_id"], F.col("value") < 50, F.col("value") > 90)
    return out.select("event_id", F.col("streak").cast("long").alias("streak"))


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:


    rows = table(spark, sf_dir, "conversations").withColumn("head", F.when(F.col("role") == "user", F.col("turn")))
    return rows.select("conv_id", "turn", F.coalesce(last_before(rows, "conv_id", "turn", "head"), F.lit(-1)).alias("section"))


def rate_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user and hour above a limit of one: the batch form of the streaming counter."""
    per = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.filter("n > 1").select(F.col("window.start").alias("start"), "user_id", "n")


def log_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their ranked lines; an order without lines keeps one row."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey")
    rank = F.row_number().over(Window.partitionBy("o_orderkey").orderBy("l_linenumber", "l_partkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines.withColumn("rank", rank), "o_orderkey", "left").na.fill(0, ["l_linenumber", "l_partkey", "rank"])


def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region > nation > customer paths by parent links."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    nodes = region.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name")).union(
        nation.select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    ).union(customer.select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), "c_name"))
    return trees.paths(nodes)


def tree_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a chain, each below the one before; orders of customers divisible by 7 point in a circle, and those divisible by 5 lack their root."""
    place = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.lag("o_orderkey").over(place).alias("before"), F.max("o_orderkey").over(Window.partitionBy("o_custkey")).alias("last"))
    ring = F.when(F.col("before").isNull() & (F.col("o_custkey") % 7 == 0), F.col("last")).otherwise(F.col("before"))
    nodes = orders.filter("before is not null or o_custkey % 5 > 0").select(F.col("o_orderkey").alias("id"), ring.alias("parent"), F.col("o_orderkey").cast("string").alias("name"))
    return trees.paths(nodes)


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty events before a cursor: a report of a page."""
    return table(spark, sf_dir, "events").filter(F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts", "user_id")


def log_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that hold a text, whatever its case, of one role."""
    return table(spark, sf_dir, "conversations").filter(F.lower("text").contains("the") & (F.col("role") == "user")).select("conv_id", "turn")


def guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose role is in the allow-list; a missing role denies."""
    roles = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    return users.join(roles, "user_id", "left").select("user_id", F.coalesce(F.col("role").isin("BUILDING", "MACHINERY"), F.lit(False)).alias("allowed"))


def pending_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") == "O").desc(), F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).alias("place"))


QUERIES = {f.__name__: f for f in (sync_diff, run_status, sync_again, quality_checks, upsert_rows, cascade_delete, latest_lookup, outer_merge, left_default, semi_anti, union_missing, dedupe_prefer, admin_rollup, fallback_counts, visitors, manager_per_group, eval_metrics, eval_gate, dataset_health, costs, streak_islands, carry_forward, rate_windows, log_export, tree_paths, tree_chains, keyset_page, log_search, guarded, pending_first)}

_DIFF = """
snap AS (SELECT doc_id::VARCHAR AS source_id, sha1(text || CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE '' END) AS oh, CASE WHEN doc_id % 7 = 0 THEN 'hidden' WHEN doc_id % 5 = 0 THEN 'updated' ELSE 'active' END AS os, 0 AS om, false AS pin FROM documents WHERE doc_id % 10 <> 1
  UNION ALL SELECT 'gone-' || doc_id, 'h', CASE WHEN doc_id % 7 = 0 THEN 'hidden' WHEN doc_id % 5 = 0 THEN 'updated' ELSE 'active' END, doc_id % 3, doc_id % 2 = 0 FROM documents),
inc AS (SELECT doc_id::VARCHAR AS source_id, sha1(text) AS nh, doc_id % 50 = 3 AS failed FROM documents),
j AS (SELECT coalesce(i.source_id, s.source_id) AS source_id, oh, os, om, pin, nh, failed, i.source_id IS NOT NULL AS seen FROM snap s FULL JOIN inc i ON s.source_id = i.source_id),
d AS (SELECT *, CASE WHEN seen AND failed THEN 'parse_failed' WHEN seen AND os IS NULL THEN 'new' WHEN seen AND (oh <> nh OR os IN ('hidden', 'deleted', 'parse_failed')) THEN 'updated' WHEN seen THEN 'unchanged' WHEN os IN ('active', 'updated') THEN CASE WHEN pin AND om + 1 < 2 THEN 'missed' ELSE 'hidden' END ELSE 'untouched' END AS change FROM j)"""
_RES = "res AS (SELECT CASE WHEN lang <> 'es' THEN lang END AS dataset, quality, n_chars / 40000.0::DOUBLE AS ks, toxic FROM documents LEFT JOIN labels USING (doc_id))"
ORACLES = {
    "sync_diff": f"WITH {_DIFF} SELECT source_id, change, CASE change WHEN 'parse_failed' THEN change WHEN 'updated' THEN change WHEN 'new' THEN 'active' WHEN 'unchanged' THEN 'active' WHEN 'hidden' THEN change ELSE os END AS status, CASE WHEN seen THEN 0 WHEN change IN ('missed', 'hidden') THEN om + 1 ELSE om END::INT AS miss_count, CASE WHEN seen THEN nh ELSE oh END AS content_hash, change IN ('new', 'updated') AS should_index FROM d",
    "run_status": f"WITH {_DIFF} SELECT count(*) FILTER (seen) AS documents_seen, count(*) FILTER (change = 'new') AS documents_new, count(*) FILTER (change = 'updated') AS documents_updated, count(*) FILTER (change = 'hidden') AS documents_deleted, count(*) FILTER (change = 'parse_failed') AS documents_failed, CASE WHEN count(*) FILTER (change = 'parse_failed') >= count(*) FILTER (seen) THEN 'failed' WHEN count(*) FILTER (change = 'parse_failed') > 0 THEN 'partial_success' ELSE 'success' END AS status FROM d",
    "sync_again": f"""WITH {_DIFF}, f AS (SELECT *, CASE change WHEN 'new' THEN 'active' WHEN 'unchanged' THEN 'active' WHEN 'missed' THEN os WHEN 'untouched' THEN os ELSE change END AS st FROM d),
g AS (SELECT CASE WHEN seen AND failed THEN 'parse_failed' WHEN seen THEN CASE WHEN st = 'parse_failed' THEN 'updated' ELSE 'unchanged' END WHEN st IN ('active', 'updated') THEN 'hidden' ELSE 'untouched' END AS change, st FROM f)
SELECT change, CASE change WHEN 'unchanged' THEN 'active' WHEN 'untouched' THEN st ELSE change END AS status, count(*) AS n FROM g GROUP BY ALL""",
    "quality_checks": """SELECT doc_id, 'title' AS check_type, 'error' AS severity FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id, 'detail_url', 'error' FROM documents WHERE doc_id % 8 = 0 UNION ALL SELECT doc_id, 'published_at', 'warning' FROM documents WHERE doc_id % 5 = 0 UNION ALL SELECT doc_id, 'attachments', 'warning' FROM documents WHERE doc_id % 11 = 0
UNION ALL SELECT doc_id, CASE WHEN doc_id % 6 = 0 OR trim(text) = '' THEN 'content_text' ELSE 'content_length' END, 'warning' FROM documents WHERE doc_id % 6 = 0 OR length(trim(text)) < 40""",
    "upsert_rows": "SELECT p_partkey, CASE WHEN p_size > 25 THEN upper(p_name) ELSE p_name END AS p_name, CASE WHEN p_size <= 25 THEN p_size ELSE -1 END AS p_size, CASE WHEN p_size > 25 THEN 1 ELSE -1 END AS extra FROM part",
    "cascade_delete": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING') GROUP BY l_returnflag",
    "latest_lookup": "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT c_custkey, c_name, coalesce(o_orderkey, 0) AS o_orderkey, o_totalprice FROM customer LEFT JOIN o ON c_custkey = o_custkey AND n = 1",
    "outer_merge": "SELECT coalesce(p_partkey, s_suppkey * 2) AS code, coalesce(p_name, '') AS p_name, coalesce(s_name, '') AS s_name FROM (SELECT * FROM part WHERE p_partkey % 3 > 0) FULL JOIN supplier ON p_partkey = s_suppkey * 2",
    "left_default": "WITH e AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, coalesce(c_name, '게스트') AS name, n FROM e LEFT JOIN customer ON user_id = c_custkey AND c_custkey % 3 > 0",
    "semi_anti": "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'plain' END AS side FROM documents",
    "union_missing": "SELECT c_custkey AS k, c_name, NULL AS s_name FROM customer UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier",
    "dedupe_prefer": "SELECT o_custkey, o_orderkey, o_orderpriority, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1",
    "admin_rollup": """WITH r AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN CASE WHEN value > 50 THEN 1 ELSE -1 END END AS rating, CASE WHEN event_id % 4 > 0 THEN value > 20 END AS g FROM events)
SELECT event_type, count(*) FILTER (rating > 0) AS up, count(*) FILTER (rating < 0) AS down, count(*) AS total, round(count(*) FILTER (rating > 0) / nullif(count(rating), 0)::DOUBLE, 6) AS satisfaction, count(g) AS checked, count(*) FILTER (NOT g) AS ungrounded, round(count(*) FILTER (NOT g) / nullif(count(g), 0)::DOUBLE, 6) AS ungrounded_rate FROM r GROUP BY event_type""",
    "fallback_counts": "SELECT coalesce(CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus END, 'unknown') AS reason, count(*) AS n FROM orders GROUP BY 1",
    "visitors": "SELECT (ts + INTERVAL 9 HOUR)::DATE::VARCHAR AS day, count(DISTINCT user_id) AS visitors, count(*) AS n FROM events GROUP BY 1",
    "manager_per_group": "SELECT n_name, coalesce((SELECT arg_min(s_name, s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 0), '-') AS manager FROM nation",
    "eval_metrics": f"WITH {_RES} SELECT dataset, count(*) AS count, round(avg(quality), 6) AS route_hit_rate, round(avg(quality), 6) AS context_recall_proxy, round(avg(ks), 6) AS answer_relevancy_proxy, round(avg(toxic), 6) AS fallback_rate FROM res GROUP BY dataset",
    "eval_gate": f"""WITH {_RES}, m AS (SELECT round(avg(quality), 6) AS q, round(avg(ks), 6) AS k, round(avg(toxic), 6) AS f FROM res), v AS (SELECT 'route_hit_rate' AS metric, q AS value, 0.8::DOUBLE AS threshold FROM m UNION ALL SELECT 'context_recall_proxy', q, 0.7 FROM m UNION ALL SELECT 'answer_relevancy_proxy', k, 0.7 FROM m UNION ALL SELECT 'fallback_rate', f, 0.35 FROM m)
SELECT metric, value, threshold, CASE metric WHEN 'fallback_rate' THEN value <= threshold ELSE value >= threshold END AS passed FROM v WHERE value IS NOT NULL""",
    "dataset_health": "SELECT source, CASE WHEN count(*) % 7 = 0 THEN 'artifact_missing' WHEN count(*) % 4 = 0 THEN 'empty_collection' WHEN max(n_chars) < 9000 THEN 'vectorizer_missing' WHEN max(n_chars) < 12000 THEN 'version_mismatch' ELSE 'ok' END AS health FROM documents GROUP BY source",
    "costs": "SELECT l_returnflag, round(sum(round((l_quantity * 2 + l_linenumber) / 1e6, 8)) FILTER (l_linenumber > 1), 8) AS cost FROM lineitem GROUP BY l_returnflag",
    "streak_islands": """WITH a AS (SELECT event_id, user_id, ts, value < 50 AS c, value > 90 AS r, sum((value > 90)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT event_id, sum((c AND NOT r)::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM a""",
    "carry_forward": "SELECT conv_id, turn, coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING), -1) AS section FROM conversations",
    "rate_windows": "SELECT date_trunc('hour', ts) AS start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1",
    "log_export": "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::INT AS rank FROM lineitem WHERE l_quantity > 30) SELECT o_orderkey, o_orderstatus, coalesce(l_linenumber, 0) AS l_linenumber, coalesce(l_partkey, 0) AS l_partkey, coalesce(rank, 0) AS rank FROM orders LEFT JOIN l ON o_orderkey = l_orderkey",
    "tree_paths": """WITH RECURSIVE n AS (SELECT 'r' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
t AS (SELECT id, name AS path FROM n WHERE parent IS NULL UNION ALL SELECT n.id, path || ' > ' || name FROM n JOIN t ON n.parent = t.id) SELECT id, path FROM t""",
    "tree_chains": """WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders)
SELECT b.o_orderkey AS id, CASE WHEN b.o_custkey % 7 > 0 OR b.o_custkey % 5 = 0 THEN string_agg(a.o_orderkey::VARCHAR, ' > ' ORDER BY a.n) END AS path
FROM o b JOIN o a ON a.o_custkey = b.o_custkey AND a.n <= b.n WHERE (a.n > 1 OR a.o_custkey % 5 > 0) AND (b.n > 1 OR b.o_custkey % 5 > 0) GROUP BY b.o_orderkey, b.o_custkey""",
    "keyset_page": "SELECT event_id, ts, user_id FROM events WHERE ts < TIMESTAMP '2024-01-15' ORDER BY ts DESC, event_id DESC LIMIT 20",
    "log_search": "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') AND role = 'user'",
    "guarded": "SELECT DISTINCT user_id, coalesce(c_mktsegment IN ('BUILDING', 'MACHINERY'), false) AS allowed FROM events LEFT JOIN customer ON user_id = c_custkey",
    "pending_first": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderdate DESC, o_orderkey)::INT AS place FROM orders",
}
