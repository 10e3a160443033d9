"""Queries over the catalogue: orders stand for versions of a customer, documents and labels for samples and results."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import catalog as cat
from parley.plans.registry import query, table

LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1)"


def _latest(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    return cat.latest(o, ["o_custkey"], "o_orderdate", "o_orderkey")


@query(f"WITH {LATEST} SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM latest")
def latest_by_key(spark, d):
    return _latest(spark, d).select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"WITH {LATEST} SELECT l.o_custkey, l.o_orderkey, count(l_linenumber) AS n, min(l_linenumber) AS first, max(l_linenumber) AS last, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM latest l LEFT JOIN lineitem i ON l.o_orderkey = i.l_orderkey GROUP BY ALL")
def latest_with_children_array(spark, d):
    kids = cat.children(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], [])
    x = _latest(spark, d).join(kids, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    n = F.coalesce(F.size(F.coalesce("children", F.array().cast(kids.schema["children"].dataType))), F.lit(0)).cast("bigint")
    return x.select("o_custkey", "o_orderkey", n.alias("n"), F.array_min("children")["l_linenumber"].alias("first"), F.array_max("children")["l_linenumber"].alias("last"), F.coalesce(F.array_join(F.transform("children", lambda c: c["l_partkey"].cast("string")), ","), F.lit("")).alias("parts"))


@query("SELECT d.doc_id, d.source AS dataset, d.lang AS status, d.n_chars AS duration, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'en' AND l.quality >= 1 AND d.n_chars >= 500 AND d.n_chars <= 5000 ORDER BY d.n_chars DESC, d.doc_id LIMIT 50 OFFSET 10")
def dashboard_filtered_page(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", F.col("source").alias("dataset"), F.col("lang").alias("status"), F.col("n_chars").alias("duration"), "quality")
    return cat.SampleFilter(status="en", quality_min=1, duration_min=500, duration_max=5000, limit=50, offset=10).page(x, F.col("duration").desc(), F.col("doc_id"))


@query("SELECT source, count(*) AS total, count(l.doc_id) AS done, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source")
def completeness_overview(spark, d):
    return cat.completeness(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"], ["source"], {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


@query(f"WITH {LATEST} SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM latest GROUP BY ALL")
def completeness_versions(spark, d):
    return _latest(spark, d).groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query(f"""WITH {LATEST}, words AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 THEN 'middle' ELSE 'high' END AS cohort, coalesce(words.n, 0) AS n FROM customer JOIN latest ON c_custkey = o_custkey LEFT JOIN words ON o_orderkey = l_orderkey)
SELECT c_mktsegment, cohort, count(*) AS total, count(*) FILTER (n > 0) AS filled, CAST(sum(n) AS BIGINT) AS words FROM c GROUP BY ALL""")
def completeness_coverage(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    x = table(spark, d, "customer").join(_latest(spark, d), F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").fillna(0, ["n"])
    cohort = F.when(F.col("c_acctbal") < 0, "low").when(F.col("c_acctbal") < 5000, "middle").otherwise("high")
    return x.groupBy("c_mktsegment", cohort.alias("cohort")).agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("filled"), F.sum("n").alias("words"))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS good, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS n_chars, CAST(coalesce(sum(toxic), 0) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def conversation_summary_totals(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("n_chars", "quality", "toxic")
    return cat.totals(x, ["n_chars", "toxic"], {"good": F.col("quality") == 1})


@query("""WITH t AS (SELECT conv_id, CASE role WHEN 'system' THEN 'inconclusive' WHEN 'user' THEN CASE WHEN length(text) % 7 = 0 THEN 'non_english' ELSE 'english' END ELSE 'english' END AS status FROM conversations)
SELECT conv_id, CASE WHEN count(status) = 0 THEN NULL WHEN bool_or(status = 'non_english') THEN 'non_english' WHEN count(status) < 4 OR bool_or(status IN ('inconclusive', 'failed')) THEN 'inconclusive' ELSE 'english' END AS language_status FROM t GROUP BY conv_id""")
def language_status_rollup(spark, d):
    status = F.when(F.col("role") == "system", "inconclusive").when((F.col("role") == "user") & (F.length("text") % 7 == 0), "non_english").otherwise("english")
    return cat.language_status(table(spark, d, "conversations").select("conv_id", status.alias("status")), ["conv_id"], "status", 4)


@query("""SELECT c_custkey, (NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')) OR EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_returnflag = 'R' AND l_discount = 0) AS eligible FROM customer""")
def eligibility_exists_or(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    returned = o.join(table(spark, d, "lineitem").where("l_returnflag = 'R' and l_discount = 0"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    x = cat.exists_flag(table(spark, d, "customer").select("c_custkey"), o.where("o_orderstatus = 'F'"), ["c_custkey"], "_closed")
    return cat.exists_flag(x, returned, ["c_custkey"], "_returned").select("c_custkey", (~F.col("_closed") | F.col("_returned")).alias("eligible"))


@query("SELECT doc_id, CASE WHEN n_chars > 800 THEN n_chars END AS score FROM documents ORDER BY score DESC NULLS LAST, doc_id LIMIT 64")
def topk_interesting_nulls_last(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") > 800, F.col("n_chars")).alias("score"))
    return x.orderBy(F.col("score").desc_nulls_last(), "doc_id").limit(64)


@query("WITH b AS (SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 64) SELECT doc_id, n_chars FROM b WHERE doc_id != 7 ORDER BY sha256('pick:' || doc_id::VARCHAR), doc_id LIMIT 1")
def seeded_interesting_pick(spark, d):
    return cat.top_then_pick(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 64, "pick", 7)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_anti_join(spark, d):
    return cat.pending(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS c, row_number() OVER (ORDER BY doc_id) AS n FROM documents) WHERE c <= 500000 OR n = 1")
def cumulative_cap_prefix(spark, d):
    x = table(spark, d, "documents").select("doc_id", "n_chars", F.floor(F.col("doc_id") / 256).alias("slice"))
    return cat.cumulative_prefix(x, ["doc_id"], "n_chars", 500000, slices="slice").select("doc_id", "n_chars")


@query(f"""WITH {LATEST}, a AS (SELECT o_custkey AS k, 'recent' AS branch FROM latest WHERE o_orderstatus = 'O'), b AS (SELECT DISTINCT o_custkey AS k, 'urgent' AS branch FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT k, branch, c_mktsegment, greatest(c_acctbal, 0.0) AS balance FROM (SELECT * FROM a UNION ALL SELECT * FROM b) JOIN customer ON c_custkey = k""")
def union_all_eligibility(spark, d):
    a = _latest(spark, d).where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k"), F.lit("recent").alias("branch"))
    b = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct().withColumn("branch", F.lit("urgent"))
    return a.unionByName(b).join(table(spark, d, "customer"), F.col("k") == F.col("c_custkey")).select("k", "branch", "c_mktsegment", F.greatest("c_acctbal", F.lit(0.0)).alias("balance"))


@query("""WITH o AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT c_custkey AS k, upper(c_name) AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal + 1 END AS balance FROM customer WHERE c_custkey % 4 != 2)
SELECT k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(n.balance, o.balance) AS balance FROM o FULL JOIN n USING (k)""")
def upsert_merge_coalesce(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    old = c.where("k % 2 = 0").withColumn("balance", F.when(F.col("k") % 3 != 0, F.col("balance")))
    new = c.where("k % 4 != 2").select("k", F.upper("name").alias("name"), F.when(F.col("k") % 5 != 0, F.col("balance") + 1).alias("balance"))
    return cat.upsert(old, new, ["k"], keep=["balance"])


@query("""WITH l AS (SELECT p_partkey AS path, p_brand AS digest FROM part WHERE p_partkey % 3 != 0), r AS (SELECT p_partkey AS path, CASE WHEN p_size > 25 THEN p_brand ELSE 'x' END AS digest FROM part WHERE p_partkey % 5 != 0), e AS (SELECT p_partkey AS path FROM part WHERE p_partkey % 3 = 0)
SELECT l.path, CASE WHEN r.digest IS NULL THEN 'add' WHEN r.digest != l.digest THEN 'update' ELSE 'unchanged' END AS action FROM l LEFT JOIN r USING (path) UNION ALL SELECT path, 'excluded' FROM e""")
def publication_diff(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("digest"), "p_size")
    remote = p.where("path % 5 != 0").select("path", F.when(F.col("p_size") > 25, F.col("digest")).otherwise(F.lit("x")).alias("digest"))
    return cat.diff(p.where("path % 3 != 0"), remote, "path", "digest", p.where("path % 3 = 0"))


@query("WITH t AS (SELECT user_id AS k, event_type AS side, max(value) AS v, count(*) AS n FROM events WHERE event_type IN ('view', 'click') AND value > 150 GROUP BY ALL) SELECT k, max(v) FILTER (side = 'view') AS one, max(v) FILTER (side = 'click') AS two FROM t GROUP BY k HAVING count(*) = 2")
def pair_sides(spark, d):
    t = table(spark, d, "events").where("event_type in ('view', 'click') and value > 150").groupBy(F.col("user_id").alias("k"), F.when(F.col("event_type") == "view", 1).otherwise(2).alias("side")).agg(F.max("value").alias("v"))
    return cat.pair_sides(t, ["k"], "side", ["v"]).select("k", F.col("one.v").alias("one"), F.col("two.v").alias("two"))


@query("SELECT g.event_type, count(e.event_type) AS n FROM (VALUES ('view'), ('click'), ('purchase'), ('never')) g(event_type) LEFT JOIN events e ON e.event_type = g.event_type GROUP BY ALL")
def full_domain_histogram(spark, d):
    return cat.histogram(table(spark, d, "events"), ["view", "click", "purchase", "never"], "event_type").select("event_type", "n")


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS digit, count(*) AS n FROM events GROUP BY ALL")
def json_path_group(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("bigint") % 10).alias("digit")).agg(F.count("*").alias("n"))


@query("""SELECT n_regionkey AS region, n_nationkey AS nation, count(*) AS n, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)""")
def audit_rollup(spark, d):
    x = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.rollup(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
