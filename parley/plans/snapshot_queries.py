"""Query of published versions: what readers of either version see, after both are there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parley.plans.registry import query, table
from parley.sources import snapshots
from parley.streaming.jobs import shared_folder


@query("""WITH o2 AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders UNION ALL SELECT -o_orderkey, o_custkey FROM orders WHERE o_orderkey % 10 = 0), c2 AS (SELECT c_custkey AS c FROM customer WHERE c_custkey % 7 != 0)
SELECT 1 AS version, (SELECT count(*) FROM orders) AS n_orders, (SELECT count(*) FROM customer) AS n_customers, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS n_dangling, (SELECT sum(o_orderkey) FROM orders)::BIGINT AS key_sum
UNION ALL SELECT 2, (SELECT count(*) FROM o2), (SELECT count(*) FROM c2), (SELECT count(*) FROM o2 WHERE c NOT IN (SELECT c FROM c2)), (SELECT sum(k) FROM o2)::BIGINT""")
def published_versions(spark, d):
    """The first version names the tables where they are; the second appends orders and replaces customers, before anyone reads either."""
    root = f"{shared_folder(spark)}/published_{uuid.uuid4().hex}"
    snapshots.write(spark, root, adopt={n: f"{d}/{n}.parquet" for n in ("orders", "customer")})
    reader = snapshots.load(spark, root)
    more = table(spark, d, "orders").where("o_orderkey % 10 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    snapshots.write(spark, root, appended={"orders": more}, replaced={"customer": table(spark, d, "customer").where("c_custkey % 7 != 0")})
    parts = []
    for s in (reader, snapshots.load(spark, root)):
        o, c = s.table("orders"), s.table("customer")
        sums = o.agg(F.count("*").alias("n_orders"), F.sum("o_orderkey").alias("key_sum"))
        lost = o.join(c, o["o_custkey"] == c["c_custkey"], "left_anti").agg(F.count("*").alias("n_dangling"))
        one = sums.join(c.agg(F.count("*").alias("n_customers"))).join(lost)  # one row each
        parts.append(one.select(F.lit(s.version).alias("version"), "n_orders", "n_customers", "n_dangling", "key_sum"))
    return parts[0].unionByName(parts[1])
