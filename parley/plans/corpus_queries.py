"""Queries over synchronization, corpus building, dialogues and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions.scalar import hash_bucket
from parley.operators import composition as cm
from parley.operators import corpus as co
from parley.operators import dialogue as dg
from parley.operators import evaluation as evl
from parley.operators import sync as sy
from parley.plans.registry import query, table

MASKS = "m AS (SELECT a.vec_id, generate_subscripts(a.embedding, 1) AS i, unnest(a.embedding) > 0 AS x, unnest(b.embedding) > 0 AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _masks(spark, d):
    e = table(spark, d, "embeddings")
    pair = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return pair.select("vec_id", F.posexplode(F.zip_with("a", "b", lambda x, y: F.struct((x > 0).alias("x"), (y > 0).alias("y")))).alias("i", "p")).select("vec_id", (F.col("i") + 1).cast("bigint").alias("i"), "p.x", "p.y")


@query(f"""WITH {MASKS}, l AS (SELECT a.vec_id, a.lag, count(*) FILTER (a.x = b.y) AS loss FROM (SELECT m.*, unnest(range(-5, 6)) AS lag FROM m WHERE i BETWEEN 7 AND 58) a JOIN m b ON b.vec_id = a.vec_id AND b.i = a.i - a.lag GROUP BY ALL)
SELECT vec_id, CAST(arg_min(lag, loss * 100 + lag) AS INTEGER) AS lag, min(loss) AS loss FROM l GROUP BY vec_id""")
def lag_loss_argmin(spark, d):
    return sy.best_lag(sy.lag_loss(_masks(spark, d), ["vec_id"], "x", "y", "i", range(-5, 6), 6), ["vec_id"])


@query()
def stable_offset_fft(spark, d):
    e = table(spark, d, "embeddings")
    pair = e.select("vec_id", F.transform("embedding", lambda v: v > 0).alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.transform("embedding", lambda v: v > 0).alias("b")), "vec_id")
    return sy.with_stable_lag(pair, "a", "b", frame=1.0, reach=12, margin=12, radius=1, exclusion=3).select("vec_id", "estimate.*")


@query("""WITH c AS (SELECT l_orderkey, l_quantity AS v, sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS c, sum(l_linenumber) OVER (PARTITION BY l_orderkey) AS t FROM lineitem) SELECT l_orderkey, min(v) AS weighted_median FROM c WHERE c * 2 >= t GROUP BY l_orderkey""")
def weighted_median(spark, d):
    return sy.weighted_median(table(spark, d, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber")


DAY = 86_400_000_000


@query(f"SELECT user_id, epoch_us(ts) // {DAY} AS w, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    x = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return sy.tumbling(x, "us", DAY, "w").groupBy("user_id", "w").agg(F.count("*").alias("n"))


@query(f"""WITH b AS (SELECT user_id, min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events GROUP BY 1), w AS (SELECT user_id, low + i * {DAY} AS s FROM (SELECT user_id, low, high, unnest(range((high - low - {3 * DAY}) // {DAY} + 1)) AS i FROM b WHERE high - low >= {3 * DAY}))
SELECT w.user_id, s AS "start", count(e.event_id) AS n FROM w LEFT JOIN events e ON e.user_id = w.user_id AND epoch_us(e.ts) >= s AND epoch_us(e.ts) < s + {3 * DAY} GROUP BY ALL""")
def sliding_windows(spark, d):
    x = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    b = x.groupBy("user_id").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    w = b.select("user_id", F.explode(F.transform(sy.sliding(F.col("low"), F.col("high"), 3 * DAY, DAY), lambda x: x.cast("bigint"))).alias("start"))
    # Each event meets the three windows that its day belongs to: the start is low plus a whole number of days.
    hits = x.join(b, "user_id").select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: (F.col("low") + (F.floor((F.col("us") - F.col("low")) / DAY) - k) * DAY).cast("bigint"))).alias("start"))
    n = hits.groupBy("user_id", "start").agg(F.count("*").alias("n"))
    return w.join(n, ["user_id", "start"], "left").fillna(0, ["n"])


@query("""WITH f AS (SELECT user_id, count(*) AS n, max(value) - min(value) AS shift_range, regr_slope(value, event_id) AS slope, regr_intercept(value, event_id) AS intercept FROM events GROUP BY 1),
r AS (SELECT e.user_id, median(abs(value - slope * event_id - intercept)) AS median_residual FROM events e JOIN f USING (user_id) GROUP BY 1)
SELECT user_id, n, round(shift_range, 6) AS shift_range, round(slope, 6) AS slope, round(intercept, 4) AS intercept, round(median_residual, 4) AS median_residual FROM f JOIN r USING (user_id)""")
def linear_drift(spark, d):
    x = sy.drift(table(spark, d, "events").select("user_id", F.col("event_id").cast("double").alias("at"), "value"), ["user_id"], "at", "value")
    return x.select("user_id", "n", F.round("shift_range", 6).alias("shift_range"), F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("median_residual", 4).alias("median_residual"))


@query("""WITH e AS (SELECT source, (doc_id % 41 - 20) / 40.0::DOUBLE AS err FROM documents) SELECT source, count(*) AS n, round(avg(abs(err)), 9) AS mae, round(median(abs(err)), 9) AS median, round(sqrt(avg(err * err)), 9) AS rmse, max(abs(err)) AS largest,
round(avg((abs(err) <= 0.05)::INTEGER), 9) AS within_50ms, round(avg((abs(err) <= 0.1)::INTEGER), 9) AS within_100ms, round(avg((abs(err) <= 0.2)::INTEGER), 9) AS within_200ms, round(avg((abs(err) <= 0.5)::INTEGER), 9) AS within_500ms FROM e GROUP BY source""")
def offset_error_metrics(spark, d):
    x = sy.offset_errors(table(spark, d, "documents").select("source", ((F.col("doc_id") % 41 - 20) / F.lit(40.0)).alias("err")), ["source"], "err")
    nine = ("mae", "median", "rmse", "within_50ms", "within_100ms", "within_200ms", "within_500ms")
    return x.select("source", "n", "largest", *[F.round(c, 9).alias(c) for c in nine])


@query("""WITH d AS (SELECT doc_id, lang, n_chars % 97 AS y, (row_number() OVER (PARTITION BY lang ORDER BY sha256('cv:' || doc_id::VARCHAR), doc_id) - 1) % 5 AS fold FROM documents),
g AS (SELECT unnest([20, 40, 60]) AS a, 1 AS z), g2 AS (SELECT a, b FROM g, (SELECT unnest([1, 2]) AS b)), p AS (SELECT fold, a, b, sum(abs(y - a) * b) AS s, count(*) AS n FROM d, g2 GROUP BY ALL),
r AS (SELECT fold, a, b, (sum(s) OVER w - s)::DOUBLE / (sum(n) OVER w - n) AS train_error, s::DOUBLE / n AS test_error FROM p WINDOW w AS (PARTITION BY a, b))
SELECT fold::INTEGER AS fold, arg_min(a, train_error * 1000000 + a * 10 + b)::BIGINT AS a, arg_min(b, train_error * 1000000 + a * 10 + b)::BIGINT AS b, round(min(train_error), 6) AS train_error, round(arg_min(test_error, train_error * 1000000 + a * 10 + b), 6) AS test_error FROM r GROUP BY fold""")
def grid_cv_select(spark, d):
    x = sy.folds(table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") % 97).alias("y")), "lang", "doc_id", 5, "cv")
    grid = [{"a": a, "b": b} for a in (20, 40, 60) for b in (1, 2)]
    best = sy.grid_select(x, grid, F.abs(F.col("y") - F.col("a")) * F.col("b"))
    return best.select("fold", "a", "b", F.round("train_error", 6).alias("train_error"), F.round("test_error", 6).alias("test_error"))


WINDOWS = "w AS (SELECT doc_id, unnest(range(CAST(greatest(ceil((n_chars / 10.0 - 4) / 16), 0) AS BIGINT))) * 16.0 AS s, n_chars / 10.0 AS duration FROM documents)"


@query(f"WITH {WINDOWS} SELECT doc_id, CAST(s AS DOUBLE) AS start FROM w")
def window_starts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(co.window_starts(F.col("n_chars") / 10.0)).alias("start"))


def _windows(spark, d):
    w = table(spark, d, "documents").select("doc_id", "source", (F.col("n_chars") / 10.0).alias("duration"), F.explode(co.window_starts(F.col("n_chars") / 10.0)).alias("start"))
    n = F.pmod(F.col("doc_id") * 7 + F.col("start").cast("bigint"), F.lit(100))
    return co.window_audit(w.withColumns({"quality": F.lit(0.96) - (n < 10).cast("int") * 0.1, "supervised": F.least(F.lit(16.0), F.col("duration") - F.col("start") - 4), "primary": F.when(n % 7 == 0, 0.8).otherwise(0.95), "future": F.when(n % 11 == 0, 0.9).otherwise(0.99), "masked": F.when(n % 13 == 0, 0.4).otherwise(0.1)}))


AUDIT = f"""WITH {WINDOWS}, v AS (SELECT *, (doc_id * 7 + CAST(s AS BIGINT)) % 100 AS n FROM w), a AS (SELECT doc_id, s, least(16.0, duration - s - 4) AS supervised, n < 10 AS q, n % 7 = 0 AS p, n % 11 = 0 AS f, n % 13 = 0 AS m FROM v),
r AS (SELECT *, concat_ws(',', CASE WHEN q THEN 'low_quality' END, CASE WHEN supervised < 8 THEN 'short_supervision' END, CASE WHEN p THEN 'primary_coverage' END, CASE WHEN f THEN 'future_coverage' END, CASE WHEN m THEN 'masked' END) AS rejections FROM a)"""


@query(f"{AUDIT} SELECT doc_id, CAST(s AS DOUBLE) AS start, rejections, rejections = '' AS accepted, round(CASE WHEN rejections = '' THEN greatest(0.0, supervised::DOUBLE * 0.95::DOUBLE - 0.1::DOUBLE) ELSE 0.0 END, 6) AS effective FROM r")
def window_audit(spark, d):
    return _windows(spark, d).select("doc_id", "start", F.array_join("rejections", ",").alias("rejections"), "accepted", F.round("effective", 6).alias("effective"))


@query(f"{AUDIT}, x AS (SELECT unnest(string_split(rejections, ',')) AS reason FROM r WHERE rejections != '') SELECT g.reason, count(x.reason) AS n FROM (VALUES ('low_quality'), ('short_supervision'), ('primary_coverage'), ('future_coverage'), ('masked'), ('excluded')) g(reason) LEFT JOIN x USING (reason) GROUP BY ALL")
def rejection_histogram(spark, d):
    return co.rejection_histogram(_windows(spark, d), ["low_quality", "short_supervision", "primary_coverage", "future_coverage", "masked", "excluded"]).select("reason", "n")


SPLIT = """n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('hash-quota-1:seed:' || source || ':' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents),
q AS (SELECT *, n * 8 // 10 AS w0, n // 10 AS w1, n * 8 % 10 AS r0, n % 10 AS r1, n - n * 8 // 10 - 2 * (n // 10) AS l FROM n),
z AS (SELECT *, w0 + (CASE WHEN (CASE WHEN r1 > r0 THEN 2 ELSE 0 END) < l THEN 1 ELSE 0 END) AS t, w1 + (CASE WHEN (CASE WHEN r0 >= r1 THEN 1 ELSE 0 END) < l THEN 1 ELSE 0 END) AS v, w1 + (CASE WHEN (CASE WHEN r0 >= r1 THEN 2 ELSE 1 END) < l THEN 1 ELSE 0 END) AS e FROM q),
y AS (SELECT *, t - (CASE WHEN n >= 3 AND v = 0 THEN 1 ELSE 0 END) - (CASE WHEN n >= 3 AND e = 0 THEN 1 ELSE 0 END) AS a, v + (CASE WHEN n >= 3 AND v = 0 THEN 1 ELSE 0 END) AS b FROM z),
splits AS (SELECT source, doc_id, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'validation' ELSE 'test' END AS split FROM y)"""


@query(f"WITH {SPLIT} SELECT * FROM splits")
def hash_split_quota(spark, d):
    return co.assign_splits(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", "seed")


MOD = "CAST(('0x' || substr(sha256(c_name), 1, 4)) AS INTEGER) % 100"


@query(f"SELECT c_custkey, {MOD} AS bucket, CASE WHEN {MOD} < 80 THEN 'train' WHEN {MOD} < 90 THEN 'validation' ELSE 'test' END AS split FROM customer")
def hash_mod_split(spark, d):
    return table(spark, d, "customer").select("c_custkey", hash_bucket("c_name", 100).alias("bucket"), co.hash_split("c_name").alias("split"))


@query("SELECT doc_id, sha256('v1:' || source || ':' || doc_id::VARCHAR || ':' || lang) AS window_id FROM documents")
def window_id_sha(spark, d):
    return table(spark, d, "documents").select("doc_id", co.window_id(F.lit("v1"), "source", "doc_id", "lang").alias("window_id"))


@query(f"WITH {SPLIT}, t AS (SELECT d.text, s.split FROM documents d JOIN splits s USING (doc_id)) SELECT md5(text) AS text_md5, count(DISTINCT split) AS n_splits FROM t GROUP BY text HAVING count(DISTINCT split) > 1")
def split_leakage_violations(spark, d):
    docs = table(spark, d, "documents")
    s = co.assign_splits(docs.select("source", "doc_id"), "source", "doc_id", "seed").select("doc_id", "split")
    return co.leakage(docs.select("doc_id", F.md5("text").alias("text_md5")).join(s, "doc_id"), "text_md5")


@query("WITH p AS (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_keys, round(max(n)::DOUBLE / sum(n), 9) AS largest_share FROM p GROUP BY 1")
def concentration(spark, d):
    x = co.concentration(table(spark, d, "orders"), ["o_orderstatus"], "o_custkey")
    return x.select("o_orderstatus", "n", "n_keys", F.round("largest_share", 9).alias("largest_share"))


@query("SELECT event_type, event_id, rank FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) ORDER BY rank, event_type LIMIT 40")
def round_robin_anchors(spark, d):
    x = co.round_robin(table(spark, d, "events"), "event_type", [F.col("value").desc(), F.col("event_id")], 40)
    return x.select("event_type", "event_id", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('review:' || source || ':' || doc_id::VARCHAR), doc_id) AS place FROM documents) WHERE place <= 5")
def review_plan(spark, d):
    x = co.review_plan(table(spark, d, "documents"), "source", "doc_id", 5, "review")
    return x.select("source", "doc_id", F.col("place").cast("bigint").alias("place"))


def _dialogues(spark, d):
    return dg.nest(table(spark, d, "conversations"), "conv_id", "turn", ["role", "text"])


@query("""SELECT conv_id % 4 AS family, count(DISTINCT conv_id) AS n_dialogues, count(*) FILTER (role = 'system') AS n_system, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY 1""")
def dialogue_statistics(spark, d):
    return dg.statistics(_dialogues(spark, d).withColumn("family", F.col("conv_id") % 4), ["family"])


@query("SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS \"case\", n AS n_prefix, length(text) AS target_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) WHERE role = 'assistant'")
def heldout_cases(spark, d):
    x = dg.heldout_cases(_dialogues(spark, d), "conv_id")
    return x.select("conv_id", F.col("case").cast("bigint").alias("case"), F.size("prefix").cast("bigint").alias("n_prefix"), F.length("target").cast("bigint").alias("target_chars"))


@query("""WITH p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 AND turn % 4 = 1 THEN 'user' WHEN conv_id % 11 = 0 AND turn = 2 THEN 'system' ELSE role END AS role FROM conversations)) SELECT DISTINCT conv_id FROM p WHERE before = role OR (before IS NOT NULL AND role = 'system')""")
def dialogue_violations(spark, d):
    """Some conversations are broken: two messages of the user in a row, or a system message in between."""
    c = table(spark, d, "conversations")
    role = F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") % 4 == 1), "user").when((F.col("conv_id") % 11 == 0) & (F.col("turn") == 2), "system").otherwise(F.col("role"))
    return dg.violations(dg.nest(c.withColumn("role", role), "conv_id", "turn", ["role", "text"]), "conv_id")


def _to_compose(spark, d):
    n = F.size(F.filter("messages", lambda m: m["role"] == "user"))
    return _dialogues(spark, d).select("conv_id", "messages", n.alias("n_user"), (F.col("conv_id") % 2).alias("style"), (F.col("conv_id") % 5).alias("family"))


@query()
def composed_histories(spark, d):
    x = _to_compose(spark, d)
    composed = cm.compose(x, "conv_id", ["style"], "family", "n_user", "compose")
    return dg.concatenate(composed, x, "conv_id", ["style"]).select("style", "composition", F.size("messages").alias("n_messages"))


@query("""WITH d AS (SELECT conv_id, conv_id % 2 AS style, greatest(1, count(*) FILTER (role = 'user')) AS n FROM conversations GROUP BY conv_id) SELECT style, count(*) AS n_dialogues, count(*) AS n_keys, sum(n)::BIGINT AS n_turns, 0::BIGINT AS n_broken FROM d GROUP BY style""")
def composition_balance(spark, d):
    """Every dialogue placed once; no whole history outside its bounds, of one bucket, or with a gap in its places."""
    c = cm.compose(_to_compose(spark, d), "conv_id", ["style"], "family", "n_user", "compose")
    each = c.groupBy("style", "composition").agg(F.count("*").alias("n"), F.count_distinct("conv_id").alias("keys"), F.sum("turns").alias("turns"), F.count_distinct("bucket").alias("buckets"), F.bool_and("whole").alias("whole"), F.max("place").alias("top"), F.count_distinct("place").alias("places"))
    broken = F.col("whole") & ((F.col("turns") < 8) | (F.col("turns") > 16) | (F.col("buckets") < 2)) | (F.col("top") + 1 != F.col("n")) | (F.col("places") != F.col("n"))
    return each.groupBy("style").agg(F.sum("n").alias("n_dialogues"), F.sum("keys").alias("n_keys"), F.sum("turns").alias("n_turns"), F.count_if(broken).alias("n_broken"))


SCORES = "p AS (SELECT doc_id, (doc_id * 37 % 101) / 100.0::DOUBLE AS p, quality, toxic FROM labels), long AS (SELECT 'quality' AS head, p, CASE WHEN doc_id % 9 = 0 THEN -1.0 ELSE quality END::DOUBLE AS y, 1.0 + doc_id % 3 AS w FROM p UNION ALL SELECT 'toxic', p, CASE WHEN doc_id % 7 = 0 THEN -1.0 ELSE toxic END::DOUBLE, 1.0 + doc_id % 3 FROM p)"


def _scores(spark, d):
    x = table(spark, d, "labels").withColumn("p", (F.col("doc_id") * 37 % 101) / F.lit(100.0)).withColumn("w", F.lit(1.0) + F.col("doc_id") % 3)
    one = lambda head, n: x.select(F.lit(head).alias("head"), "p", F.when(F.col("doc_id") % n == 0, -1.0).otherwise(F.col(head).cast("double")).alias("y"), "w")
    return one("quality", 9).unionByName(one("toxic", 7))


@query(f"WITH {SCORES} SELECT head, round(avg(y), 9) AS prior, count(*) AS support FROM long WHERE y >= 0 GROUP BY head")
def class_priors(spark, d):
    return evl.class_priors(_scores(spark, d), "head", "y").select("head", F.round("prior", 9).alias("prior"), "support")


@query(f"""WITH {SCORES}, c AS (SELECT *, least(greatest(p, 1e-7::DOUBLE), 1 - 1e-7::DOUBLE) AS q FROM long WHERE y >= 0)
SELECT head, sum(w)::DOUBLE AS support, round(sum(w * -(y * ln(q) + (1 - y) * ln(1 - q))) / sum(w), 7) AS bce, round(sum(w * (p - y) * (p - y)) / sum(w), 7) AS brier, round(sum(w * p) / sum(w), 7) AS mean_prediction, round(sum(w * y) / sum(w), 7) AS mean_target FROM c GROUP BY head""")
def bce_brier(spark, d):
    x = evl.head_metrics(_scores(spark, d), "head", "p", "y", "w")
    return x.select("head", "support", *[F.round(c, 7).alias(c) for c in ("bce", "brier", "mean_prediction", "mean_target")])


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_percentiles_nearest_rank(spark, d):
    return evl.nearest_rank(table(spark, d, "events"), ["event_type"], "value", [0.5, 0.9, 0.95])


GENERATED = """CASE turn % 6 WHEN 0 THEN text || ' <tool_call>{"name": "weather", "arguments": {"city": "x"}}</tool_call>' WHEN 1 THEN text WHEN 2 THEN '<tool_call>{"name": "weather"}</tool_call>' WHEN 3 THEN text || '<tool_call>{"name": "a", "arguments": {}}' WHEN 4 THEN '<tool_call>{"name": "clock", "arguments": {}}</tool_call>' ELSE '' END"""


def _generated(spark, d):
    c, t = table(spark, d, "conversations"), F.col("turn") % 6
    call = lambda x: F.lit(f"<tool_call>{x}</tool_call>")
    good = F.concat(F.col("text"), F.lit(" "), call('{"name": "weather", "arguments": {"city": "x"}}'))
    said = F.when(t == 0, good).when(t == 1, F.col("text")).when(t == 2, call('{"name": "weather"}')).when(t == 3, F.concat(F.col("text"), F.lit('<tool_call>{"name": "a", "arguments": {}}'))).when(t == 4, call('{"name": "clock", "arguments": {}}')).otherwise("")
    return c.select("conv_id", "turn", evl.parse_generation(said).alias("g")).select("conv_id", "turn", "g.*")


PARSED = f"""gen AS (SELECT conv_id, turn, text, {GENERATED} AS g FROM conversations), par AS (SELECT conv_id, turn, CASE WHEN turn % 6 IN (0, 1, 3) THEN trim(text, ' ') ELSE '' END AS spoken, CASE turn % 6 WHEN 0 THEN 'weather' WHEN 4 THEN 'clock' END AS tool, turn % 6 NOT IN (2, 3) AS parser_valid, len(list_filter(string_split_regex(CASE WHEN turn % 6 IN (0, 1, 3) THEN text ELSE '' END, '\\s+'), lambda x: x != '')) AS bridge_words FROM gen)"""


@query(f"WITH {PARSED} SELECT conv_id, turn, spoken, tool, parser_valid, CAST(bridge_words AS INTEGER) AS bridge_words FROM par")
def parse_generation(spark, d):
    return _generated(spark, d).select("conv_id", "turn", "spoken", "tool", "parser_valid", "bridge_words")


@query(f"""WITH {PARSED}, k AS (SELECT *, CASE conv_id % 3 WHEN 0 THEN 'tool_call' WHEN 1 THEN 'no_tool' ELSE 'tool_continuation' END AS kind, tool IS NOT NULL AS schema_valid FROM par), r AS (SELECT turn % 2 AS variant, count(*) AS n, avg(parser_valid::INTEGER) AS a, avg((tool IS NOT NULL)::INTEGER) FILTER (kind = 'tool_call') AS b, avg(coalesce(tool = 'weather', false)::INTEGER) FILTER (kind = 'tool_call') AS c,
avg((bridge_words BETWEEN 1 AND 12)::INTEGER) FILTER (kind = 'tool_call') AS e, avg((tool IS NULL AND parser_valid)::INTEGER) FILTER (kind = 'no_tool') AS f, avg((tool IS NULL AND parser_valid AND spoken != '')::INTEGER) FILTER (kind = 'tool_continuation') AS g FROM k GROUP BY 1)
SELECT variant, n, round(a, 6) AS parser_valid_rate, round(coalesce(b, 0), 6) AS tool_decision_accuracy, round(coalesce(c, 0), 6) AS tool_name_accuracy, round(coalesce(e, 0), 6) AS bridge_concise_rate, round(coalesce(f, 0), 6) AS no_tool_accuracy, round(coalesce(g, 0), 6) AS continuation_nonempty_rate FROM r""")
def generation_metrics(spark, d):
    kind = F.when(F.col("conv_id") % 3 == 0, "tool_call").when(F.col("conv_id") % 3 == 1, "no_tool").otherwise("tool_continuation")
    x = _generated(spark, d).withColumns({"kind": kind, "expected": F.lit("weather"), "schema_valid": F.col("tool").isNotNull(), "variant": F.col("turn") % 2})
    names = ("parser_valid_rate", "tool_decision_accuracy", "tool_name_accuracy", "bridge_concise_rate", "no_tool_accuracy", "continuation_nonempty_rate")
    return evl.generation_metrics(x, ["variant"]).select("variant", "n", *[F.round(c, 6).alias(c) for c in names])


@query("""WITH x AS (SELECT user_id AS k, event_id % 3 = 0 AS promoted, CASE WHEN event_id % 4 = 0 THEN event_type END AS inv, event_id % 50 AS tokens, round(value / 100, 4) AS played, event_id % 4 = 0 AS gone FROM events),
v AS (SELECT k, count(*) AS n, count(*) FILTER (promoted) AS p, count(*) FILTER (gone) AS g, coalesce(sum(tokens) FILTER (gone), 0) AS w, list_sort(list(greatest(0.0, played) * 1000)) AS l, list_sort(list(greatest(0.0, played) * 1000) FILTER (gone)) AS lg FROM x GROUP BY k)
SELECT k, n, round(p / n::DOUBLE, 6) AS hit_rate, round(g / n::DOUBLE, 6) AS invalidation_rate, CAST(w AS BIGINT) AS wasted_tokens, round(l[greatest(1, CAST(ceil(0.5 * n) AS INTEGER))], 4) AS played_p50_ms, round(lg[greatest(1, CAST(ceil(0.5 * g) AS INTEGER))], 4) AS after_invalidation_p50_ms FROM v""")
def predictive_metrics(spark, d):
    e = F.col("event_id")
    x = table(spark, d, "events").select(F.col("user_id").alias("k"), (e % 3 == 0).alias("promoted"), F.when(e % 4 == 0, F.col("event_type")).alias("invalidation"), (e % 50).alias("tokens"), F.lit(0.0).alias("commit"), F.lit(None).cast("double").alias("released"), F.round(F.col("value") / 100, 4).alias("played"), F.lit(None).cast("double").alias("true_end"))
    return evl.predictive_metrics(x, ["k"]).select("k", "n", "wasted_tokens", F.round("hit_rate", 6).alias("hit_rate"), F.round("invalidation_rate", 6).alias("invalidation_rate"), F.round("played_p50_ms", 4).alias("played_p50_ms"), F.round("after_invalidation_p50_ms", 4).alias("after_invalidation_p50_ms"))
