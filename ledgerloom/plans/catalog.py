"""Every query of the engine over the tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import scalar
from ledgerloom.operators import anchors, audit, charge, evidence, history, latency, ledger, limits, payload, prefixes, pricing, prompts, records, requests, rollups, trees
from ledgerloom.sources import census, rollout
from ledgerloom.sources.carriers import BLOCKS_SQL, COPIES_SQL, LOGGED_SQL, QUOTES_SQL, TIMED_SQL, TREE_SQL, USAGE_SQL, WEEK, blocks, captures, log_lines, quotes, table, timed_lines, tree_records, usage
from ledgerloom.streaming import evidence as late, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, of: str = ""):
    """Registers a query and its SQL; of names the views that the SQL starts from."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {of}{', ' if of and sql.startswith('WITH ') else ''}{sql.removeprefix('WITH ') if sql.startswith('WITH ') else ' ' + sql}" if of else sql
        return f

    return add


_SUMS = "count(*) AS responses, sum(input)::BIGINT AS input, sum(cached)::BIGINT AS cached, sum(output)::BIGINT AS output, sum(reasoning)::BIGINT AS reasoning, sum(cached)::BIGINT / nullif(sum(input)::BIGINT, 0)::DOUBLE AS cache_hit"


@query("totals", "SELECT count(*) AS responses, count(DISTINCT stream) AS streams, sum(input)::BIGINT AS input, sum(cached)::BIGINT AS cached, sum(output)::BIGINT AS output, sum(reasoning)::BIGINT AS reasoning, sum(input - cached)::BIGINT AS uncached FROM u", USAGE_SQL)
def _(spark, d):
    return rollups.totals(usage(spark, d))


for _name, _keys in {"daily_by_model": ("day", "model"), "by_model": ("model",), "by_effort": ("effort",), "tier_partition": ("day", "tier"), "cache_hit": ("stream",)}.items():
    query(_name, f"SELECT {', '.join(_keys)}, {_SUMS} FROM u GROUP BY {', '.join(_keys)}", USAGE_SQL)(lambda spark, d, keys=_keys: rollups.rollup(usage(spark, d), *keys))


@query("by_session", "WITH m AS (SELECT stream, model, sum(input) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY i DESC, model) AS n FROM m), s AS (SELECT stream, count(*) AS responses, sum(input)::BIGINT AS input, min(t) AS first_t, max(t) AS last_t FROM u GROUP BY stream) SELECT s.*, r.model FROM s JOIN r USING (stream) WHERE n = 1", USAGE_SQL)
def _(spark, d):
    return rollups.sessions(usage(spark, d))


for _name, _from in {"active_seconds_r": "u", "active_seconds_t": "(SELECT DISTINCT stream, t FROM u)"}.items():
    query(_name, f"WITH g AS (SELECT stream, t - lag(t) OVER (PARTITION BY stream ORDER BY t) AS gap FROM {_from}) SELECT stream, coalesce(sum(gap) FILTER (gap BETWEEN 0 AND 1800), 0)::BIGINT AS active_s FROM g GROUP BY stream", USAGE_SQL)(lambda spark, d, distinct=_name.endswith("t"): rollups.active_seconds(usage(spark, d), distinct))


_HOURLY = "SELECT (t // 3600) * 3600 AS bucket, model AS category, count(*) AS items, sum(output)::BIGINT AS tokens FROM u GROUP BY ALL"


@query("hourly_category_series", _HOURLY, USAGE_SQL)
def _(spark, d):
    return rollups.hourly(usage(spark, d), "model")


@query("viewport_pie", f"WITH h AS ({_HOURLY}), lim AS (SELECT min(bucket) + 5000 AS lo, max(bucket) - 5000 AS hi FROM h) SELECT category, sum(tokens)::BIGINT AS tokens FROM h, lim WHERE bucket < hi AND bucket + 3600 > lo GROUP BY category", USAGE_SQL)
def _(spark, d):
    return rollups.in_view_of_all(rollups.hourly(usage(spark, d), "model"), 5000)


@query("category_bytes", "SELECT role AS category, count(*) AS items, sum(strlen(text))::BIGINT AS bytes, count(DISTINCT sha256(text)) AS distinct_texts FROM conversations GROUP BY role")
def _(spark, d):
    return table(spark, d, "conversations").groupBy(F.col("role").alias("category")).agg(F.count("*").alias("items"), F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct(F.sha2("text", 256)).alias("distinct_texts"))


@query("content_dedup", "WITH r AS (SELECT *, sha256(text) AS digest, row_number() OVER (PARTITION BY role, sha256(text) ORDER BY conv_id, turn) AS n, count(*) OVER (PARTITION BY role, sha256(text)) AS copies FROM conversations) SELECT conv_id, turn, role, digest, copies FROM r WHERE n = 1", "z AS (SELECT 1)")
def _(spark, d):
    rows = table(spark, d, "conversations").withColumn("digest", F.sha2("text", 256))
    copies = rows.groupBy("role", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("conv_id", "turn")).alias("first"))
    return copies.select("first.conv_id", "first.turn", "role", "digest", "copies")


@query("dedup_first_response", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY stream, k ORDER BY t, response_id) AS n FROM u) SELECT response_id, stream, k, t FROM r WHERE n = 1", USAGE_SQL)
def _(spark, d):
    return ledger.first_response(usage(spark, d), "stream", "k", ["t", "response_id"]).select("response_id", "stream", "k", "t")


@query("repeat_collapse", "WITH r AS (SELECT *, lag({'model': model, 'tier': tier}) OVER (PARTITION BY stream ORDER BY t, response_id) AS b FROM u) SELECT response_id, stream, model, tier FROM r WHERE b IS NULL OR b.model IS DISTINCT FROM model OR b.tier IS DISTINCT FROM tier", USAGE_SQL)
def _(spark, d):
    return ledger.collapse_repeats(usage(spark, d), "stream", ["t", "response_id"], ["model", "tier"]).select("response_id", "stream", "model", "tier")


@query("context_snapshot_filter", "SELECT stream, count(*) FILTER (k % 7 = 0) AS snapshots, count(*) FILTER (k % 7 <> 0) AS responses FROM u GROUP BY stream", USAGE_SQL)
def _(spark, d):
    zeroed = usage(spark, d).select("stream", F.expr("IF(k % 7 = 0, 0, 1)").alias("input"), F.lit(0).alias("output"), F.lit(1).alias("total"))
    snapshot = ledger.is_context_snapshot()
    return zeroed.groupBy("stream").agg(F.count_if(snapshot).alias("snapshots"), F.count_if(~snapshot).alias("responses"))


@query("terminal_block", "SELECT response, copy, arg_max(output, {'b': block, 'o': output}) AS output, max(block) AS block, count(DISTINCT prompt) > 1 AS conflict FROM b GROUP BY response, copy", BLOCKS_SQL)
def _(spark, d):
    return ledger.terminal_blocks(blocks(spark, d))


@query("owner_choice", "WITH c AS (SELECT response, copy, arg_max(output, {'b': block, 'o': output}) AS output, max(block) AS block FROM b GROUP BY response, copy), r AS (SELECT *, count(*) OVER (PARTITION BY response) AS copies, row_number() OVER (PARTITION BY response ORDER BY output DESC, copy) AS n FROM c) SELECT response, copy, output, copies FROM r WHERE n = 1", BLOCKS_SQL)
def _(spark, d):
    return ledger.owners(ledger.terminal_blocks(blocks(spark, d)), [-F.col("output"), F.col("copy")]).select("response", "copy", "output", "copies")


@query("ancestor_chain", "WITH RECURSIVE n AS (SELECT DISTINCT user_id AS node, CASE WHEN user_id > 0 THEN user_id // 2 END AS parent FROM events UNION SELECT DISTINCT user_id // 2, CASE WHEN user_id // 2 > 0 THEN user_id // 4 END FROM events UNION SELECT 0, NULL), c AS (SELECT node, parent AS ancestor, 1::BIGINT AS distance FROM n WHERE parent IS NOT NULL AND parent <> node UNION ALL SELECT c.node, n.parent, c.distance + 1 FROM c JOIN n ON n.node = c.ancestor WHERE n.parent IS NOT NULL AND n.parent <> n.node) SELECT * FROM c")
def _(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("node"))
    nodes = users.union(users.selectExpr("node div 2")).union(users.limit(1).selectExpr("0L")).distinct()
    return ledger.ancestors(nodes.withColumn("parent", F.expr("IF(node > 0, node div 2, NULL)")), "node", "parent")


_CHILD = "s AS (SELECT stream, model, row_number() OVER (PARTITION BY stream ORDER BY t, response_id) AS pos FROM u), p AS (SELECT a.stream AS child, a.pos, a.model AS state FROM s a), h AS (SELECT c.child, b.stream AS ancestor, b.pos, b.model AS state FROM (SELECT DISTINCT child FROM p WHERE child > 0) c JOIN s b ON b.stream = c.child // 2), j AS (SELECT p.child, h.ancestor, h.pos - p.pos AS off, p.pos FROM p JOIN h ON p.child = h.child AND p.state = h.state), k AS (SELECT *, row_number() OVER (PARTITION BY child, ancestor, off ORDER BY pos) AS nth FROM j)"


@query("leading_replay", f"WITH {_CHILD} SELECT child, max(pos) AS n FROM k WHERE nth = pos GROUP BY child", USAGE_SQL)
def _(spark, d):
    from pyspark.sql import Window

    rows = usage(spark, d).select("stream", F.col("model").alias("state"), F.row_number().over(Window.partitionBy("stream").orderBy("t", "response_id")).cast("long").alias("pos"))
    children = rows.where("stream > 0").withColumnRenamed("stream", "child")
    links = children.select("child").distinct().withColumn("ancestor", F.expr("child div 2"))
    return ledger.leading_replay(children, links.join(rows.withColumnRenamed("stream", "ancestor"), "ancestor"))


@query("tier_carry_forward", "SELECT response_id, coalesce(last_value(tier IGNORE NULLS) OVER w, first_value(tier IGNORE NULLS) OVER v) AS tier, last_value(tier IGNORE NULLS) OVER w IS NULL AND first_value(tier IGNORE NULLS) OVER v IS NOT NULL AS inferred FROM u WINDOW w AS (PARTITION BY stream ORDER BY t, response_id ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY stream ORDER BY t, response_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)", USAGE_SQL)
def _(spark, d):
    return ledger.carry_forward(usage(spark, d), "stream", ["t", "response_id"], "tier").select("response_id", F.col("tier_carried").alias("tier"), F.col("tier_inferred").alias("inferred"))


@query("opening_burst", "WITH m AS (SELECT *, max(t) OVER (PARTITION BY stream ORDER BY t, response_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM u), b AS (SELECT response_id, sum(CASE WHEN t - m > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY t, response_id ROWS UNBOUNDED PRECEDING) = 0 AS in_burst FROM m) SELECT * FROM b", USAGE_SQL)
def _(spark, d):
    return ledger.opening_burst(usage(spark, d), "stream", "t", ["t", "response_id"], 3600).select("response_id", "in_burst")


_MERGED = "g AS (SELECT resets_at, count(*) AS n, min(t) AS first_t, max(t) AS last_t, min(percent) AS low, max(percent) AS high, arg_min(percent, {'t': t, 'r': response_id}) AS first_percent, arg_max(percent, {'t': t, 'r': response_id}) AS last_percent FROM q GROUP BY resets_at)"
_CLUSTERS = _MERGED + ", c1 AS (SELECT *, CASE WHEN resets_at - lag(resets_at) OVER (ORDER BY resets_at) > 3600 THEN 1 ELSE 0 END AS nw FROM g), c2 AS (SELECT *, sum(nw) OVER (ORDER BY resets_at)::BIGINT AS cluster FROM c1), c AS (SELECT cluster, min(resets_at) AS reset_low, max(resets_at) AS reset_at, min(first_t) AS first_t, max(last_t) AS last_t, max(high) AS peak, sum(n)::BIGINT AS n FROM c2 GROUP BY cluster)"
_BOUNDS = _CLUSTERS + ", w AS (SELECT cluster, first_t AS start_t, lead(first_t) OVER (ORDER BY first_t, cluster) AS end_t, reset_at, peak, lead(first_t) OVER (ORDER BY first_t, cluster) > reset_at AS gap_after FROM c WHERE peak > 0)"
_Q = f"{USAGE_SQL}, {QUOTES_SQL}"


def _clusters(spark, d):
    return limits.chain_clusters(limits.merge_quotes(quotes(spark, d)))


@query("quote_merge", f"WITH {_MERGED} SELECT * FROM g", _Q)
def _(spark, d):
    return limits.merge_quotes(quotes(spark, d))


@query("reset_cluster_chain", f"WITH {_CLUSTERS} SELECT * FROM c", _Q)
def _(spark, d):
    return _clusters(spark, d)


@query("window_boundaries", f"WITH {_BOUNDS} SELECT * FROM w", _Q)
def _(spark, d):
    return limits.boundaries(_clusters(spark, d))


@query("asof_window", f"WITH {_BOUNDS} SELECT response_id, cluster FROM u ASOF LEFT JOIN w ON u.t >= w.start_t", _Q)
def _(spark, d):
    marks = limits.boundaries(_clusters(spark, d))
    rows = usage(spark, d).select("response_id", "t")
    spans = marks.select("cluster", "start_t", "end_t")
    return rows.select("response_id").join(limits.in_windows(rows, spans, "t", "start_t", "end_t").select("response_id", "cluster"), "response_id", "left")


@query("asof_tier", "WITH m AS (SELECT stream, t, arg_max(tier, response_id) AS tier FROM u WHERE tier IS NOT NULL GROUP BY stream, t) SELECT u.response_id, m.tier FROM u ASOF LEFT JOIN m ON u.stream = m.stream AND u.t >= m.t", USAGE_SQL)
def _(spark, d):
    rows = usage(spark, d)
    marks = rows.where("tier is not null").groupBy("stream", "t").agg(F.max_by("tier", "response_id").alias("tier"))
    return limits.as_of(rows.select("response_id", "stream", "t"), marks, ["stream"], "t", "t", "tier").select("response_id", "tier")


@query("interval_window_join", f"WITH {_CLUSTERS} SELECT c.cluster, count(*) AS responses, sum(u.input)::BIGINT AS input FROM u JOIN c ON u.t >= c.reset_at - 604800 AND u.t < c.reset_at GROUP BY c.cluster", _Q)
def _(spark, d):
    spans = _clusters(spark, d).select("cluster", F.expr("reset_at - 604800").alias("start_t"), F.col("reset_at").alias("end_t"))
    return limits.in_intervals(usage(spark, d), spans, "t", "start_t", "end_t", 86_400).groupBy("cluster").agg(F.count("*").alias("responses"), F.sum("input").alias("input"))


@query("curve_cumulative", "SELECT response_id, sum(input + output) OVER (PARTITION BY stream, t // 604800 ORDER BY t, response_id ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens FROM u", USAGE_SQL)
def _(spark, d):
    rows = usage(spark, d).withColumn("week", F.expr("t div 604800")).withColumn("total", F.col("input") + F.col("output"))
    return rows.select("response_id", limits.running(rows, ["stream", "week"], ["t", "response_id"], "total").alias("tokens"))


@query("bucket_last", "SELECT stream, (t // 900) * 900 AS bucket, arg_max(percent, {'t': t, 'r': response_id}) AS percent FROM q GROUP BY ALL", _Q)
def _(spark, d):
    return limits.bucket_last(quotes(spark, d), ["stream"], "t", ["t", "response_id"], "percent")


@query("downsample_120", "WITH n AS (SELECT response_id, model, row_number() OVER (PARTITION BY model ORDER BY t, response_id) - 1 AS i, count(*) OVER (PARTITION BY model) AS n FROM u), s AS (SELECT DISTINCT n.model, (j * n.n) // 119 AS i FROM (SELECT DISTINCT model, n FROM n) n, range(119) r(j) UNION SELECT DISTINCT model, n - 1 FROM n) SELECT n.model, n.response_id, n.i FROM n LEFT JOIN s USING (model, i) WHERE n.n <= 120 OR s.model IS NOT NULL", USAGE_SQL)
def _(spark, d):
    return limits.downsample(usage(spark, d), ["model"], "t", ["t", "response_id"]).select("model", "response_id", "i")


@query("observation_span", "WITH l AS (SELECT *, max(percent) OVER (PARTITION BY stream) AS pk, lag(percent) OVER w AS bp, lag(t) OVER w AS bt FROM q WINDOW w AS (PARTITION BY stream ORDER BY t, percent, response_id)) SELECT stream, min(t) AS first_t, max(percent) AS peak, min(t) FILTER (percent = pk) AS peak_t, max(t) AS last_t, count(*) FILTER (percent < bp AND t > bt) AS falls, count(*) FILTER (percent <> bp AND t = bt) AS conflicts FROM l GROUP BY stream", _Q)
def _(spark, d):
    return limits.observation_span(quotes(spark, d), "stream")


@query("reset_cluster_span", f"WITH {_MERGED}, o AS (SELECT resets_at, n FROM g), k AS (SELECT (resets_at - {WEEK // 2}) // {WEEK} AS week, min(resets_at) AS low FROM o GROUP BY 1) SELECT k.low AS reset_low, max(o.resets_at) AS reset_high, sum(n)::BIGINT AS n FROM o JOIN k ON (o.resets_at - {WEEK // 2}) // {WEEK} = k.week GROUP BY k.low", _Q)
def _(spark, d):
    return limits.span_clusters(limits.merge_quotes(quotes(spark, d)))


@query("window_overlaps", f"WITH {_CLUSTERS}, i AS (SELECT cluster, first_t AS s, greatest(reset_at, last_t + 1) AS e FROM c) SELECT a.cluster AS a, b.cluster AS b FROM i a, i b WHERE a.cluster < b.cluster AND a.s < b.e AND b.s < a.e", _Q)
def _(spark, d):
    spans = _clusters(spark, d).select("cluster", F.col("first_t").alias("s"), F.greatest("reset_at", F.col("last_t") + 1).alias("e"))
    return limits.overlaps(spans, "cluster", "s", "e")


@query("limit_events_daily", "SELECT day, count(*) AS n FROM u WHERE model = 'error' GROUP BY day", USAGE_SQL)
def _(spark, d):
    return usage(spark, d).where("model = 'error'").groupBy("day").agg(F.count("*").alias("n"))


_TIMED = "l00 AS (SELECT *, max(t) OVER (PARTITION BY stream ORDER BY t, response_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u), l0 AS (SELECT *, t - CASE WHEN req IS NOT NULL THEN CASE WHEN before > req THEN before ELSE req END END AS seconds FROM l00), l AS (SELECT *, CASE WHEN seconds IS NULL THEN 'no_start' WHEN seconds <= 0 THEN 'not_positive' WHEN seconds > 3600 THEN 'too_long' END AS reason FROM l0)"
_STATS = "count(*) AS n, sum(seconds)::BIGINT AS total, quantile_cont(seconds, 0.5) AS median, quantile_cont(seconds, 0.9) AS p90"


@query("latency_samples", f"WITH {_TIMED} SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM l GROUP BY 1", USAGE_SQL)
def _(spark, d):
    return latency.samples(usage(spark, d)).groupBy(F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))


for _name, _keys in {"latency_by_group": ("model", "effort"), "latency_daily": ("day",), "latency_by_tier": ("model", "effort", "tier")}.items():
    query(_name, f"WITH {_TIMED} SELECT {', '.join(_keys)}, {_STATS} FROM l WHERE reason IS NULL GROUP BY {', '.join(_keys)}", USAGE_SQL)(lambda spark, d, keys=_keys: latency.summary(latency.samples(usage(spark, d)), *keys))


@query("latency_hourly", f"WITH {_TIMED} SELECT ((t - seconds) // 3600) % 24 AS hour, {_STATS} FROM l WHERE reason IS NULL GROUP BY 1", USAGE_SQL)
def _(spark, d):
    return latency.summary(latency.samples(usage(spark, d)).withColumn("hour", F.expr("((t - seconds) div 3600) % 24")), "hour")


@query("pace_lines")
def _(spark, d):
    return latency.pace_lines(latency.samples(usage(spark, d)), "model")


_TIER = "CASE WHEN tier IS NULL THEN 'standard' ELSE CASE lower(tier) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in scalar.TIERS.items()) + " END END"
_PRICED = (
    f"pr({', '.join(pricing.NAMES)}) AS ({pricing.values()}), x AS (SELECT u.*, CASE WHEN k % 3 = 0 THEN upper(model) || '-2025-01-02' ELSE model END AS raw, {_TIER} AS pt FROM u), "
    f"y AS (SELECT x.*, x.model IN (SELECT model FROM pr WHERE long_in IS NOT NULL) AND x.input > {pricing.LONG_FROM} AS is_long, x.model IN (SELECT model FROM pr) AS known, o AS own, f AS fast "
    "FROM x LEFT JOIN pr o ON o.model = x.model AND o.tier = x.pt LEFT JOIN pr f ON f.model = x.model AND f.tier = 'fast'), "
)
for _side in ("own", "fast"):
    _full = f"CASE WHEN is_long THEN {_side}.long_in ELSE {_side}.rate_in END"
    _PRICED += f"y_{_side} AS (SELECT *, CASE WHEN NOT known THEN 'model' WHEN {_side}.rate_in IS NULL THEN 'tier' WHEN is_long AND {_side}.long_in IS NULL THEN 'long_context' END AS why_{_side}, (input - cached) * {_full} + cached * coalesce(CASE WHEN is_long THEN {_side}.long_cached ELSE {_side}.rate_cached END, {_full}) + output * CASE WHEN is_long THEN {_side}.long_out ELSE {_side}.rate_out END AS cost_{_side} FROM {'y' if _side == 'own' else 'y_own'}), "
_PRICED += "v AS (SELECT *, why_own AS reason, CASE WHEN why_own IS NULL THEN cost_own END AS micros, CASE WHEN tier IS NULL AND why_fast IS NULL THEN greatest(coalesce(CASE WHEN why_own IS NULL THEN cost_own END, cost_fast), cost_fast) WHEN why_own IS NULL THEN cost_own END AS micros_high FROM y_fast)"


def _priced(spark, d):
    dated = F.when(F.col("k") % 3 == 0, F.concat(F.upper("model"), F.lit("-2025-01-02"))).otherwise(F.col("model"))
    rows = usage(spark, d).withColumns({"name": F.col("model"), "model": dated})
    return pricing.priced(rows, pricing.prices(spark))


@query("price_rows", f"WITH {_PRICED} SELECT response_id, reason, micros::BIGINT AS micros, micros_high::BIGINT AS micros_high FROM v", USAGE_SQL)
def _(spark, d):
    return _priced(spark, d).select("response_id", "reason", "micros", "micros_high")


@query("price_by_model", f"WITH {_PRICED} SELECT model, count(*) AS responses, count(micros) AS priced, sum(micros)::BIGINT AS micros, sum(micros_high)::BIGINT AS micros_high FROM v GROUP BY model", USAGE_SQL)
def _(spark, d):
    return _priced(spark, d).groupBy(F.col("name").alias("model")).agg(F.count("*").alias("responses"), F.count("micros").alias("priced"), F.sum("micros").alias("micros"), F.sum("micros_high").alias("micros_high"))


@query("price_by_tier", f"WITH {_PRICED} SELECT coalesce(pt, 'unknown') AS tier, count(*) AS responses, sum(micros)::BIGINT AS micros FROM v WHERE micros IS NOT NULL GROUP BY 1", USAGE_SQL)
def _(spark, d):
    return _priced(spark, d).where("micros is not null").groupBy(F.coalesce(scalar.tier_name(F.col("tier")), F.lit("unknown")).alias("tier")).agg(F.count("*").alias("responses"), F.sum("micros").alias("micros"))


@query("unpriced_reasons", f"WITH {_PRICED} SELECT reason, model, count(*) AS n FROM v WHERE reason IS NOT NULL GROUP BY ALL ORDER BY n DESC, reason, model LIMIT 20", USAGE_SQL)
def _(spark, d):
    return _priced(spark, d).where("reason is not null").groupBy("reason", F.col("name").alias("model")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason", "model").limit(20)


@query("tier_classes", f"SELECT day, CASE WHEN ({_TIER}) IN ('fast', 'ultrafast') THEN ({_TIER}) ELSE 'standard' END AS tier_class, count(*) AS responses, sum(input)::BIGINT AS input FROM u GROUP BY ALL", USAGE_SQL)
def _(spark, d):
    return usage(spark, d).groupBy("day", scalar.tier_class(F.col("tier")).alias("tier_class")).agg(F.count("*").alias("responses"), F.sum("input").alias("input"))


@query("topk_sessions_month", "WITH g AS (SELECT strftime(day, '%Y-%m') AS month, stream, input, t - lag(t) OVER (PARTITION BY strftime(day, '%Y-%m'), stream ORDER BY t) AS gap FROM u), s AS (SELECT month, stream, coalesce(sum(gap) FILTER (gap BETWEEN 0 AND 1800), 0)::BIGINT AS active_s, sum(input)::BIGINT AS input FROM g GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY active_s DESC, stream) AS a, row_number() OVER (PARTITION BY month ORDER BY input DESC, stream) AS b FROM s) SELECT month, stream, active_s, input FROM r WHERE a <= 10 OR b <= 10", USAGE_SQL)
def _(spark, d):
    return rollups.monthly_sessions(usage(spark, d))


@query("hot_items_topk", "WITH r AS (SELECT response_id, model, input, row_number() OVER (PARTITION BY model ORDER BY input DESC, response_id) AS rank FROM u) SELECT response_id, model, input, rank::INT AS rank FROM r WHERE rank <= 10", USAGE_SQL)
def _(spark, d):
    return rollups.top_per_group(usage(spark, d), "model", [F.desc("input"), F.col("response_id")], 10).select("response_id", "model", "input", "rank")


@query("models_top_other", "WITH m AS (SELECT model, count(*) AS c, sum(input) AS i FROM u GROUP BY model), r AS (SELECT *, row_number() OVER (ORDER BY i DESC, model) AS n FROM m) SELECT CASE WHEN n <= 3 THEN model ELSE 'other' END AS model, sum(c)::BIGINT AS responses, sum(i)::BIGINT AS input FROM r GROUP BY 1", USAGE_SQL)
def _(spark, d):
    return rollups.top_or_other(usage(spark, d), 3)


@query("session_hash", "SELECT c_custkey, substr(sha256('demo:' || c_custkey::VARCHAR), 1, 16) AS hash FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", scalar.session_hash("demo:", F.col("c_custkey")).alias("hash"))


_PART = "p AS (SELECT p_partkey, (p_partkey * 7 % 5000)::DOUBLE AS w, (p_size * 61)::DOUBLE AS h FROM part)"


def _images(spark, d):
    return table(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 7 % 5000).alias("w"), (F.col("p_size") * 61).alias("h"))


@query("image_patch_cost", "WITH a AS (SELECT *, ceil(w / 32) * ceil(h / 32) AS whole, sqrt(1536.0::DOUBLE * 32 * 32 / (w * h)) AS s FROM p WHERE w > 0 AND h > 0), b AS (SELECT *, greatest(floor(w * s / 32), 1) AS pw FROM a), c AS (SELECT *, greatest(ceil(h * s * (pw * 32 / (w * s)) / 32), 1) AS ph FROM b) SELECT p_partkey, CASE WHEN whole <= 1536 THEN whole ELSE pw * greatest(least(ph, floor(1536 / pw)), 1) END::BIGINT AS tokens FROM c UNION ALL SELECT p_partkey, 0 FROM p WHERE w <= 0 OR h <= 0", _PART)
def _(spark, d):
    return _images(spark, d).select("p_partkey", scalar.patch_cost(F.col("w"), F.col("h")).alias("tokens"))


@query("image_tile_cost", "WITH a AS (SELECT *, CASE WHEN greatest(w, h) > 2048 THEN 2048 / greatest(w, h) END AS s FROM p WHERE w > 0 AND h > 0), b AS (SELECT p_partkey, coalesce(w * s, w) AS w, coalesce(h * s, h) AS h FROM a), c AS (SELECT *, CASE WHEN least(w, h) > 768 THEN 768 / least(w, h) END AS s FROM b) SELECT p_partkey, (85 + 170 * ceil(coalesce(w * s, w) / 512) * ceil(coalesce(h * s, h) / 512))::BIGINT AS tokens FROM c UNION ALL SELECT p_partkey, 0 FROM p WHERE w <= 0 OR h <= 0", _PART)
def _(spark, d):
    return _images(spark, d).select("p_partkey", scalar.tile_cost(F.col("w"), F.col("h")).alias("tokens"))


_RULES = {"zero_responses": "responses <= 0", "cached_over_input": "cached > input", "reasoning_over_output": "reasoning > output", "input_bound": "input > 20000000000", "before_start": "day < DATE '2025-04-01'"}


@query("validate_days", f"WITH d AS (SELECT day, {_SUMS} FROM u GROUP BY day) " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({v}) AS n FROM d" for k, v in _RULES.items()), USAGE_SQL)
def _(spark, d):
    return rollups.violations(rollups.rollup(usage(spark, d), "day"))


@query("residual", "SELECT day, sum(input)::BIGINT AS reported, sum(cached + reasoning)::BIGINT AS rebuilt, (sum(input) - sum(cached + reasoning))::BIGINT AS difference, sum(cached + reasoning)::DOUBLE / nullif(sum(input), 0) AS coverage FROM u GROUP BY day", USAGE_SQL)
def _(spark, d):
    return usage(spark, d).groupBy("day").agg(F.sum("input").alias("reported"), F.sum(F.col("cached") + F.col("reasoning")).alias("rebuilt")).withColumn("difference", F.col("reported") - F.col("rebuilt")).withColumn("coverage", rollups.ratio("rebuilt", "reported"))


@query("damage_counters", "SELECT count(*) AS records, count(*) FILTER (k IS NULL) AS damaged, count(*) FILTER (k % 5 = 0) AS suspect FROM u", USAGE_SQL)
def _(spark, d):
    parsed = table(spark, d, "events").select(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return parsed.agg(F.count("*").alias("records"), F.count_if(F.col("k").isNull()).alias("damaged"), F.count_if(F.col("k") % 5 == 0).alias("suspect"))


_LOGGED = f"{USAGE_SQL}, {LOGGED_SQL}"


@query("log_charged", "SELECT 'rollout-' || stream || '.jsonl' AS path, count(*) AS responses, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, min(t)::DOUBLE AS first_t FROM x WHERE whole AND NOT context GROUP BY stream", _LOGGED)
def _(spark, d):
    rows = charge.judged(rollout.parse(log_lines(spark, d))).where("fate = 'charged'")
    return rows.groupBy("path").agg(F.count("*").alias("responses"), F.sum("usage.input_tokens").alias("input"), F.sum("usage.output_tokens").alias("output"), F.min("t").alias("first_t"))


@query("log_fates", "SELECT fate, count(*) AS n FROM (SELECT CASE WHEN context THEN 'context' ELSE 'charged' END AS fate FROM x WHERE whole UNION ALL SELECT 'repeat' FROM x WHERE whole AND twice) GROUP BY fate", _LOGGED)
def _(spark, d):
    return charge.judged(rollout.parse(log_lines(spark, d))).groupBy("fate").agg(F.count("*").alias("n"))


@query("log_damage", "SELECT 'rollout-' || stream || '.jsonl' AS path, 1 + sum(CASE WHEN twice THEN 2 ELSE 1 END)::BIGINT AS records, sum(CASE WHEN whole THEN 0 WHEN twice THEN 2 ELSE 1 END)::BIGINT AS damaged, sum(CASE WHEN whole THEN 0 WHEN twice THEN 2 ELSE 1 END)::BIGINT AS damaged_usage FROM x GROUP BY stream", _LOGGED)
def _(spark, d):
    return rollout.damage(log_lines(spark, d))


@query("stream_hourly", "SELECT (t // 3600) * 3600 AS bucket, model AS event_type, count(*) AS n FROM u GROUP BY ALL", USAGE_SQL)
def _(spark, d):
    return streams.hourly_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


@query("stream_sessions", "WITH x AS (SELECT user_id, ts, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800 THEN 0 ELSE 1 END AS nw FROM events), y AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM x) SELECT user_id, floor(epoch(min(ts)))::BIGINT AS start_t, floor(epoch(max(ts)))::BIGINT + 1800 AS end_t, count(*) AS n FROM y GROUP BY user_id, s", "z AS (SELECT 1)")
def _(spark, d):
    return streams.session_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


_CHAIN = 's0 AS (SELECT *, count(*) FILTER (k % 11 = 0) OVER (PARTITION BY stream ORDER BY t, response_id ROWS UNBOUNDED PRECEDING) AS segment FROM u), s1 AS (SELECT *, (sum(output) OVER (PARTITION BY stream, segment ORDER BY t, response_id ROWS UNBOUNDED PRECEDING))::BIGINT AS "end" FROM s0), s AS (SELECT *, CASE WHEN lag(segment) OVER w = segment THEN least(lag("end") OVER w, "end") ELSE 0 END AS stable FROM s1 WINDOW w AS (PARTITION BY stream ORDER BY t, response_id))'
_ORDER = ["t", "response_id"]


def _placed(spark, d):
    return prompts.placed(usage(spark, d), "stream", _ORDER, "output", F.col("k") % 11 == 0)


@query("prompt_chain", f'WITH {_CHAIN} SELECT response_id, segment, "end" - output AS start, "end", stable FROM s', USAGE_SQL)
def _(spark, d):
    return prompts.stable_prefix(_placed(spark, d), "stream", _ORDER).select("response_id", "segment", "start", "end", "stable")


@query("divergence_leads", f"WITH {_CHAIN} SELECT response_id, stable - cached AS gap FROM s WHERE stable - cached >= 20000 ORDER BY gap DESC, response_id LIMIT 40", USAGE_SQL)
def _(spark, d):
    return prompts.divergence_leads(prompts.stable_prefix(_placed(spark, d), "stream", _ORDER), "response_id").select("response_id", "gap")


@query("resends", f"WITH {_CHAIN} SELECT response_id, count(*) FILTER (req IS NOT NULL) OVER (PARTITION BY stream, segment ORDER BY t, response_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS resent FROM s", USAGE_SQL)
def _(spark, d):
    return prompts.resends(_placed(spark, d), "stream", _ORDER, F.col("req").isNotNull()).select("response_id", "resent")


@query("turn_index", "SELECT response_id, count(*) FILTER (effort = 'low') OVER (PARTITION BY stream ORDER BY t, response_id ROWS UNBOUNDED PRECEDING) AS turn FROM u", USAGE_SQL)
def _(spark, d):
    return prompts.turns(usage(spark, d), "stream", _ORDER, F.col("effort") == "low").select("response_id", "turn")


@query("drawable_runs", "WITH g AS (SELECT model, (t // 3600) * 3600 AS s, count(*) AS n FROM u GROUP BY ALL), o AS (SELECT *, coalesce(s - lag(s + 3600) OVER (PARTITION BY model ORDER BY s) > 3600, true) AS opens FROM g WHERE n >= 2), r AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY model ORDER BY s) AS run FROM o) SELECT model, min(s) AS first, max(s + 3600) AS last, count(*) AS spans FROM r GROUP BY model, run", USAGE_SQL)
def _(spark, d):
    series = rollups.hourly(usage(spark, d), "model").select(F.col("category").alias("model"), F.col("bucket").alias("s"), (F.col("bucket") + 3600).alias("e"), "items")
    return prompts.runs(series, "model", "s", "e", "items", least=2)


@query("tool_calls", "WITH ev AS (SELECT *, k % 4 AS id, k % 3 = 0 AS c FROM u), w AS (SELECT *, lag(c) OVER w AS b, lead(c) OVER w AS a, lag(t) OVER w AS bt FROM ev WINDOW w AS (PARTITION BY stream, id ORDER BY t, response_id)), o AS (SELECT *, CASE WHEN c THEN CASE WHEN a IS NULL THEN 'open' WHEN a THEN 'replaced' ELSE 'answered' END WHEN b THEN 'matched' ELSE 'orphan' END AS outcome FROM w) SELECT outcome, count(*) AS n, (sum(t - bt) FILTER (outcome = 'matched'))::BIGINT AS seconds FROM o GROUP BY outcome", USAGE_SQL)
def _(spark, d):
    calls = evidence.answered(usage(spark, d).withColumn("id", F.col("k") % 4), "stream", "id", _ORDER, F.col("k") % 3 == 0)
    return calls.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))


@query("tool_pairs", "WITH p AS (SELECT stream, k, count(*) FILTER (effort IS NULL) AS starts, count(*) FILTER (effort IS NOT NULL) AS results, max(t) FILTER (effort IS NULL) AS s, max(t) FILTER (effort IS NOT NULL) AS r FROM (SELECT stream, k // 2 AS k, effort, t FROM u) GROUP BY ALL) SELECT stream, k, starts, results, CASE WHEN starts = 1 AND results = 1 THEN r - s END AS seconds, starts > 1 OR results > 1 AS conflict FROM p", USAGE_SQL)
def _(spark, d):
    return evidence.single_pairs(usage(spark, d).withColumn("k", F.expr("k div 2")), ["stream", "k"], F.col("effort").isNull())


@query("unique_facts", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY model, k ORDER BY req NULLS LAST, response_id) AS n, count(*) OVER (PARTITION BY model, k) - 1 AS copies FROM u) SELECT model, k, response_id, stream, copies FROM r WHERE n = 1", USAGE_SQL)
def _(spark, d):
    return evidence.unique_facts(usage(spark, d), ["model", "k"], ["req", "response_id"], ["response_id", "stream"])


@query("split_budget", "WITH g AS (SELECT t // 86400 AS window_day, model, effort, sum(input)::BIGINT AS input FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY window_day ORDER BY input DESC, model, effort NULLS LAST) AS rank FROM g), c AS (SELECT window_day, sum(count(*)) OVER (ORDER BY window_day DESC) AS so_far FROM r WHERE rank <= 5 GROUP BY window_day) SELECT r.* FROM r JOIN c USING (window_day) WHERE rank <= 5 AND so_far <= 60", USAGE_SQL)
def _(spark, d):
    split = usage(spark, d).groupBy(F.expr("t div 86400").alias("window_day"), "model", "effort").agg(F.sum("input").cast("long").alias("input"))
    return evidence.within_budget(split, "window_day", [F.desc("input"), "model", F.asc_nulls_last("effort")], 5, 60)


_SESSION_RULES = "duplicate reversed long_span active_over_span active_bound day_missing".split()


@query("session_rules", "WITH s AS (SELECT stream AS session, min(t) AS a, max(t) AS b, sum(k)::BIGINT AS c FROM u GROUP BY stream UNION ALL SELECT stream, max(t) + 1, min(t), 0 FROM u WHERE stream % 7 = 0 GROUP BY stream), k AS (SELECT *, count(*) OVER (PARTITION BY session) AS copies, NOT EXISTS (SELECT 1 FROM u WHERE u.day = make_timestamp(a * 1000000)::DATE AND u.k % 9 = 0) AS missing FROM s) " + " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER ({sql}) AS n FROM k" for name, sql in zip(_SESSION_RULES, ["copies > 1", "b < a", "b - a > 400 * 86400", "c > b - a + 1", "c > 30 * 86400", "missing"], strict=True)), USAGE_SQL)
def _(spark, d):
    rows = usage(spark, d)
    by = rows.groupBy(F.col("stream").alias("session"))
    good = by.agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("k").alias("active_s"))
    turned = rows.where("stream % 7 = 0").groupBy(F.col("stream").alias("session")).agg((F.max("t") + 1).alias("first_t"), F.min("t").alias("last_t"), F.lit(0).cast("long").alias("active_s"))
    return evidence.session_rules(good.unionByName(turned), rows.where("k % 9 = 0").select("day"))


@query("snapshot_diagnostics", "WITH s AS (SELECT stream, t, response_id, CASE WHEN k % 4 > 0 THEN input END AS total, k % 3 AS a, k % 2 AS b, k % 3 + k % 2 + (k % 8 = 0)::BIGINT AS w FROM u), d AS (SELECT *, lag(a) OVER w IS NOT NULL AND lag(a) OVER w = a AND lag(b) OVER w = b AND lag(w) OVER w = s.w AS same, last_value(total IGNORE NULLS) OVER (PARTITION BY stream ORDER BY t, response_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM s WINDOW w AS (PARTITION BY stream ORDER BY t, response_id)) SELECT stream, count(*) FILTER (same) AS repeats, count(*) FILTER (total < seen) AS decreases, count(*) FILTER (w <> a + b) AS violations FROM d GROUP BY stream", USAGE_SQL)
def _(spark, d):
    states = usage(spark, d).selectExpr("stream", "t", "response_id", "CASE WHEN k % 4 > 0 THEN input END AS total", "k % 3 AS a", "k % 2 AS b", "k % 3 + k % 2 + CAST(k % 8 = 0 AS BIGINT) AS w")
    return audit.snapshot_diagnostics(states, "stream", _ORDER, "total", ["a", "b"], "w")


@query("prompt_growth", "WITH r AS (SELECT *, lag(t) OVER w AS pt, lag(effort) OVER w AS pe, lag(input) OVER w AS pi FROM u WHERE model <> 'signup' WINDOW w AS (PARTITION BY stream ORDER BY t, response_id)), m AS (SELECT stream, t, response_id, max(t) FILTER (model = 'signup') OVER (PARTITION BY stream ORDER BY t RANGE UNBOUNDED PRECEDING) AS c FROM u), p AS (SELECT r.*, coalesce(c > pt, false) AS compacted, pe IS DISTINCT FROM effort AS changed FROM r JOIN m USING (response_id) WHERE pt IS NOT NULL) SELECT stream, count(*) AS pairs, count(*) FILTER (compacted) AS compacted, count(*) FILTER (NOT compacted AND changed) AS model_changed, count(*) FILTER (NOT compacted AND NOT changed AND input < pi) AS shrunk FROM p GROUP BY stream", USAGE_SQL)
def _(spark, d):
    rows = usage(spark, d)
    return audit.prompt_growth(rows.where("model <> 'signup'"), rows.where("model = 'signup'"), "stream", "t", "response_id", "effort", "input")


@query("window_lengths", "WITH g AS (SELECT CASE k % 3 WHEN 0 THEN 300 WHEN 1 THEN 10080 ELSE 43200 END AS minutes, count(*) AS n FROM u WHERE model = 'view' GROUP BY 1) SELECT minutes, n, minutes = coalesce((SELECT 10080 FROM g WHERE minutes = 10080), (SELECT max(minutes) FROM g)) AS chosen FROM g", USAGE_SQL)
def _(spark, d):
    return audit.window_lengths(usage(spark, d).where("model = 'view'").selectExpr("CASE k % 3 WHEN 0 THEN 300 WHEN 1 THEN 10080 ELSE 43200 END AS minutes"), "minutes")


_READINGS = f"r AS (SELECT response_id, (t + k * 2000) // {WEEK} AS cluster, t, k % 101 AS percent FROM u WHERE model = 'view'), g AS (SELECT cluster, cluster * {WEEK} AS anchor, min(t) AS first_t, max(t) AS last_t, arg_min(percent, t * 100000000 + response_id) AS first_percent, arg_max(percent, t * 100000000 + response_id) AS last_percent FROM r GROUP BY cluster), o AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN least(anchor, first_t) ELSE first_t END AS opens_at, row_number() OVER w = 1 AS inferred, coalesce(lag(last_t) OVER w > first_t, false) AS overlaps, coalesce(first_percent >= lag(last_percent) OVER w, false) AS no_drop, lead(first_t) OVER w AS next_t FROM g WINDOW w AS (ORDER BY first_t, cluster))"


def _readings(spark, d):
    return usage(spark, d).where("model = 'view'").selectExpr("response_id", f"(t + k * 2000) div {WEEK} AS cluster", "t", "k % 101 AS percent")


def _opened(spark, d):
    at = F.struct("t", "response_id")
    return audit.opened(_readings(spark, d).groupBy("cluster").agg((F.col("cluster") * WEEK).alias("anchor"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.min_by("percent", at).alias("first_percent"), F.max_by("percent", at).alias("last_percent")))


@query("window_openings", f"WITH {_READINGS} SELECT * FROM o", USAGE_SQL)
def _(spark, d):
    return _opened(spark, d)


@query("late_readings", f"WITH {_READINGS} SELECT cluster, count(*) FILTER (NOT coalesce(t > next_t, false)) AS drawn, count(*) FILTER (t > next_t) AS late, max(percent) FILTER (t > next_t) AS late_peak FROM r JOIN o USING (cluster) GROUP BY cluster", USAGE_SQL)
def _(spark, d):
    return audit.late_readings(_readings(spark, d), _opened(spark, d))


@query("plan_attribution", "WITH s AS (SELECT t, CASE WHEN t < 1705190400 THEN 'pro' WHEN response_id % 970 > 0 OR t > 1705800000 THEN 'max' END AS plan, t - 20 * 86400 AS created FROM u WHERE response_id % 97 = 0), v AS (SELECT day, min(t) AS start_t, max(t) AS end_t FROM u GROUP BY day), a AS (SELECT v.*, (SELECT max(t) FROM s WHERE s.t < v.start_t) AS b FROM v), fl AS (SELECT a.*, (SELECT min(plan) FROM s WHERE t >= coalesce(b, start_t)) AS low, (SELECT max(plan) FROM s WHERE t >= coalesce(b, start_t)) AS high, (SELECT bool_or(plan IS NULL) FROM s WHERE t >= coalesce(b, start_t)) AS gap, (SELECT max_by(created, t) FROM s) AS created FROM a) SELECT day, start_t, end_t, CASE WHEN low = high AND NOT gap AND created <= start_t THEN low END AS plan, coalesce(low <> high, false) AS conflict FROM fl", USAGE_SQL)
def _(spark, d):
    rows = usage(spark, d)
    looks = rows.where("response_id % 97 = 0").selectExpr("t", "CASE WHEN t < 1705190400 THEN 'pro' WHEN response_id % 970 > 0 OR t > 1705800000 THEN 'max' END AS plan", "t - 20 * 86400 AS created")
    return audit.plans_of(rows.groupBy("day").agg(F.min("t").alias("start_t"), F.max("t").alias("end_t")), looks)


_SIDES = "a AS (SELECT response_id, stream, input, output FROM u WHERE k % 5 > 0), b AS (SELECT response_id, stream, input, output + (k % 7 = 0)::BIGINT AS output FROM u WHERE k % 3 > 0)"


def _sides(spark, d):
    rows = usage(spark, d)
    return rows.where("k % 5 > 0").select("response_id", "stream", "input", "output"), rows.where("k % 3 > 0").selectExpr("response_id", "stream", "input", "output + CAST(k % 7 = 0 AS BIGINT) AS output")


@query("history_merge", f"WITH {_SIDES} SELECT response_id, coalesce(b.stream, a.stream) AS stream, coalesce(b.input, a.input) AS input, coalesce(b.output, a.output) AS output, CASE WHEN b.stream IS NULL THEN 'kept' WHEN a.stream IS NULL THEN 'new' WHEN a.output = b.output THEN 'same' ELSE 'revised' END AS state FROM a FULL JOIN b USING (response_id)", USAGE_SQL)
def _(spark, d):
    return audit.reconciled(*_sides(spark, d), ["response_id"], ["stream", "input", "output"])


@query("table_diff", f"WITH {_SIDES} SELECT response_id, CASE WHEN b.stream IS NULL THEN 'removed' WHEN a.stream IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b USING (response_id) WHERE b.stream IS NULL OR a.stream IS NULL OR a.output <> b.output", USAGE_SQL)
def _(spark, d):
    return audit.table_diff(*_sides(spark, d), ["response_id"], ["stream", "input", "output"])


@query("frozen_calendar", "SELECT response_id, CASE WHEN k % 3 = 0 THEN day - 1 ELSE day END AS day FROM u", USAGE_SQL)
def _(spark, d):
    rows = usage(spark, d)
    return audit.frozen(rows.select("response_id", "day"), rows.where("k % 3 = 0").select("response_id", F.date_sub("day", 1).alias("day")), "response_id", ["day"])


@query("receipt_failures", "WITH n AS (SELECT stream, count(*) AS n, max(day) AS day FROM u WHERE k % 9 > 0 AND stream % 5 > 0 GROUP BY stream), r AS (SELECT stream, count(*) AS n, max(day) AS day FROM u WHERE k % 9 > 0 OR stream % 2 = 0 GROUP BY stream) SELECT * FROM (SELECT r.stream, CASE WHEN n.stream IS NULL THEN 'missing' WHEN n.n < r.n THEN 'decreased' WHEN n.day <> r.day THEN 'calendar' END AS reason FROM r LEFT JOIN n ON r.stream = n.stream) WHERE reason IS NOT NULL", USAGE_SQL)
def _(spark, d):
    of = lambda rows: rows.groupBy("stream").agg(F.count("*").alias("n"), F.max("day").alias("day"))
    rows = usage(spark, d)
    return audit.receipt_failures(of(rows.where("k % 9 > 0 OR stream % 2 = 0")), of(rows.where("k % 9 > 0 AND stream % 5 > 0")), "stream", "n", "day")


@query("quality_counters", "SELECT model AS counter, CASE WHEN model IN ('view') THEN max(k) ELSE sum(k) END::BIGINT AS n FROM u GROUP BY model", USAGE_SQL)
def _(spark, d):
    return audit.counters(usage(spark, d).selectExpr("model AS counter", "k AS n"), "counter", "n", ["view"])


@query("turn_profile", "WITH g AS (SELECT stream, k - 2 AS turn, model, sum(output)::BIGINT AS output FROM u WHERE k >= 2 GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (PARTITION BY stream ORDER BY turn) AS n FROM g) SELECT stream, turn, model, output FROM r WHERE n <= 20", USAGE_SQL)
def _(spark, d):
    return audit.turn_profile(usage(spark, d).withColumn("turn", F.col("k") - 2), "stream", "turn", "model", "output", 20)


@query("turn_aborts", "WITH fl AS (SELECT stream, CASE WHEN stream % 2 = 0 THEN min(t) + 86400 END AS burst_end FROM u GROUP BY stream) SELECT count(*) FILTER (NOT coalesce(t <= burst_end, false)) AS own, count(*) FILTER (t <= burst_end) AS replayed FROM u JOIN fl USING (stream) WHERE k % 4 = 0", USAGE_SQL)
def _(spark, d):
    rows = usage(spark, d)
    files = rows.groupBy("stream").agg(F.when(F.col("stream") % 2 == 0, F.min("t") + 86_400).alias("burst_end"))
    return audit.own_and_replayed(rows.where("k % 4 = 0"), files, "stream", "t")


@query("searches_on_next", "WITH g AS (SELECT response_id, k % 3 = 0 AS charged, count(*) FILTER (k % 5 = 1) OVER (PARTITION BY stream ORDER BY t, response_id ROWS UNBOUNDED PRECEDING) AS n, stream, t FROM u) SELECT response_id, n - coalesce(lag(n) OVER (PARTITION BY stream ORDER BY t, response_id), 0) AS searches FROM g WHERE charged", USAGE_SQL)
def _(spark, d):
    return audit.searches_on_next(usage(spark, d), "stream", _ORDER, F.col("k") % 3 == 0, F.col("k") % 5 == 1).select("response_id", "searches")


@query("first_cached", "WITH fl AS (SELECT stream, arg_min(cached, t * 100000000 + response_id) AS c FROM u GROUP BY stream) SELECT count(*) AS files, count(*) FILTER (c > 0) AS with_cached FROM fl", USAGE_SQL)
def _(spark, d):
    return audit.first_cached(usage(spark, d), "stream", _ORDER, "cached")


@query("legend", "WITH g AS (SELECT model, effort, sum(output)::BIGINT AS output FROM u GROUP BY ALL), s AS (SELECT *, output / sum(output) OVER ()::DOUBLE AS share FROM g) SELECT * FROM s WHERE share >= 0.05", USAGE_SQL)
def _(spark, d):
    return audit.legend(usage(spark, d).groupBy("model", "effort").agg(F.sum("output").cast("long").alias("output")), "output", 0.05)


@query("turn_numbers", "WITH o AS (SELECT stream, k AS key, min(req) AS req FROM u GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY stream ORDER BY req NULLS LAST, key) - 1 AS turn FROM o", USAGE_SQL)
def _(spark, d):
    return audit.renumbered(usage(spark, d).withColumnRenamed("k", "key"), "stream", "req", "key")


@query("image_bounds", "WITH i AS (SELECT model, k AS lo, CASE WHEN k % 6 > 0 THEN k * 2 END AS hi, output AS bytes FROM u) SELECT model, count(*) AS images, sum(lo)::BIGINT AS lo, sum(hi)::BIGINT AS hi, count(*) FILTER (hi IS NULL) AS unknown, sum(bytes)::BIGINT AS bytes FROM i GROUP BY model", USAGE_SQL)
def _(spark, d):
    return audit.images(usage(spark, d).selectExpr("model", "k AS lo", "CASE WHEN k % 6 > 0 THEN k * 2 END AS hi", "output AS bytes"), "model")


@query("month_coverage", "WITH r AS (SELECT (t // 604800)::BIGINT AS month, k FROM u), fl AS (SELECT DISTINCT month, 'missing' AS reason FROM r WHERE k = 17 UNION SELECT month, 'decreased' FROM r WHERE k IN (18, 19) UNION SELECT 1, 'calendar'), g AS (SELECT month, list(reason ORDER BY reason) AS reasons FROM fl GROUP BY month), m AS (SELECT month FROM r UNION SELECT month FROM fl) SELECT m.month, g.month IS NULL AS safe, coalesce(array_to_string(reasons, ','), '') AS reasons FROM m LEFT JOIN g USING (month)", USAGE_SQL)
def _(spark, d):
    rows = usage(spark, d).selectExpr("t div 604800 AS month", "k")
    failed = rows.where("k IN (17, 18, 19)").selectExpr("month", "CASE WHEN k = 17 THEN 'missing' ELSE 'decreased' END AS reason").unionByName(spark.range(1).selectExpr("id + 1 AS month", "'calendar' AS reason"))
    return records.month_coverage(rows, failed, "month").withColumn("reasons", F.array_join("reasons", ","))


@query("cost_checks", "SELECT *, reported - captured AS difference FROM (SELECT response_id, stream, model, t, input AS reported, (SELECT coalesce(sum(output), 0)::BIGINT FROM u b WHERE b.stream = a.stream AND b.model = a.model AND b.t <= a.t AND b.k % 6 > 0) AS captured, (SELECT count(*) FILTER (b.k % 6 = 0) FROM u b WHERE b.stream = a.stream AND b.model = a.model AND b.t <= a.t) AS unpriced FROM u a WHERE k % 10 = 0)", USAGE_SQL)
def _(spark, d):
    rows = usage(spark, d)
    checks = rows.where("k % 10 = 0").selectExpr("response_id", "stream", "model", "t", "input AS reported")
    return records.cost_checks(checks, rows.selectExpr("stream", "model", "t", "CASE WHEN k % 6 > 0 THEN output END AS cost"), ["stream", "model"], "t", "reported", "cost")


_WINDOW_RULES = {"window_duplicate": "copy > 1", "window_before": "start < 1704200000", "window_future": "start > 1706500000", "window_first_peak": "first_percent > peak", "window_cached": "cached > input", "window_no_responses": "input + output <> 0 AND responses = 0"}
_SPLIT_RULES = {"split_duplicate": "copy > 1", "split_cached": "cached > input", "split_cache_write": "written > greatest(input - cached, 0)", "split_no_responses": "input + output <> 0 AND responses = 0"}
_WINDOW_COUNTS = ("responses", "input", "cached", "output")


@query("window_rules", f"WITH w AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY peak) AS copy FROM (SELECT t // 3600 * 3600 AS start, k AS first_percent, k + response_id % 5 - 1 AS peak, input * 9 AS input, cached * (9 + k % 2 * 4) AS cached, output * 9 AS output, k % 4 AS responses FROM u)), p AS (SELECT *, row_number() OVER (PARTITION BY start, model, tier ORDER BY input) AS copy FROM (SELECT t // 3600 * 3600 AS start, model, tier, input, cached * (1 + k % 2) AS cached, reasoning * 9 AS written, output, k % 3 AS responses FROM u)), j AS (SELECT {', '.join(f'w.{c}, s.{c} AS s_{c}' for c in _WINDOW_COUNTS)} FROM w JOIN (SELECT start, {', '.join(f'sum({c}) AS {c}' for c in _WINDOW_COUNTS)} FROM p GROUP BY start) s USING (start)) " + " UNION ALL ".join([f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS n FROM w" for n, c in _WINDOW_RULES.items()] + [f"SELECT '{n}', count(*) FILTER ({c}) FROM p" for n, c in _SPLIT_RULES.items()] + [f"SELECT 'split_{c}_total', count(*) FILTER (s_{c} > {c}) FROM j" for c in _WINDOW_COUNTS]), USAGE_SQL)
def _(spark, d):
    rows = usage(spark, d).withColumn("start", F.expr("t div 3600 * 3600"))
    windows = rows.selectExpr("start", "k AS first_percent", "k + response_id % 5 - 1 AS peak", "input * 9 AS input", "cached * (9 + k % 2 * 4) AS cached", "output * 9 AS output", "k % 4 AS responses")
    splits = rows.selectExpr("start", "model", "tier", "input", "cached * (1 + k % 2) AS cached", "reasoning * 9 AS written", "output", "k % 3 AS responses")
    return records.window_rules(windows, splits, 1_704_200_000, 1_706_500_000)


@query("plan_at_completion", f"WITH n AS (SELECT * FROM u WHERE response_id % 50 = 0), i AS (SELECT response_id AS interval, t AS s, lead(t) OVER (ORDER BY t, response_id) AS e FROM n) SELECT response_id, interval FROM u JOIN i ON u.t >= s AND u.t < e", USAGE_SQL)
def _(spark, d):
    rows = usage(spark, d)
    # one row for each change of plan, a small table
    changes = rows.where("response_id % 50 = 0").select(F.col("response_id").alias("interval"), F.col("t").alias("s"), F.lead("t").over(Window.orderBy("t", "response_id")).alias("e")).where("e > s")
    return limits.in_intervals(rows.select("response_id", "t"), changes, "t", "s", "e", 86_400).select("response_id", "interval")


@query("tool_times", "WITH c AS (SELECT model AS tool, t - req AS seconds FROM u WHERE t - req > 0 AND t - req <= 7200), g AS (SELECT tool, count(*) AS n, sum(seconds)::BIGINT AS total, round(quantile_cont(seconds::DOUBLE, 0.5), 3) AS median, round(quantile_cont(seconds::DOUBLE, 0.9), 3) AS p90 FROM c GROUP BY tool) SELECT * FROM g ORDER BY total DESC, tool LIMIT 3", USAGE_SQL)
def _(spark, d):
    return latency.tool_times(usage(spark, d).selectExpr("model AS tool", "req AS start_t", "t AS end_t"), 3).withColumns({c: F.round(c, 3) for c in ("median", "p90")})


@query("turn_times", "WITH r AS (SELECT stream, t // 7200 AS turn, t, CASE WHEN req < t THEN t - req END AS seconds FROM u), xs AS (SELECT stream, turn, max(t) - turn * 7200 AS turn_s, coalesce(sum(seconds), 0)::BIGINT AS m FROM r GROUP BY stream, turn) SELECT stream, turn, turn_s, least(turn_s, m) / turn_s::DOUBLE AS model_share FROM xs WHERE turn_s > 0 AND turn_s <= 7200", USAGE_SQL)
def _(spark, d):
    timed = usage(spark, d).selectExpr("stream", "t div 7200 AS turn", "t", "CASE WHEN req < t THEN t - req END AS seconds", "CAST(NULL AS STRING) AS reason")
    return latency.turn_times(timed.select("stream", "turn", (F.col("turn") * 7200).alias("start_t")).distinct(), timed)


@query("copy_merge", f"""WITH {COPIES_SQL},
o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n) AS pos FROM b WHERE n % 3 <> 0), w AS (SELECT * FROM b WHERE n % 4 <> 1),
c AS (SELECT o.r, o.n, o.pos, o.changed FROM o JOIN w USING (r, n)),
k AS (SELECT r, n, pos, 1 AS side FROM o UNION ALL
  SELECT w.r, w.n, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.r = w.r) THEN coalesce((SELECT min(c.pos) FROM c WHERE c.r = w.r AND c.n > w.n), (SELECT max(c.pos) FROM c WHERE c.r = w.r AND c.n < w.n),
    (SELECT min(o.pos) FROM o WHERE o.r = w.r AND o.n > (SELECT min(x.n) FROM w x WHERE x.r = w.r)), 1000) ELSE 0 END,
    CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.r = w.r AND c.n > w.n) THEN 0 WHEN EXISTS (SELECT 1 FROM c WHERE c.r = w.r AND c.n < w.n) THEN 2 ELSE 0 END FROM w WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.r = w.r AND o.n = w.n))
SELECT r::VARCHAR AS response, string_agg(n::VARCHAR, ',' ORDER BY pos, side, n) AS lines, (SELECT count(*) FROM c WHERE c.r = k.r AND changed) AS revisions, r || '-' || max(n) AS terminal,
  EXISTS (SELECT 1 FROM c WHERE c.r = k.r AND changed) AS conflict FROM k GROUP BY r""")
def _(spark, d):
    old, new = captures(spark, d)
    rows = history.merged(history.copies(old), history.copies(new))
    lines = F.array_join(F.transform("blocks", lambda b: F.split_part(b["record"], F.lit("-"), F.lit(2))), ",")
    return rows.select("response", lines.alias("lines"), F.size("revisions").cast("long").alias("revisions"), "terminal", "conflict")


@query("copy_charges", f"""WITH {COPIES_SQL},
c AS (SELECT r, p, CASE WHEN n % 3 = 0 AND changed THEN q + 1 ELSE q END AS q, row_number() OVER (PARTITION BY r ORDER BY n DESC) AS i FROM b WHERE n % 3 <> 0 OR n % 4 <> 1)
SELECT count(*) AS responses, sum(p)::BIGINT AS input, sum(q)::BIGINT AS output FROM c WHERE i = 1""")
def _(spark, d):
    old, new = captures(spark, d)
    rows = history.charged(history.merged(history.copies(old), history.copies(new)))
    return rows.agg(F.count("*").alias("responses"), F.sum("usage.input").alias("input"), F.sum("usage.output").alias("output"))


@query("tree_state", f"""WITH RECURSIVE {USAGE_SQL}, {TREE_SQL},
n AS MATERIALIZED (SELECT *, coalesce(side = 'turn' AND line > 20, false) AS opens, coalesce(side IN ('turn', 'input') AND line > 20, false) AS prompt,
  count(*) FILTER (side = 'turn' AND line > 20) OVER (PARTITION BY path ORDER BY line ROWS UNBOUNDED PRECEDING) - 1 AS nth FROM r),
w AS (SELECT path, line, CASE WHEN line <> 20 AND prompt THEN t END AS a, CASE WHEN line <> 20 AND side = 'summary' THEN t END AS c, CASE WHEN line <> 20 AND opens THEN nth END AS turn FROM n WHERE up < 0
  UNION ALL SELECT n.path, n.line, CASE WHEN n.line = 20 THEN NULL WHEN n.prompt THEN n.t ELSE w.a END, CASE WHEN n.line = 20 THEN NULL WHEN n.side = 'summary' THEN n.t ELSE w.c END, CASE WHEN n.line = 20 THEN NULL WHEN n.opens THEN n.nth ELSE w.turn END
  FROM w JOIN n ON n.path = w.path AND n.up = w.line)
SELECT path, line, CASE WHEN a IS NOT NULL THEN greatest(a, c) END AS anchor, turn FROM w""")
def _(spark, d):
    return trees.request_state(tree_records(spark, d)).select("path", "line", "anchor", "turn")


_REQUESTS = f"""{TIMED_SQL}, le AS (SELECT *, event = 'usage' AND step = 6 AND k % 7 <> 0 AS ends, event IN ('turn', 'abort') AS breaks FROM l),
g AS (SELECT *, coalesce(sum((ends OR breaks)::INT) OVER (PARTITION BY stream ORDER BY stamp, response_id, step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS response,
  last_value(CASE WHEN event IN ('turn', 'input') THEN t END IGNORE NULLS) OVER z AS given, last_value(CASE WHEN event = 'compact' THEN t END IGNORE NULLS) OVER z AS compact
  FROM le WINDOW z AS (PARTITION BY stream ORDER BY stamp, response_id, step ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, first_value(CASE WHEN event = 'output' THEN coalesce(greatest(given, compact), -1) END IGNORE NULLS) OVER (PARTITION BY stream, response ORDER BY stamp, response_id, step ROWS UNBOUNDED PRECEDING) AS frozen FROM g),
q AS (SELECT *, CASE WHEN frozen IS NULL THEN given WHEN frozen >= 0 THEN frozen END AS req FROM h WHERE ends)"""


@query("request_start", "SELECT 'rollout-' || stream || '.jsonl' AS path, response_id AS id, t::DOUBLE AS t, req::DOUBLE AS req FROM q", f"{USAGE_SQL}, {_REQUESTS}")
def _(spark, d):
    return requests.request_starts(rollout.events(timed_lines(spark, d))).where("ends").select("path", F.col("place.id").alias("id"), "t", "req")


@query("logged_latency", """WITH m AS (SELECT *, max(t) OVER (PARTITION BY stream ORDER BY t, response_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor FROM q),
s AS (SELECT stream, t - greatest(req, coalesce(floor, req)) AS seconds FROM m WHERE req IS NOT NULL)
SELECT 'rollout-' || stream || '.jsonl' AS stream, count(*) AS n, sum(seconds)::DOUBLE AS total, median(seconds)::DOUBLE AS median, quantile_cont(seconds, 0.9)::DOUBLE AS p90 FROM s WHERE seconds > 0 AND seconds <= 3600 GROUP BY stream""", f"{USAGE_SQL}, {_REQUESTS}")
def _(spark, d):
    rows = requests.request_starts(rollout.events(timed_lines(spark, d))).where("ends")
    return latency.summary(latency.samples(rows.select(F.col("path").alias("stream"), F.col("place.id").alias("response_id"), "t", "req")), "stream")


_ANNOUNCED = f"{USAGE_SQL}, {QUOTES_SQL}, rd AS (SELECT 'acct-' || (stream % 4) AS account, response_id, t, resets_at::DOUBLE AS resets_at FROM q)"


def _announced(spark, d):
    account = F.concat(F.lit("acct-"), (F.col("stream") % 4).cast("string"))
    return quotes(spark, d).select(account.alias("account"), F.lit("weekly_all").alias("kind"), F.lit("").alias("scope"), F.col("response_id").cast("string").alias("reading_key"), F.col("resets_at").cast("double").alias("resets_at"), "t", "percent")


@query("reset_anchors", f"""WITH w AS (SELECT account, response_id, resets_at, (resets_at::BIGINT // {WEEK}) * {WEEK} AS week FROM rd),
c AS (SELECT account, week, floor(median(resets_at) + 0.5) AS reset_at FROM w WHERE response_id % 2 = 0 GROUP BY ALL),
k AS (SELECT * FROM c UNION ALL SELECT w.account, w.week, floor(median(w.resets_at) + 0.5) FROM w ANTI JOIN c ON c.account = w.account AND c.week = w.week GROUP BY ALL)
SELECT account, reset_at::DOUBLE AS reset_at, (SELECT count(*) FROM w WHERE w.account = k.account AND w.week = k.week) AS readings FROM k""", _ANNOUNCED)
def _(spark, d):
    """Anchors of the even readings are captured; those of the odd ones join them or make new ones."""
    rows = _announced(spark, d)
    even = F.col("reading_key").cast("long") % 2 == 0
    none = spark.createDataFrame([], anchors.ANCHOR)
    before, first = anchors.captured(rows.where(even), none)
    after, every = anchors.captured(rows.where(~even), first)
    counts = before.select("account", "window_key").unionByName(after.select("account", "window_key")).groupBy("account", "window_key").agg(F.count("*").alias("readings"))
    return every.join(counts, ["account", "window_key"]).select("account", "reset_at", "readings")


@query("window_union", f"SELECT 'acct-' || (stream % 4) AS account, (resets_at // {WEEK}) * {WEEK} AS start, count(*) AS responses, sum(percent)::BIGINT AS input, max(percent) AS peak FROM q GROUP BY ALL", f"{USAGE_SQL}, {QUOTES_SQL}")
def _(spark, d):
    """Windows as an earlier run published them, from two thirds of the readings, and as they are now."""
    rows = _announced(spark, d).withColumn("start", F.expr(f"(CAST(resets_at AS BIGINT) div {WEEK}) * {WEEK}")).withColumn("id", F.col("reading_key").cast("long"))
    empty = F.array().cast("array<struct<model: string, tier: string, responses: bigint, input: bigint, output: bigint>>")
    build = lambda df: df.groupBy("account", "start").agg(F.count("*").alias("responses"), F.sum("percent").alias("input"), F.sum("id").alias("output"), F.max("percent").alias("peak")).withColumns({"first_percent": F.lit(0), "split": empty})
    return anchors.published(build(rows.where("id % 3 > 0")), build(rows)).select("account", "start", "responses", "input", "peak")


_ITEMS = """i0 AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY t, response_id) AS n, k % 11 = 0 AS reset FROM u),
i1 AS (SELECT *, count(*) FILTER (reset) OVER (PARTITION BY stream ORDER BY n ROWS UNBOUNDED PRECEDING) AS segment FROM i0),
i2 AS (SELECT *, count(*) FILTER (NOT reset) OVER (PARTITION BY stream, segment ORDER BY n ROWS UNBOUNDED PRECEDING) AS place, coalesce(sum(output) FILTER (NOT reset) OVER (PARTITION BY stream, segment ORDER BY n ROWS UNBOUNDED PRECEDING), 0) AS upto FROM i1),
it AS (SELECT *, CASE WHEN k % 7 = 3 THEN -n ELSE place END AS content FROM i2),
rq AS (SELECT *, last_value(CASE WHEN charged THEN {'s': segment, 'l': place} END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM (SELECT *, k % 3 > 0 AS charged FROM it WHERE k % 2 = 1))"""


def _items_requests(spark, d):
    """Rows as items of a prompt's log, some of which compact it; what is logged anew repeats the old prompt's beginning but
    for the rows that changed. Every other row is a request."""
    order = Window.partitionBy("stream").orderBy("t", "response_id")
    rows = usage(spark, d).withColumn("n", F.row_number().over(order).cast("long")).withColumn("reset", F.col("k") % 11 == 0)
    upto = Window.partitionBy("stream").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s0", F.count_if("reset").over(upto))
    rows = rows.withColumn("p0", F.count_if(~F.col("reset")).over(Window.partitionBy("stream", "s0").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("content", F.when(F.col("k") % 7 == 3, -F.col("n")).otherwise(F.col("p0")))
    chain = prefixes.chained(rows, "stream", ["n"], F.col("reset"), F.col("content"), "output")
    asked = chain.where("k % 2 = 1").select("stream", F.col("n").alias("request"), (F.col("k") % 3 > 0).alias("charged"), "segment", F.col("place").alias("length"))
    return chain, asked


@query("stable_prefixes", "SELECT stream, n AS request, CASE WHEN base.s = segment THEN least(place, base.l) ELSE 0 END AS stable_items FROM rq", f"{USAGE_SQL}, {_ITEMS}")
def _(spark, d):
    return prefixes.stable_prefix(*_items_requests(spark, d), "stream").select("stream", "request", "stable_items")


@query("equal_prefixes", """WITH df AS (SELECT r.stream, r.n, min(a.place) AS first FROM rq r JOIN it a ON a.stream = r.stream AND a.segment = r.segment AND NOT a.reset AND a.place <= least(r.place, r.base.l)
  JOIN it b ON b.stream = r.stream AND b.segment = r.base.s AND NOT b.reset AND b.place = a.place WHERE a.content <> b.content GROUP BY ALL),
ln AS (SELECT r.*, coalesce(df.first - 1, CASE WHEN r.base IS NULL THEN 0 ELSE least(r.place, r.base.l) END) AS same FROM rq r LEFT JOIN df ON df.stream = r.stream AND df.n = r.n)
SELECT ln.stream, ln.n AS request, ln.same AS stable_items, coalesce(it.upto, 0)::BIGINT AS stable FROM ln LEFT JOIN it ON it.stream = ln.stream AND it.segment = ln.segment AND it.place = ln.same AND NOT it.reset""", f"{USAGE_SQL}, {_ITEMS}")
def _(spark, d):
    return prefixes.stable_prefix(*_items_requests(spark, d), "stream", across=True).select("stream", "request", "stable_items", "stable")


@query("terminal_evidence", """WITH b AS (SELECT l_orderkey::VARCHAR AS response, l_linenumber::BIGINT AS i, l_quantity::BIGINT AS q FROM lineitem),
r AS (SELECT response, i, max(q) AS q, count(DISTINCT q) AS n FROM b GROUP BY response, i)
SELECT response, max(i) AS terminal, arg_max(q, i) AS output, count(*) AS blocks, max(n) > 1 AS conflict FROM r GROUP BY response""")
def _(spark, d):
    """The state that the stream of late evidence ends with, whatever order blocks arrive in."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("response"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record"), F.col("l_linenumber").cast("long").alias("index"), F.col("l_quantity").cast("long").alias("output"))
    return late.terminals(rows)


@query("image_patch_fit", """WITH p AS (SELECT p_partkey, (p_partkey * 7919) % 6000 + 1 AS w, (p_size * 5099) % 5000 + 1 AS h, CASE WHEN p_partkey % 2 = 0 THEN 2576 ELSE 1568 END AS me, CASE WHEN p_partkey % 2 = 0 THEN 4784 ELSE 1568 END AS mt FROM part),
e AS (SELECT *, unnest(range(1, least(greatest(w, h), me) + 1)) AS edge FROM p), o AS (SELECT *, greatest(1, round_even(least(w, h)::DOUBLE * edge / greatest(w, h), 0))::BIGINT AS other FROM e),
f AS (SELECT * FROM o WHERE ceil(edge / 28) * 28 <= me AND ceil(other / 28) * 28 <= me AND ceil(edge / 28) * ceil(other / 28) <= mt)
SELECT p_partkey, max(edge)::BIGINT AS edge, arg_max(ceil(edge / 28) * ceil(other / 28), edge)::BIGINT AS tokens FROM f GROUP BY p_partkey""")
def _(spark, d):
    dealt = table(spark, d, "part").select("p_partkey", "p_size").repartition("p_partkey")  # a file of one row group is one task
    rows = dealt.select("p_partkey", ((F.col("p_partkey") * 7919) % 6000 + 1).alias("w"), ((F.col("p_size") * 5099) % 5000 + 1).alias("h"), F.when(F.col("p_partkey") % 2 == 0, "m-x-4-7").otherwise("m-x-4").alias("model"))
    limits = scalar.image_limits(F.col("model"))
    fitted = rows.select("p_partkey", scalar.patch_fit(F.col("w"), F.col("h"), limits["max_edge"], limits["max_tokens"]).alias("x"))
    return fitted.select("p_partkey", F.greatest("x.width", "x.height").alias("edge"), "x.tokens")


@query("key_census", """WITH kn AS (SELECT sum(CASE WHEN twice THEN 2 ELSE 1 END) FILTER (whole)::BIGINT AS n, count(DISTINCT stream) FILTER (whole) AS f, count(DISTINCT stream) AS h FROM x),
ke(key, type) AS (VALUES ('.payload.info', 'object'), ('.payload.info.last_token_usage', 'object'), ('.payload.info.total_token_usage', 'object'), ('.payload.type', 'string')),
kc(key) AS (SELECT '.payload.info.' || a || '.' || b FROM (VALUES ('last_token_usage'), ('total_token_usage')) x(a), (VALUES ('input_tokens'), ('cached_input_tokens'), ('output_tokens'), ('reasoning_output_tokens'), ('total_tokens')) y(b))
SELECT '$' || key AS key, type, n + CASE WHEN common THEN h ELSE 0 END AS n, CASE WHEN common THEN h ELSE f END AS files FROM kn, (SELECT *, false AS common FROM ke UNION ALL SELECT key, 'number', false FROM kc UNION ALL VALUES ('', 'object', true), ('.timestamp', 'string', true), ('.type', 'string', true), ('.payload', 'object', true))
UNION ALL SELECT '$' || key, 'string', h, h FROM kn, (VALUES ('.payload.session_id'), ('.payload.id')) v(key)""", _LOGGED)
def _(spark, d):
    return census.key_census(log_lines(spark, d))


@query("payload_months", """WITH y AS (SELECT 'acct-' || (stream % 4) AS account, date_trunc('week', day)::DATE::VARCHAR AS month, day::VARCHAR AS date, sum(input)::BIGINT AS input FROM u GROUP BY ALL),
z AS (SELECT 'acct-' || (stream % 4) AS account, date_trunc('week', day)::DATE::VARCHAR AS month, stream::VARCHAR AS stream, count(*) AS n FROM u GROUP BY ALL),
a AS (SELECT account, month, count(*) AS days, sum(length('{"date":"' || date || '","input":' || input || '}') + 1)::BIGINT AS own, bool_or(date < '2024-01-03') AS broken FROM y GROUP BY ALL),
b AS (SELECT account, month, sum(length('{"stream":"' || stream || '","n":' || n || '}') + 1)::BIGINT AS more FROM z GROUP BY ALL),
c AS (SELECT a.*, own + coalesce(more, 0) AS bytes, CASE WHEN broken THEN 'rule' WHEN days > 18 OR own + 200 > 6000 THEN 'alone' END AS why FROM a LEFT JOIN b USING (account, month)),
s AS (SELECT *, sum(days) OVER w > 18 OR sum(bytes) OVER w + 200 > 6000 AS over FROM (SELECT *, why IS NULL AS ok FROM c) WINDOW w AS (PARTITION BY account, ok ORDER BY month DESC ROWS UNBOUNDED PRECEDING))
SELECT account, month, days, bytes, coalesce(why, CASE WHEN over THEN 'budget' END) AS reason FROM s""", USAGE_SQL)
def _(spark, d):
    """The tables span one month, so weeks stand for months here."""
    rows = usage(spark, d).withColumns({"account": F.concat(F.lit("acct-"), (F.col("stream") % 4).cast("string")), "month": F.to_date(F.date_trunc("week", "day")).cast("string"), "date": F.col("day").cast("string"), "stream": F.col("stream").cast("string")})
    days = rows.groupBy("account", "month", "date").agg(F.sum("input").alias("input"))
    sessions = rows.groupBy("account", "month", "stream").agg(F.count("*").alias("n"))
    return payload.months_within(days, sessions, "2999-12-31", most_days=18, most_bytes=6000, earliest="2024-01-03")
