"""Run logs, conversations, accounts and service metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackmill.plans import views

#: Search quota of a run, history lengths, tries and cool-down of one-time codes, histogram edges in seconds.
QUOTA, HISTORY, PROMPT_HISTORY, MAX_TRIES, COOL_DOWN = 6, 12, 6, 5, 60
EDGES = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


# --- run logs ----------------------------------------------------------------------------------------------------------


def evidence_key(chunk_id: Column, doc_id: Column, page: Column, section: Column) -> Column:
    """I1."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.coalesce(F.nullif(chunk_id.cast("string"), F.lit("")), F.concat(text(doc_id), F.lit(":"), text(page), F.lit(":"), F.coalesce(section, F.lit(""))))


def accumulate_evidence(hits: DataFrame) -> DataFrame:
    """I2. run, step, call, rank, key: the first occurrence of each key in a run, numbered in that order."""
    w = Window.partitionBy("run", "key").orderBy("step", "call", "rank")
    first = hits.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("run").orderBy("step", "call", "rank")) - 1)


def prioritise(evidence: DataFrame, wanted: DataFrame) -> DataFrame:
    """I3. wanted: run, key, key_pos. Chosen keys first, in their order; the rest as it was."""
    joined = evidence.join(wanted, ["run", "key"], "left")
    return joined.withColumn("place", F.row_number().over(Window.partitionBy("run").orderBy(F.col("key_pos").asc_nulls_last(), "ord")) - 1)


def grant_units(calls: DataFrame, quota: int = QUOTA) -> DataFrame:
    """I5. run, ord, units (searches that a call plans; 0 for cached or invalid calls) -> granted: what is left of the quota
    when its turn comes. The running total cut at the quota, minus the same for the calls before."""
    w = Window.partitionBy("run").orderBy("ord")
    total = F.sum("units").over(w)
    return calls.withColumn("granted", F.least(F.lit(quota), total) - F.least(F.lit(quota), total - F.col("units")))


def cached_calls(calls: DataFrame) -> DataFrame:
    """I6. run, step, ord, key: a call whose key was seen in an earlier step returns that step's observation."""
    w = Window.partitionBy("run", "key")
    first = F.min("step").over(w)
    return calls.withColumn("first_step", first).withColumn("cached", F.col("step") > F.col("first_step"))


def fold_events(events: DataFrame) -> DataFrame:
    """I8. run, step, seq, status, delta: the last status of each step, its deltas joined in order."""
    return events.groupBy("run", "step").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("status"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("thought"),
        F.count("*").alias("n_events"),
    )


# --- conversations and accounts ----------------------------------------------------------------------------------------


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """J1, J2. The last n messages of each session, oldest first (pos from 1)."""
    back = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("turn"))
    kept = messages.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= n)
    return kept.withColumn("pos", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("back")))).drop("back")


def change_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """J6. key, details: map of the changed fields to struct<from, to>, compared with nulls as values."""
    o = old.select(F.col(key).alias("_k"), *[F.col(f).cast("string").alias(f"o_{f}") for f in fields])
    entry = lambda f: F.struct(F.lit(f).alias("key"), F.struct(F.col(f"o_{f}").alias("from"), F.col(f).cast("string").alias("to")).alias("value"))
    changed = F.filter(F.array(*[entry(f) for f in fields]), lambda e: ~e["value"]["from"].eqNullSafe(e["value"]["to"]))
    return new.join(o, new[key] == o["_k"]).select(key, F.map_from_entries(changed).alias("details")).filter(F.size("details") > 0)


def effective_settings(registry: DataFrame, overrides: DataFrame) -> DataFrame:
    """J7. registry: key, type, default_value. Overrides of known keys, read by type; what does not read is an error and leaves the default."""
    joined = registry.join(overrides.select("key", F.col("value").alias("raw")), "key", "left")
    ok = (
        F.when(F.col("raw").isNull(), False)
        .when(F.col("type") == "int", F.col("raw").try_cast("bigint").isNotNull())
        .when(F.col("type") == "float", F.col("raw").try_cast("double").isNotNull())
        .when(F.col("type") == "bool", F.lower(F.trim("raw")).isin("true", "false", "1", "0", "yes", "no", "on", "off"))
        .otherwise(True)
    )
    return joined.select("key", F.when(ok, F.trim("raw")).otherwise(F.col("default_value")).alias("value"), (F.col("raw").isNotNull() & ~ok).alias("error"))


def challenge_state(challenges: DataFrame, now: Column) -> DataFrame:
    """J8. key, created_at, expires_at, tries -> the latest challenge of each key and its state."""
    w = Window.partitionBy("key").orderBy(F.desc("created_at"), F.desc("id"))
    last = challenges.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
    state = F.when(F.col("expires_at") <= now, "expired").when(F.col("tries") >= MAX_TRIES, "exhausted").otherwise("live")
    return last.withColumn("state", state).withColumn("may_resend", F.col("created_at") + F.make_dt_interval(secs=F.lit(COOL_DOWN)) <= now)


# --- metrics -----------------------------------------------------------------------------------------------------------


def histogram(durations: DataFrame, labels: list[str], value: str = "duration") -> DataFrame:
    """K2. Cumulative counts up to each edge, sum and count of every label set."""
    return durations.groupBy(*labels).agg(*[F.count_if(F.col(value) <= e).alias(f"le_{str(e).replace('.', '_')}") for e in EDGES], F.count(value).alias("n"), F.sum(value).alias("total"))


def paired_tasks(events: DataFrame) -> DataFrame:
    """K4. task, task_id, kind (start or end), at, state -> counts by task and state, and the durations of tasks with both ends."""
    one = events.groupBy("task", "task_id").agg(F.max(F.when(F.col("kind") == "start", F.col("at"))).alias("s"), F.max(F.when(F.col("kind") == "end", F.col("at"))).alias("e"), F.max(F.when(F.col("kind") == "end", F.col("state"))).alias("state"))
    done = one.filter("e is not null").withColumn("seconds", F.unix_timestamp("e") - F.unix_timestamp("s"))
    return done.groupBy("task", "state").agg(F.count("*").alias("n"), F.count("seconds").alias("n_timed"), F.sum("seconds").alias("seconds"))


# --- queries -----------------------------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return views.table(spark, sf_dir, "events")


def _log(spark, sf_dir) -> DataFrame:
    """Events as the calls of runs: run, step, ord, action, units, key, chunk, ts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, sf_dir).withColumn("ord", F.row_number().over(w))
    return e.select(F.col("user_id").alias("run"), views.int_div(F.col("ord") - 1, 3).alias("step"), "ord", F.col("event_type").alias("action"), (F.col("event_id") % 4).cast("long").alias("units"), F.concat("event_type", F.lit(":"), (F.col("event_id") % 5).cast("string")).alias("key"), (F.col("event_id") % 100).alias("chunk"), "ts")


def step_events(spark, sf_dir, *more: Column) -> DataFrame:
    """run, step, seq, status (null for every fourth), delta."""
    return _log(spark, sf_dir).select("run", "step", F.col("ord").alias("seq"), F.when(F.col("units") != 3, F.col("action")).alias("status"), F.concat("key", F.lit(" ")).alias("delta"), *more)


def _evidence(spark, sf_dir) -> DataFrame:
    log = _log(spark, sf_dir)
    hits = log.select("run", "step", F.col("ord").alias("call"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rank"), "chunk")
    return hits.select("run", "step", "call", "rank", evidence_key(F.when(F.col("chunk") % 4 != 0, (F.col("chunk") + F.col("rank")) % 40), F.col("chunk") % 10, F.col("rank"), F.lit(None).cast("string")).alias("key"))


def _messages(spark, sf_dir) -> DataFrame:
    c = views.table(spark, sf_dir, "conversations")
    return c.select(views.int_div(F.col("conv_id"), 4).alias("session_id"), "conv_id", "turn", "role", (F.col("conv_id") * 100 + F.col("turn")).alias("created_at"))


def i01_evidence_key(spark, sf_dir):
    return _evidence(spark, sf_dir).groupBy("key").agg(F.count("*").alias("n"))


def i02_accumulate(spark, sf_dir):
    return accumulate_evidence(_evidence(spark, sf_dir)).select("run", "key", "step", "ord")


def i03_prioritise(spark, sf_dir):
    ev = accumulate_evidence(_evidence(spark, sf_dir))
    wanted = ev.filter("ord % 5 = 3 and ord < 50").select("run", "key", (100 - F.col("ord")).alias("key_pos"))
    return prioritise(ev, wanted).select("run", "key", "place")


def i04_units(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("action").agg(F.sum("units").alias("units"), F.count("*").alias("calls"))


def i05_quota(spark, sf_dir):
    return grant_units(_log(spark, sf_dir)).select("run", "ord", "units", "granted")


def i06_cached_calls(spark, sf_dir):
    return cached_calls(_log(spark, sf_dir)).select("run", "ord", "first_step", "cached")


def i08_fold_events(spark, sf_dir):
    return fold_events(step_events(spark, sf_dir))


def i09_run_summary(spark, sf_dir):
    runs = grant_units(_log(spark, sf_dir)).groupBy("run").agg(F.max("step").alias("steps"), F.sum("granted").alias("units"))
    ev = accumulate_evidence(_evidence(spark, sf_dir)).groupBy("run").agg(F.count("*").alias("evidence"))
    return runs.join(ev, "run")


def x7_run_audit(spark, sf_dir):
    """Quota, cache, evidence and priorities of every run."""
    calls = grant_units(cached_calls(_log(spark, sf_dir)).withColumn("units", F.when(F.col("cached"), 0).otherwise(F.col("units"))))
    spent = calls.groupBy("run").agg(F.sum("granted").alias("units"), F.count_if(F.col("cached")).alias("cached"))
    top = i03_prioritise(spark, sf_dir).filter("place < 3").groupBy("run").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "key"))), lambda x: x["key"]), "|").alias("top"))
    return spent.join(top, "run")


def j01_history(spark, sf_dir):
    return last_messages(_messages(spark, sf_dir), HISTORY).select("session_id", "conv_id", "turn", "pos")


def j02_prompt_history(spark, sf_dir):
    return last_messages(_messages(spark, sf_dir), PROMPT_HISTORY).select("session_id", "conv_id", "turn", "pos")


def j04_audit_log(spark, sf_dir):
    """Newest orders as audit rows, with the names of actor and target."""
    o = views.table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50)
    c = views.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    a, t = c.select(F.col("c_custkey").alias("ak"), F.col("c_name").alias("actor")), c.select(F.col("c_custkey").alias("tk"), F.col("c_name").alias("target"))
    o = o.withColumn("t", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_custkey") + 1))
    return F.broadcast(o).join(a, F.col("o_custkey") == F.col("ak"), "left").join(t, F.col("t") == F.col("tk"), "left").select("o_orderkey", "actor", "target")


def _identities(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer")
    kinds = F.filter(F.array(F.when(F.col("c_custkey") % 2 == 0, "email"), F.when(F.col("c_custkey") % 3 == 0, "phone"), F.when(F.col("c_custkey") % 5 == 0, "wechat")), lambda x: x.isNotNull())
    return c.select(F.col("c_custkey").alias("user_id"), F.posexplode(kinds).alias("ord", "provider"), "c_name").withColumn("uid", F.concat("provider", F.lit(":"), (F.col("user_id") % 700).cast("string")))


def j05_user_columns(spark, sf_dir):
    """Users with a column for each provider, the last identity winning."""
    wide = _identities(spark, sf_dir).groupBy("user_id").pivot("provider", ["email", "phone", "wechat"]).agg(F.max_by("uid", "ord"))
    c = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return c.join(wide, "user_id", "left")


def j06_change_diff(spark, sf_dir):
    c = views.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    new = c.withColumns({"c_mktsegment": F.when(F.col("c_custkey") % 3 == 0, "NEW").otherwise(F.col("c_mktsegment")), "c_nationkey": F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey"))})
    d = change_diff(c, new, "c_custkey", ["c_name", "c_mktsegment", "c_nationkey"])
    return d.select("c_custkey", F.array_join(F.array_sort(F.transform(F.map_entries("details"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["from"], F.lit("-")), F.lit(">"), F.coalesce(e["value"]["to"], F.lit("-"))))), ";").alias("details"))


def j07_settings(spark, sf_dir):
    """Typed defaults by part, overridden by texts of other parts."""
    p = views.table(spark, sf_dir, "part")
    kinds = F.element_at(F.array(*map(F.lit, ("int", "float", "bool", "str"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    reg = p.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), kinds.alias("type"), F.lit("d").alias("default_value"))
    raw = F.when(F.col("p_partkey") % 3 == 0, "12").when(F.col("p_partkey") % 3 == 1, " yes ").otherwise(F.lit(None).cast("string"))
    return effective_settings(reg, p.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), raw.alias("value")))


def j08_challenges(spark, sf_dir):
    """One-time codes from orders: state at the end of 1997."""
    o = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("expires_at"), (F.col("event_id") % 7).alias("tries"))
    now = o.agg(F.max("created_at").alias("now"))
    state = challenge_state(o.crossJoin(F.broadcast(now)), F.col("now"))
    return state.select("key", "id", "state", "may_resend")


def j10_identities(spark, sf_dir):
    """Provider ids held by more than one user, and how many of their holders have no other way in."""
    i = _identities(spark, sf_dir).withColumn("methods", F.count("*").over(Window.partitionBy("user_id")))
    return i.groupBy("provider", "uid").agg(F.count("*").alias("n"), F.count_if(F.col("methods") == 1).alias("only_method")).filter("n > 1")


def j11_reindexable(spark, sf_dir):
    """The latest ready or failed document of each source."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", "source", F.element_at(F.array(*map(F.lit, ("ready", "failed", "pending", "parsing"))), (F.col("doc_id") % 11 % 4 + 1).cast("int")).alias("status"))
    w = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    return d.filter("status in ('ready', 'failed')").withColumn("n", F.row_number().over(w)).filter("n = 1").select("source", "doc_id", "status")


def f07_queryable_scope(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.filter((F.col("doc_id") % 11 % 4 == 0) & (F.col("doc_id") % 7 != 0)).select("doc_id", "lang")


def f08_audit_search(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders")
    hay = F.lower(F.concat_ws(" ", F.col("o_orderkey").cast("string"), "o_orderstatus", "o_orderpriority"))
    return o.filter(F.contains(hay, F.lit("1-urg")) | F.contains(hay, F.lit("77"))).select("o_orderkey")


def h24_document_page(spark, sf_dir):
    """The third page of twenty documents, newest first."""
    return views.table(spark, sf_dir, "documents").orderBy(F.desc("doc_id")).offset(40).limit(20).select("doc_id", "source")


def _requests(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(F.col("event_type").alias("route"), F.when(F.col("event_id") % 9 == 0, "500").otherwise("200").alias("status"), F.round(F.col("value") % 12, 2).alias("duration"), "ts", "user_id", "event_id")


def k01_request_counts(spark, sf_dir):
    return _requests(spark, sf_dir).groupBy("route", "status").agg(F.count("*").alias("n"))


def k02_histogram(spark, sf_dir):
    return histogram(_requests(spark, sf_dir), ["route"]).withColumn("total", F.round("total", 2))


def in_progress(steps: DataFrame, key: str, span: str = "10 minutes") -> DataFrame:
    """K3. key, at, d (1: start, -1: end), event_id -> the most that were open at once, and the sum of what was open after each
    step. Running sums stay within spans of time; only one row a span is put in order for a key, so that a key with most of the rows is
    not one task."""
    w = Window.partitionBy(key, "span").orderBy("at", "d", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    opened = steps.withColumn("span", F.window("at", span)["start"]).withColumn("open", F.sum("d").over(w))
    spans = opened.groupBy(key, "span").agg(F.count("*").alias("n"), F.sum("d").alias("net"), F.max("open").alias("most"), F.sum("open").alias("sum_open"))
    before = F.coalesce(F.sum("net").over(Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spans.withColumn("before", before).groupBy(key).agg(F.max(F.col("before") + F.col("most")).alias("most"), F.sum(F.col("before") * F.col("n") + F.col("sum_open")).alias("sum_open"))


def k03_in_progress(spark, sf_dir):
    """Open requests after each start or end, by route."""
    r = _requests(spark, sf_dir)
    steps = r.select("route", "event_id", F.col("ts").alias("at"), F.lit(1).alias("d")).unionByName(r.select("route", "event_id", (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("at"), F.lit(-1).alias("d")))
    return in_progress(steps, "route")


def k04_tasks(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("event_type").alias("task"), views.int_div(F.col("event_id"), 2).alias("task_id"), F.when(F.col("event_id") % 2 == 0, "start").otherwise("end").alias("kind"), F.col("ts").alias("at"), F.when(F.col("event_id") % 5 == 0, "FAILURE").otherwise("SUCCESS").alias("state"))
    return paired_tasks(e)


def k05_stages(spark, sf_dir):
    return _requests(spark, sf_dir).groupBy(F.substring("route", 1, 1).alias("component"), F.col("route").alias("stage")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "500").alias("failures"), F.round(F.sum("duration"), 2).alias("seconds"))


def k06_correlation(spark, sf_dir):
    """Requests and tasks with the same valid request id."""
    e = _events(spark, sf_dir).withColumn("rid", F.when(F.col("event_id") % 6 == 0, "bad id!").otherwise(F.concat(F.lit("r-"), views.int_div(F.col("event_id"), 3).cast("string"))))
    valid = e.withColumn("rid", F.when(F.col("rid").rlike(r"^[A-Za-z0-9._-]{1,64}$"), F.col("rid"))).filter("rid is not null")
    a, b = valid.filter("event_id % 2 = 0").select("rid", F.col("event_id").alias("request")), valid.filter("event_id % 2 = 1").select("rid", F.col("event_id").alias("task"))
    return a.join(b, "rid")


QUERIES = {f.__name__: f for f in (
    i01_evidence_key, i02_accumulate, i03_prioritise, i04_units, i05_quota, i06_cached_calls, i08_fold_events, i09_run_summary, x7_run_audit, j01_history, j02_prompt_history, j04_audit_log, j05_user_columns,
    j06_change_diff, j07_settings, j08_challenges, j10_identities, j11_reindexable, f07_queryable_scope, f08_audit_search, h24_document_page, k01_request_counts, k02_histogram, k03_in_progress, k04_tasks, k05_stages, k06_correlation,
)}

_LOG = "WITH lg AS (SELECT user_id AS run, ((ord - 1) // 3)::INT AS step, ord, event_type AS action, event_id % 4 AS units, event_type || ':' || (event_id % 5) AS key, event_id % 100 AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ord FROM events))"
_EV = _LOG + """, hit AS (SELECT run, step, ord AS call, r AS rank, CASE WHEN chunk % 4 <> 0 THEN ((chunk + r) % 40)::VARCHAR ELSE (chunk % 10) || ':' || r || ':' END AS key FROM lg, (SELECT unnest([0, 1, 2]) AS r)),
  ev AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step, call, rank) - 1 AS ord FROM (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY step, call, rank) = 1))"""
_GRANT = "SELECT *, (least(6, t) - least(6, t - units))::BIGINT AS granted FROM (SELECT *, sum(units) OVER (PARTITION BY run ORDER BY ord) AS t FROM {0})"
_PLACED = "SELECT run, key, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN ord % 5 = 3 AND ord < 50 THEN 100 - ord ELSE 1000 END, ord) - 1 AS place FROM ev"
_MSG = "SELECT session_id, conv_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY created_at, turn) AS pos FROM (SELECT * FROM (SELECT (conv_id // 4)::INT AS session_id, conv_id, turn, conv_id * 100 + turn AS created_at FROM conversations) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, turn DESC) <= {0})"
_IDS = "SELECT c_custkey AS user_id, p AS provider, p || ':' || (c_custkey % 700) AS uid FROM customer, (SELECT unnest(['email', 'phone', 'wechat']) AS p) WHERE (p = 'email' AND c_custkey % 2 = 0) OR (p = 'phone' AND c_custkey % 3 = 0) OR (p = 'wechat' AND c_custkey % 5 = 0)"
_REQ = "(SELECT event_type AS route, CASE WHEN event_id % 9 = 0 THEN '500' ELSE '200' END AS status, round(value % 12, 2) AS duration, ts, event_id FROM events)"

ORACLES = {
    "i01_evidence_key": _EV + " SELECT key, count(*) AS n FROM hit GROUP BY key",
    "i02_accumulate": _EV + " SELECT run, key, step, ord FROM ev",
    "i03_prioritise": _EV + " " + _PLACED,
    "i04_units": _LOG + " SELECT action, sum(units)::BIGINT AS units, count(*) AS calls FROM lg GROUP BY action",
    "i05_quota": _LOG + f" SELECT run, ord, units, granted FROM ({_GRANT.format('lg')})",
    "i06_cached_calls": _LOG + " SELECT run, ord, min(step) OVER (PARTITION BY run, key) AS first_step, step > min(step) OVER (PARTITION BY run, key) AS cached FROM lg",
    "i08_fold_events": _LOG + " SELECT run, step, arg_max(action, ord) FILTER (units <> 3) AS status, string_agg(key || ' ', '' ORDER BY ord) AS thought, count(*) AS n_events FROM lg GROUP BY run, step",
    "i09_run_summary": _EV + f", g AS (SELECT run, max(step) AS steps, sum(granted)::BIGINT AS units FROM ({_GRANT.format('lg')}) GROUP BY run) SELECT run, steps, units, evidence FROM g JOIN (SELECT run, count(*) AS evidence FROM ev GROUP BY run) USING (run)",
    "x7_run_audit": _EV + f""", c AS (SELECT * REPLACE (CASE WHEN cached THEN 0 ELSE units END AS units) FROM (SELECT *, step > min(step) OVER (PARTITION BY run, key) AS cached FROM lg)),
      s AS (SELECT run, sum(granted)::BIGINT AS units, count(*) FILTER (cached) AS cached FROM ({_GRANT.format('c')}) GROUP BY run), p AS ({_PLACED}) SELECT run, units, cached, top FROM s JOIN (SELECT run, string_agg(key, '|' ORDER BY place) AS top FROM p WHERE place < 3 GROUP BY run) USING (run)""",
    "j01_history": _MSG.format(12),
    "j02_prompt_history": _MSG.format(6),
    "j04_audit_log": "SELECT o_orderkey, a.c_name AS actor, t.c_name AS target FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) o LEFT JOIN customer a ON o.o_custkey = a.c_custkey LEFT JOIN customer t ON o.o_orderkey % 4 <> 0 AND t.c_custkey = o.o_custkey + 1",
    "j05_user_columns": f"SELECT c_custkey AS user_id, c_name, max(uid) FILTER (provider = 'email') AS email, max(uid) FILTER (provider = 'phone') AS phone, max(uid) FILTER (provider = 'wechat') AS wechat FROM customer LEFT JOIN ({_IDS}) ON user_id = c_custkey GROUP BY ALL",
    "j06_change_diff": "SELECT c_custkey, concat_ws(';', CASE WHEN c_custkey % 3 = 0 AND c_mktsegment IS DISTINCT FROM 'NEW' THEN 'c_mktsegment=' || coalesce(c_mktsegment, '-') || '>NEW' END, CASE WHEN c_custkey % 7 = 0 AND c_nationkey IS NOT NULL THEN 'c_nationkey=' || c_nationkey || '>-' END) AS details FROM customer WHERE (c_custkey % 3 = 0 AND c_mktsegment IS DISTINCT FROM 'NEW') OR (c_custkey % 7 = 0 AND c_nationkey IS NOT NULL)",
    "j07_settings": "SELECT 'k' || p_partkey AS key, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 4 = 2 THEN 'd' ELSE '12' END WHEN 1 THEN CASE WHEN p_partkey % 4 < 2 THEN 'd' ELSE 'yes' END ELSE 'd' END AS value, (p_partkey % 3 = 0 AND p_partkey % 4 = 2) OR (p_partkey % 3 = 1 AND p_partkey % 4 < 2) AS error FROM part",
    "j08_challenges": "SELECT user_id AS key, event_id AS id, CASE WHEN ts + INTERVAL 5 DAYS <= m THEN 'expired' WHEN event_id % 7 >= 5 THEN 'exhausted' ELSE 'live' END AS state, ts + INTERVAL 60 SECONDS <= m AS may_resend FROM (SELECT *, max(ts) OVER () AS m FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "j10_identities": f"SELECT provider, uid, count(*) AS n, count(*) FILTER (methods = 1) AS only_method FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS methods FROM ({_IDS})) GROUP BY provider, uid HAVING count(*) > 1",
    "j11_reindexable": "SELECT source, doc_id, (['ready', 'failed'])[doc_id % 11 % 4 + 1] AS status FROM documents WHERE doc_id % 11 % 4 < 2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) = 1",
    "f07_queryable_scope": "SELECT doc_id, lang FROM documents WHERE doc_id % 11 % 4 = 0 AND doc_id % 7 <> 0",
    "f08_audit_search": "SELECT o_orderkey FROM orders WHERE contains(lower(concat_ws(' ', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority)), '1-urg') OR contains(lower(concat_ws(' ', o_orderkey::VARCHAR, o_orderstatus, o_orderpriority)), '77')",
    "h24_document_page": "SELECT doc_id, source FROM documents ORDER BY doc_id DESC LIMIT 20 OFFSET 40",
    "k01_request_counts": f"SELECT route, status, count(*) AS n FROM {_REQ} GROUP BY ALL",
    "k02_histogram": f"SELECT route, {', '.join(f'count(*) FILTER (duration <= {e}) AS le_' + str(e).replace('.', '_') for e in EDGES)}, count(duration) AS n, round(sum(duration), 2) AS total FROM {_REQ} GROUP BY route",
    "k03_in_progress": f"SELECT route, max(o)::BIGINT AS most, sum(o)::BIGINT AS sum_open FROM (SELECT route, sum(d) OVER (PARTITION BY route ORDER BY tt, d, event_id ROWS UNBOUNDED PRECEDING) AS o FROM (SELECT route, event_id, ts AS tt, 1 AS d FROM {_REQ} UNION ALL SELECT route, event_id, ts + INTERVAL 2 HOURS, -1 FROM {_REQ})) GROUP BY route",
    "k04_tasks": "WITH o AS (SELECT event_type AS task, (event_id // 2)::INT AS task_id, max(ts) FILTER (event_id % 2 = 0) AS s, max(ts) FILTER (event_id % 2 = 1) AS e, max(CASE WHEN event_id % 5 = 0 THEN 'FAILURE' ELSE 'SUCCESS' END) FILTER (event_id % 2 = 1) AS state FROM events GROUP BY ALL) SELECT task, state, count(*) AS n, count(s) AS n_timed, sum(epoch(date_trunc('second', e)) - epoch(date_trunc('second', s)))::BIGINT AS seconds FROM o WHERE e IS NOT NULL GROUP BY task, state",
    "k05_stages": f"SELECT substr(route, 1, 1) AS component, route AS stage, count(*) AS n, count(*) FILTER (status = '500') AS failures, round(sum(duration), 2) AS seconds FROM {_REQ} GROUP BY ALL",
    "k06_correlation": "WITH v AS (SELECT *, 'r-' || (event_id // 3) AS rid FROM events WHERE event_id % 6 <> 0) SELECT a.rid, a.event_id AS request, b.event_id AS task FROM v a JOIN v b USING (rid) WHERE a.event_id % 2 = 0 AND b.event_id % 2 = 1",
}
