"""Runs, artifacts and traces over all events."""

import uuid

from pyspark.sql import functions as F

from scholarmatch.operators import runs as ops
from scholarmatch.plans.tables import load
from scholarmatch.sources import tables as stored_tables
from scholarmatch.sources.tables import scratch_path

TOOLS = ("search_by_author", "search_by_title", "fetch_professor_homepage", "other_tool")
LIMITS = {
    "MAX_STEPS": 9, "MAX_LLM_CALLS": 12, "MAX_TOKENS": 1500, "MAX_EXTERNAL_CALLS": 22, "SOURCE_RATE_LIMIT": 7, "MAX_WALL_TIME": 500_000,
}
CAPS = {"search_by_author": 4, "other_tool": 2}
INTERVALS = {"src0": 3000.0, "src1": 600.0, "src2": 120.0}
NOW = "2024-02-01 00:00:00"


def _uuid(c):
    h = F.md5(c.cast("string"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def _k():
    return F.get_json_object("props", "$.k").cast("int")


def _runs(spark, sf):
    e = load(spark, sf, "events")
    return e.groupBy(F.col("user_id")).agg(F.min("ts").alias("created_at"), F.count_if(F.col("event_type") == "purchase").alias("n")).select(
        F.col("user_id").cast("string").alias("run_id"),
        F.when(F.col("n") % 4 == 0, "STARTED").otherwise("COMPLETED").alias("status"),
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("run "), F.col("user_id").cast("string"))).alias("name"),
        "created_at",
    )


def _artifacts(spark, sf):
    e = load(spark, sf, "events")
    return e.select(
        F.concat_ws(":", "user_id", "event_type", _k() % 5).alias("id"),
        F.col("user_id").cast("string").alias("run_id"),
        F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 50 == 0, F.lit("{bad")).otherwise(F.col("props")).alias("payload"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("seq"),
    )


def latest_artifact(spark, sf):
    return ops.latest_artifact(_artifacts(spark, sf))


def run_views(spark, sf):
    return ops.run_views(_artifacts(spark, sf), ("view", "click", "signup"), ("purchase",))


def runs_by_json_field(spark, sf):
    return ops.runs_by_json_field(_artifacts(spark, sf), "view", "k", 7)


def visible_runs(spark, sf):
    mine = load(spark, sf, "events").where("event_type = 'signup' AND value > 100").select(F.col("user_id").cast("string").alias("run_id")).distinct()
    return ops.visible_runs(_runs(spark, sf), runs_by_json_field(spark, sf), mine)


def _rich_artifacts(spark, sf):
    """Profile, match and analysis documents made from the event columns."""
    e = load(spark, sf, "events")
    k = _k()
    s = k.cast("string")
    profile = F.to_json(
        F.struct(
            F.concat(F.lit("prof"), s).alias("professor_id"),
            F.struct(F.when(k % 4 != 0, F.concat(F.lit("Name "), (k % 10).cast("string"))).alias("value")).alias("name"),
            F.struct(F.when(k % 6 != 0, F.concat(F.lit("Uni "), (k % 3).cast("string"))).alias("value")).alias("institution"),
            F.struct(F.when(k % 2 == 0, F.lit("Dept")).alias("value")).alias("department"),
        )
    )
    fit = F.element_at(F.array(*[F.lit(x) for x in ("STRONG", "PARTIAL", "WEAK", "UNKNOWN", "ODD")]), k % 5 + 1)
    advice = F.element_at(F.array(*[F.lit(x) for x in ("WORTH_CONTACTING", "LEARN_MORE", "LOW_PRIORITY", "INSUFFICIENT_EVIDENCE")]), k % 4 + 1)
    topic = F.struct(F.lit("research_topic").alias("key"), F.concat(F.lit("学生「a"), s, F.lit("」与导师研究「b」形成交集")).alias("summary"))
    other = F.struct(F.lit("skill").alias("key"), F.lit("已确认技能").alias("summary"))
    match = F.to_json(
        F.struct(
            fit.alias("research_fit"), advice.alias("recommendation"),
            F.when(k % 3 == 0, "HIGH").when(k % 3 == 1, "MEDIUM").otherwise("LOW").alias("evidence_sufficiency"),
            F.when(k % 2 == 0, F.array(other, topic)).otherwise(F.array(other)).alias("dimensions"),
            F.when(k % 3 == 0, F.array(F.lit("g1"), F.lit("g2"), F.lit("g3"))).otherwise(F.array().cast("array<string>")).alias("gaps"),
        )
    )

    def point(t):
        return F.struct(t.alias("text"))

    none = F.array().cast("array<struct<text:string>>")
    analysis = F.to_json(
        F.struct(
            F.when(k % 2 == 0, F.array(point(F.concat(F.lit("i"), s)))).otherwise(none).alias("research_intersection"),
            F.when(k % 3 == 0, F.array(point(F.lit("m1")), point(F.lit("m2")))).otherwise(none).alias("method_match"),
            F.when(k % 5 == 0, F.array(point(F.lit("b1")))).otherwise(none).alias("background_gaps"),
        )
    )
    kind = F.when(F.col("event_type") == "view", "professor_profile").when(F.col("event_type") == "click", "match").when(
        F.col("event_type") == "purchase", "deep_analysis"
    )
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.col("user_id").cast("string").alias("run_id"),
        kind.alias("kind"),
        F.when(F.col("event_type") == "view", profile).when(F.col("event_type") == "click", match).otherwise(analysis).alias("payload"),
        F.col("ts").alias("created_at"),
        F.col("event_id").alias("seq"),
    ).where("kind IS NOT NULL")


def run_comparison(spark, sf):
    return ops.run_comparison(_runs(spark, sf), _rich_artifacts(spark, sf))


def archive_page(spark, sf):
    rows = ops.archive_filter(run_comparison(spark, sf), query="UNI 1")
    return ops.archive_page(rows, page=2, size=9).select("run_id", "record", "school")


def archive_facets(spark, sf):
    return ops.archive_facets(run_comparison(spark, sf), "Uni 1")


def duplicate_archive(spark, sf):
    return ops.duplicate_archive(run_comparison(spark, sf))


def _files(spark, sf):
    e = load(spark, sf, "events")
    u = F.when(F.col("event_id") % 3 == 0, _uuid(F.col("event_id"))).otherwise(_uuid(F.col("user_id")))
    return e.select(
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("note"), F.col("event_id").cast("string"), F.lit(".pdf")))
        .otherwise(F.concat(u, F.when(F.col("event_id") % 2 == 0, F.lit(".PDF")).otherwise(F.lit(".pdf"))))
        .alias("file"),
        F.floor(F.col("value") * 100).alias("size"),
        F.col("ts").alias("modified_at"),
    )


def _uuid_runs(spark, sf):
    return load(spark, sf, "events").where("event_type = 'purchase' AND value > 90").select(_uuid(F.col("user_id")).alias("run_id")).distinct()


def retention_audit(spark, sf):
    return ops.retention_audit(_files(spark, sf), _uuid_runs(spark, sf), NOW, 10)


def retention_totals(spark, sf):
    return ops.retention_totals(retention_audit(spark, sf))


def steps_of(e):
    """Trace steps from the events table, at rest or as a stream."""
    k = _k()
    kind = (
        F.when(F.col("event_type") == "view", "llm_decision").when(F.col("event_type").isin("click", "purchase"), "tool_call")
        .when(F.col("event_type") == "signup", "confirmation").otherwise("error")
    )
    return e.select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("idx"),
        kind.alias("kind"),
        F.element_at(F.array(*[F.lit(t) for t in TOOLS]), k % 4 + 1).alias("name"),
        F.when(k % 9 == 0, "error").when(k % 10 == 1, "skipped").otherwise("ok").alias("status"),
        F.floor("value").alias("duration_ms"),
        k.cast("long").alias("tokens_in"),
        (k * 2).cast("long").alias("tokens_out"),
        F.concat(F.lit("src"), (k % 6).cast("string")).alias("source"),
        "ts",
        F.when(k % 5 != 0, F.element_at(F.array(F.lit("seeding"), F.lit("searching"), F.lit("done")), k % 3 + 1)).alias("stage"),
        F.when(k % 2 == 0, F.concat(F.lit("count="), k.cast("string"))).otherwise("").alias("summary"),
        F.when(k % 2 == 1, F.lit("timeout")).alias("error"),
    )


def _steps(spark, sf):
    return steps_of(load(spark, sf, "events"))


def trace_rollup(spark, sf):
    return ops.trace_rollup(_steps(spark, sf))


def trace_user_steps(spark, sf):
    return ops.trace_user_steps(_steps(spark, sf))


def budget_breach(spark, sf):
    return ops.budget_breach(_steps(spark, sf), LIMITS)


def call_caps(spark, sf):
    found = ops.call_caps(_steps(spark, sf), CAPS, INTERVALS)
    return found.withColumn("wait_s", F.round("wait_s", 3)).withColumn("start_at", F.col("start_at").cast("timestamp_ntz"))


def source_health(spark, sf):
    e = load(spark, sf, "events")
    per = e.groupBy("user_id", (_k() % 8).alias("pos")).agg(F.max_by("event_type", "event_id").alias("t"), F.count("*").alias("c"))
    status = (
        F.when(F.col("t") == "view", "ok").when(F.col("t") == "click", "empty").when(F.col("t") == "purchase", "blocked")
        .when(F.col("t") == "error", "error").otherwise("no_key")
    )
    outcomes = per.select(
        F.col("user_id").alias("run_id"), "pos", F.concat(F.lit("S"), F.col("pos").cast("string")).alias("label"), status.alias("status"),
        F.when(F.col("t") == "view", F.col("c")).otherwise(0).alias("n"),
        F.when(F.col("pos") % 2 == 0, F.lit("r")).otherwise("").alias("reason"), (F.col("c") * 0.01).alias("cost"),
    )
    return ops.source_health(outcomes)


def stage_chain(spark, sf):
    return ops.stage_chain(_steps(spark, sf))


_GONE = str(uuid.UUID("c9f0f895-fb98-ab91-59f5-1fd0297e236d"))  # the UUID of user 8


def delete_run(spark, sf):
    e = load(spark, sf, "events")
    runs = e.select(_uuid(F.col("user_id")).alias("run_id")).distinct()
    arts = e.select(_uuid(F.col("user_id")).alias("run_id"), "event_id")
    kept_runs, kept = ops.delete_run(runs, arts, _GONE)
    return kept.join(kept_runs, "run_id", "left_semi")


def stored_delete_run(spark, sf):
    """The stored artifacts after one run was deleted from them."""
    path = scratch_path(spark, "artifacts")
    owned = _artifacts(spark, sf).withColumn("run_id", _uuid(F.col("run_id").cast("long")))
    stored_tables.write_table(owned, path, "artifacts")
    stored_tables.edit_table(spark, path, "artifacts", lambda rows: ops.delete_run(rows.select("run_id"), rows, _GONE)[1])
    return stored_tables.read_table(spark, path, "artifacts").select("run_id", "seq", "kind", "payload")


_NAMES = (
    "latest_artifact run_views runs_by_json_field visible_runs run_comparison archive_page archive_facets duplicate_archive retention_audit "
    "retention_totals trace_rollup trace_user_steps budget_breach call_caps source_health stage_chain delete_run stored_delete_run"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_EV = "ev AS (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)"
_RUNS = """
rn AS (SELECT user_id, user_id::VARCHAR AS run_id, CASE WHEN count(*) FILTER (event_type = 'purchase') % 4 = 0 THEN 'STARTED' ELSE 'COMPLETED' END AS status,
       CASE WHEN user_id % 5 = 0 THEN 'run ' || user_id END AS name, min(ts) AS created_at FROM events GROUP BY user_id)"""
_ART = """
art AS (SELECT user_id || ':' || event_type || ':' || (k % 5) AS id, user_id::VARCHAR AS run_id, event_type AS kind,
        CASE WHEN event_id % 50 = 0 THEN '{bad' ELSE props END AS payload, ts, event_id, k FROM ev),
cur AS (SELECT * FROM art QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, event_id DESC) = 1)"""
_CMP = """
lp AS (SELECT user_id, arg_max(k, (ts, event_id)) AS k FROM ev WHERE event_type = 'view' GROUP BY 1),
lm AS (SELECT user_id, arg_max(k, (ts, event_id)) AS k FROM ev WHERE event_type = 'click' GROUP BY 1),
ld AS (SELECT user_id, arg_max(k, (ts, event_id)) AS k FROM ev WHERE event_type = 'purchase' GROUP BY 1),
c0 AS (
  SELECT rn.run_id, rn.name, rn.created_at, CASE WHEN lp.k % 4 <> 0 THEN 'Name ' || (lp.k % 10) ELSE 'prof' || lp.k END AS professor,
         CASE WHEN lp.k % 6 <> 0 THEN 'Uni ' || (lp.k % 3) ELSE '学校未核实' END AS school, CASE WHEN lp.k % 2 = 0 THEN 'Dept' ELSE '学院未核实' END AS college, lm.k AS mk, ld.k AS dk
  FROM rn JOIN lp USING (user_id) JOIN lm USING (user_id) LEFT JOIN ld USING (user_id) WHERE status = 'COMPLETED'
),
cmp AS (
  SELECT run_id, coalesce(name, professor || ' · ' || school || ' · ' || college) AS record, professor, school, college,
         ['强交集', '部分交集', '交集较少', '证据不足', '证据不足'][mk % 5 + 1] AS fit, ['值得进一步联系', '先补充了解', '当前优先级较低', '暂无法建议'][mk % 4 + 1] AS advice,
         ['较充分', '一般', '不足'][mk % 3 + 1] AS sufficiency,
         CASE WHEN dk % 2 = 0 AND dk % 3 = 0 THEN 'i' || dk || '；m1；m2' WHEN dk % 2 = 0 THEN 'i' || dk WHEN dk % 3 = 0 THEN 'm1；m2'
              WHEN mk % 2 = 0 THEN '学生「a' || mk || '」与导师研究「b」形成交集' ELSE '旧记录暂无个性化分析；重新研究后可补齐' END AS overlap,
         CASE WHEN dk % 5 = 0 THEN 'b1' WHEN mk % 3 = 0 THEN 'g1；g2；g3' ELSE '暂无已核实的缺口结论' END AS to_add, created_at FROM c0
)"""
_UU = "(left(md5({0}::VARCHAR), 8) || '-' || substr(md5({0}::VARCHAR), 9, 4) || '-' || substr(md5({0}::VARCHAR), 13, 4) || '-' || substr(md5({0}::VARCHAR), 17, 4) || '-' || substr(md5({0}::VARCHAR), 21, 12))"
_RET = f"""
fl AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN {_UU.format('event_id')} ELSE {_UU.format('user_id')} END AS u, event_id % 2 = 0 AS upper_case, floor(value * 100)::BIGINT AS size, ts FROM events),
kn AS (SELECT DISTINCT {_UU.format('user_id')} AS u FROM events WHERE event_type = 'purchase' AND value > 90),
au AS (SELECT u || CASE WHEN upper_case THEN '.PDF' ELSE '.pdf' END AS file, size, CASE WHEN u IN (SELECT u FROM kn) THEN 'referenced' ELSE 'orphan' END AS state,
       u NOT IN (SELECT u FROM kn) AND epoch(TIMESTAMP '{NOW}' - ts) / 86400.0 >= 10 AS expired FROM fl WHERE u IS NOT NULL)"""
_ST = """
st AS (
  SELECT user_id AS run_id, event_id AS idx, CASE WHEN event_type = 'view' THEN 'llm_decision' WHEN event_type IN ('click', 'purchase') THEN 'tool_call' WHEN event_type = 'signup' THEN 'confirmation' ELSE 'error' END AS kind,
         ['search_by_author', 'search_by_title', 'fetch_professor_homepage', 'other_tool'][k % 4 + 1] AS name, CASE WHEN k % 9 = 0 THEN 'error' WHEN k % 10 = 1 THEN 'skipped' ELSE 'ok' END AS status,
         floor(value)::BIGINT AS duration_ms, k, 'src' || (k % 6) AS source, ts, CASE WHEN k % 5 <> 0 THEN ['seeding', 'searching', 'done'][k % 3 + 1] END AS stage FROM ev
)"""
ORACLES = {
    "latest_artifact": f"WITH {_EV}, {_ART} SELECT run_id, kind, arg_max(payload, (ts, event_id)) AS payload FROM cur GROUP BY ALL",
    "run_views": f"""WITH {_EV}, {_ART}, l AS (SELECT run_id, kind, arg_max(payload, (ts, event_id)) AS p FROM cur GROUP BY ALL),
w AS (SELECT run_id, max(p) FILTER (kind = 'view') AS view, max(p) FILTER (kind = 'click') AS click, max(p) FILTER (kind = 'signup') AS signup, max(p) FILTER (kind = 'purchase') AS purchase FROM l GROUP BY 1)
SELECT * FROM w WHERE view IS NOT NULL AND click IS NOT NULL AND signup IS NOT NULL""",
    "runs_by_json_field": f"WITH {_EV}, {_ART} SELECT DISTINCT run_id FROM cur WHERE kind = 'view' AND k = 7 AND payload <> '{{bad'",
    "visible_runs": f"""WITH {_EV}, {_ART}, {_RUNS}, ok AS (SELECT run_id FROM cur WHERE kind = 'view' AND k = 7 AND payload <> '{{bad' UNION SELECT user_id::VARCHAR FROM events WHERE event_type = 'signup' AND value > 100)
SELECT run_id, status, name, created_at FROM rn WHERE run_id IN (SELECT run_id FROM ok)""",
    "run_comparison": f"WITH {_EV}, {_RUNS}, {_CMP} SELECT * FROM cmp",
    "archive_page": f"""WITH {_EV}, {_RUNS}, {_CMP} SELECT run_id, record, school FROM cmp WHERE contains(lower(record || ' ' || professor || ' ' || school || ' ' || college), 'uni 1')
ORDER BY created_at DESC, run_id LIMIT 9 OFFSET 9""",
    "archive_facets": f"""WITH {_EV}, {_RUNS}, {_CMP} SELECT DISTINCT 'school' AS facet, school AS value FROM cmp WHERE school <> '学校未核实'
UNION SELECT 'college', college FROM cmp WHERE school = 'Uni 1' AND college <> '学院未核实'""",
    "duplicate_archive": f"""WITH {_EV}, {_RUNS}, {_CMP}
SELECT a.run_id, arg_max(b.run_id, (b.created_at, -b.run_id::BIGINT)) AS duplicate_of FROM cmp a JOIN cmp b ON a.professor = b.professor AND a.school = b.school AND a.college = b.college AND a.run_id <> b.run_id GROUP BY a.run_id""",
    "retention_audit": f"WITH {_RET} SELECT * FROM au",
    "retention_totals": f"""WITH {_RET} SELECT count(*) AS files, sum(size) AS bytes, count(*) FILTER (state = 'referenced') AS referenced, count(*) FILTER (state = 'orphan') AS orphans,
sum(size) FILTER (state = 'orphan') AS orphan_bytes, count(*) FILTER (expired) AS expired FROM au""",
    "trace_rollup": f"""WITH {_EV}, {_ST} SELECT run_id, count(*) AS steps, count(*) FILTER (kind = 'tool_call') AS tool_calls, count(*) FILTER (kind = 'tool_call') AS external_calls,
sum(k * 3) AS tokens, sum(duration_ms) AS duration_ms, count(*) FILTER (status = 'error') AS errors FROM st GROUP BY run_id""",
    "trace_user_steps": f"""WITH {_EV}, {_ST} SELECT run_id, idx, CASE name WHEN 'search_by_author' THEN '按导师姓名检索论文' WHEN 'search_by_title' THEN '按论文标题补充检索' WHEN 'fetch_professor_homepage' THEN '读取导师公开主页' ELSE '执行补充检索' END AS label,
CASE status WHEN 'ok' THEN '已完成' WHEN 'error' THEN '未成功' ELSE '已跳过' END AS status, CASE WHEN k % 2 = 0 THEN 'count=' || k ELSE 'timeout' END AS detail FROM st WHERE kind = 'tool_call'""",
    "budget_breach": f"""WITH {_EV}, {_ST},
cu AS (SELECT run_id, idx, sum((kind = 'llm_decision')::INT) OVER w AS d, sum(CASE WHEN kind = 'llm_decision' THEN k * 3 ELSE 0 END) OVER w AS t, sum((kind = 'tool_call')::INT) OVER w AS x,
       CASE WHEN kind = 'tool_call' THEN sum((kind = 'tool_call')::INT) OVER (PARTITION BY run_id, source ORDER BY idx) ELSE 0 END AS s, source, epoch(ts - min(ts) OVER (PARTITION BY run_id)) AS el
       FROM st WINDOW w AS (PARTITION BY run_id ORDER BY idx)),
rs AS (SELECT run_id, idx, CASE WHEN d >= 9 THEN 'MAX_STEPS' WHEN d >= 12 THEN 'MAX_LLM_CALLS' WHEN t >= 1500 THEN 'MAX_TOKENS' WHEN x >= 22 THEN 'MAX_EXTERNAL_CALLS'
         WHEN s >= 7 THEN 'SOURCE_RATE_LIMIT:' || source WHEN el >= 500000 THEN 'MAX_WALL_TIME' END AS reason FROM cu)
SELECT run_id, arg_min(reason, idx) AS reason, min(idx) AS at_idx FROM rs WHERE reason IS NOT NULL GROUP BY run_id""",
    "call_caps": f"""WITH {_EV}, {_ST},
c AS (SELECT *, row_number() OVER (PARTITION BY run_id, name ORDER BY idx) > CASE name WHEN 'search_by_author' THEN 4 WHEN 'other_tool' THEN 2 ELSE 1000000 END AS skipped,
        CASE source WHEN 'src0' THEN 3000000000 WHEN 'src1' THEN 600000000 WHEN 'src2' THEN 120000000 ELSE 0 END AS gap FROM st WHERE kind = 'tool_call'),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, run_id, idx) AS i FROM c WHERE NOT skipped),
s AS (SELECT run_id, idx, i * gap + max(epoch_us(ts) - i * gap) OVER (PARTITION BY source ORDER BY i) AS us FROM p)
SELECT c.run_id, c.idx, name, source, skipped, round(coalesce((us - epoch_us(ts)) / 1000000.0, 0), 3) AS wait_s, make_timestamp(us) AS start_at FROM c LEFT JOIN s ON s.run_id = c.run_id AND s.idx = c.idx""",
    "source_health": f"""WITH {_EV}, p AS (SELECT user_id AS run_id, k % 8 AS pos, arg_max(event_type, event_id) AS t, count(*) AS c FROM ev GROUP BY ALL),
o AS (SELECT run_id, pos, 'S' || pos AS label, t, c, t IN ('purchase', 'error') AS bad, CASE WHEN pos % 2 = 0 THEN 'r' ELSE '' END AS reason FROM p),
f AS (SELECT run_id, string_agg(label, '、' ORDER BY pos) AS l FROM o WHERE bad GROUP BY 1),
s AS (SELECT run_id, count(*) AS total, count(*) FILTER (t IN ('view', 'click')) AS searched, count(*) FILTER (bad) AS failed, round(sum(c * 0.01::DOUBLE), 6) AS cost,
  string_agg(label || ' ' || c || ' 篇' || CASE WHEN reason <> '' THEN '（' || reason || '）' ELSE '' END, '、' ORDER BY pos) FILTER (t = 'view') AS u,
  string_agg(label || '（' || reason || '）', '、' ORDER BY pos) FILTER (bad) AS q FROM o GROUP BY 1)
SELECT run_id, total, searched, failed, coalesce(l, '') AS failed_labels, searched = 0 AND failed > 0 AS unavailable, cost,
       coalesce(u, '本次没有检索到论文') || CASE WHEN q IS NOT NULL THEN '；未返回：' || q ELSE '' END AS description FROM s LEFT JOIN f USING (run_id)""",
    "stage_chain": f"WITH {_EV}, {_ST}, c AS (SELECT *, lag(stage) OVER (PARTITION BY run_id ORDER BY idx) AS p FROM st WHERE stage IS NOT NULL) SELECT run_id, idx, stage FROM c WHERE p IS NULL OR p <> stage",
    "stored_delete_run": f"WITH {_EV}, {_ART} SELECT {_UU.format('r.u')} AS run_id, event_id AS seq, kind, payload FROM (SELECT *, run_id::BIGINT AS u FROM art) r WHERE u <> 8",
    "delete_run": f"SELECT {_UU.format('user_id')} AS run_id, event_id FROM events WHERE user_id <> 8",
}
