"""Provenance checks and evaluation over all events, conversations and documents."""

from pyspark.sql import functions as F

from scholarmatch.operators import evaluate, grounding
from scholarmatch.plans.tables import load

BANNED, PAPER, READ = ("thing", "éreau", "schein"), "tion", ("inor", "lich")


def _claims(spark, sf):
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.create_map(
        *[F.lit(x) for pair in {"signup": "recruiting", "purchase": "team_size", "view": "observed_research_trend", "click": "trend"}.items() for x in pair]
    )
    status = F.element_at(F.array(F.lit("SUPPORTED"), F.lit("SUPPORTED"), F.lit("INFERRED"), F.lit("UNKNOWN")), (F.col("event_id") % 4 + 1).cast("int"))
    ref = F.concat(F.lit("e"), k.cast("string"))
    return e.select(
        F.col("event_id").alias("claim_id"),
        F.coalesce(F.try_element_at(kind, F.col("event_type")), F.lit("generic")).alias("claim_type"),
        status.alias("status"),
        F.when(F.col("event_id") % 10 == 0, F.array(F.concat(F.lit("x"), k.cast("string"))))
        .when(F.col("event_id") % 5 == 0, F.array(ref))
        .otherwise(F.array(ref, F.concat(F.lit("e"), (k + 50).cast("string"))))
        .alias("evidence_ids"),
        (F.col("event_id") % 3 != 0).alias("expected_valid"),
    )


def _evidence(spark, sf):
    labels = load(spark, sf, "labels")
    return labels.select(
        F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("id"),
        F.when(F.col("quality") == 1, "CONFIRMED").otherwise("UNCERTAIN").alias("author_resolution_status"),
    )


def _errors(spark, sf):
    return grounding.validate_claims(_claims(spark, sf), _evidence(spark, sf))


def validate_claims(spark, sf):
    return _errors(spark, sf)


def surviving_claims(spark, sf):
    return grounding.surviving_claims(_claims(spark, sf), _errors(spark, sf)).select("claim_id", "claim_type", "status")


def _points(spark, sf):
    e = load(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    section = F.element_at(
        F.array(*[F.lit(s) for s in ("research_intersection", "method_match", "background_gaps", "recommended_papers", "knowledge_to_supplement")]),
        (F.col("event_id") % 5 + 1).cast("int"),
    )
    return e.select(
        F.col("event_id").alias("point_id"),
        section.alias("section"),
        F.when(F.col("event_id") % 13 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "event_type", F.lit(" "))).alias("text"),
        F.array(F.concat(F.lit("u"), (F.col("user_id") * 3).cast("string")), F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("fact_ids"),
        F.array(F.concat(F.lit("e"), k.cast("string")), F.concat(F.lit("e"), (k + 50).cast("string"))).alias("evidence_ids"),
    )


def _fact_ids(spark, sf):
    return load(spark, sf, "events").where("event_type = 'purchase' AND value > 60").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id")
    ).distinct()


def sanitize_points(spark, sf):
    out = grounding.sanitize_points(_points(spark, sf), _fact_ids(spark, sf), _evidence(spark, sf).select("id"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("fact_ids", "evidence_ids")})


def sanitize_summaries(spark, sf):
    s = _points(spark, sf).select(F.col("point_id").alias("summary_id"), F.col("text").alias("summary"), "evidence_ids")
    out = grounding.sanitize_summaries(s, _evidence(spark, sf).select("id"))
    return out.withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def _sentences(spark, sf):
    c = load(spark, sf, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    none = F.array().cast("array<string>")
    return c.select(
        conv.alias("draft_id"),
        turn.alias("idx"),
        "text",
        F.when(F.col("role") == "assistant", "PROFESSOR_FACT").when(F.col("role") == "user", "STUDENT_FACT").otherwise("GENERIC").alias("sentence_type"),
        F.when(turn % 3 == 0, none)
        .otherwise(F.array(F.concat_ws("-", F.lit("f"), conv, turn), F.concat_ws("-", F.lit("f"), conv, turn - 1)))
        .alias("fact_ids"),
        F.when(turn % 5 == 3, none)
        .otherwise(F.array(F.concat(F.lit("e"), conv.cast("string")), F.concat(F.lit("e"), (conv + turn).cast("string"))))
        .alias("evidence_ids"),
    )


def _confirmed(spark, sf):
    c = load(spark, sf, "conversations").where("turn % 4 <> 2")
    return c.select(F.concat_ws("-", F.lit("f"), "conv_id", "turn").alias("id")).distinct()


def _good_evidence(spark, sf):
    return _evidence(spark, sf).select("id").distinct()


def _draft_errors(spark, sf):
    return grounding.validate_draft(
        _sentences(spark, sf), _confirmed(spark, sf), _good_evidence(spark, sf), False, BANNED, PAPER, READ
    )


def validate_draft(spark, sf):
    return _draft_errors(spark, sf)


def draft_coverage(spark, sf):
    out = grounding.draft_coverage(_sentences(spark, sf), _confirmed(spark, sf), _good_evidence(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("professor_fact_coverage", "student_fact_coverage")})


def prune_draft(spark, sf):
    return grounding.prune_draft(_sentences(spark, sf), _draft_errors(spark, sf)).select("draft_id", "idx", "sentence_type")


def _scores(spark, sf, by=()):
    d = load(spark, sf, "documents")
    predictions = d.select(F.col("doc_id").alias("item_id"), (F.col("n_chars") >= 1000).alias("belongs"))
    expected = F.when(F.col("quality") == 1, "match").when(F.col("toxic") == 1, "exclude").otherwise(
        F.when(F.col("doc_id") % 2 == 0, "review").otherwise("exclude")
    )
    gold = load(spark, sf, "labels").join(d.select("doc_id", "source"), "doc_id").select(
        F.col("doc_id").alias("item_id"), F.col("source").alias("case_id"), expected.alias("expected")
    )
    out = evaluate.disambiguation_scores(predictions, gold, by)
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def disambig_eval(spark, sf):
    return _scores(spark, sf)


def disambig_eval_cases(spark, sf):
    return _scores(spark, sf, ["case_id"])


def _claim_metrics(spark, sf):
    c = _claims(spark, sf)
    return evaluate.claim_scores(c, _errors(spark, sf), c.select("claim_id", "expected_valid"))


def claim_eval(spark, sf):
    return _claim_metrics(spark, sf).withColumn("value", F.round("value", 6))


def metric_gates(spark, sf):
    metrics = evaluate.disambiguation_metrics(_scores(spark, sf)).unionByName(_claim_metrics(spark, sf))
    return evaluate.metric_gates(metrics).withColumn("value", F.round("value", 6))


def gates_passed(spark, sf):
    metrics = evaluate.disambiguation_metrics(_scores(spark, sf)).unionByName(_claim_metrics(spark, sf))
    return evaluate.gates_passed(evaluate.metric_gates(metrics))


def baseline_compare(spark, sf):
    """The claim and paper metrics against the paper metrics saved as a snapshot before and read back."""
    from scholarmatch.sources.tables import scratch_path

    before = evaluate.disambiguation_metrics(_scores(spark, sf))
    path = scratch_path(spark, "metrics")
    evaluate.save_baseline(before, path)
    now = before.unionByName(_claim_metrics(spark, sf))
    out = evaluate.compare_to_baseline(now, evaluate.load_baseline(spark, path))
    return out.withColumns({c: F.round(c, 6) for c in ("before", "after", "delta")})


_NAMES = (
    "validate_claims surviving_claims sanitize_points sanitize_summaries validate_draft draft_coverage prune_draft "
    "disambig_eval disambig_eval_cases claim_eval metric_gates gates_passed baseline_compare"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_CL = """
ev AS (SELECT 'e' || doc_id AS id, quality = 1 AS sure FROM labels),
cl AS (
  SELECT event_id AS claim_id, CASE event_type WHEN 'signup' THEN 'recruiting' WHEN 'purchase' THEN 'team_size' WHEN 'view' THEN 'observed_research_trend' WHEN 'click' THEN 'trend' ELSE 'generic' END AS claim_type,
         ['SUPPORTED', 'SUPPORTED', 'INFERRED', 'UNKNOWN'][event_id % 4 + 1] AS status, event_id % 3 <> 0 AS expected_valid,
         CASE WHEN event_id % 10 = 0 THEN ['x' || k] WHEN event_id % 5 = 0 THEN ['e' || k] ELSE ['e' || k, 'e' || (k + 50)] END AS refs
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)
),
refs AS (SELECT claim_id, claim_type, status, unnest(refs) AS id FROM cl),
err AS (
  SELECT claim_id, 'UNKNOWN_EVIDENCE_ID' AS code, id AS evidence_id FROM refs WHERE id NOT IN (SELECT id FROM ev)
  UNION ALL SELECT claim_id, 'AUTHOR_NOT_CONFIRMED', refs.id FROM refs JOIN ev USING (id) WHERE claim_type IN ('observed_research_trend', 'trend') AND status = 'SUPPORTED' AND NOT sure
  UNION ALL SELECT claim_id, 'AFFIRMATIVE_UNKNOWN_FIELD', '' FROM cl WHERE claim_type IN ('recruiting', 'team_size') AND status <> 'UNKNOWN'
)"""
_PT = """
ev AS (SELECT 'e' || doc_id AS id FROM labels),
fi AS (SELECT DISTINCT 'u' || user_id AS id FROM events WHERE event_type = 'purchase' AND value > 60),
pt AS (
  SELECT event_id AS point_id, ['research_intersection', 'method_match', 'background_gaps', 'recommended_papers', 'knowledge_to_supplement'][event_id % 5 + 1] AS section,
         CASE WHEN event_id % 13 = 0 THEN '' ELSE event_type END AS text, ['u' || (user_id * 3), 'u' || user_id] AS f, ['e' || k, 'e' || (k + 50)] AS e
  FROM (SELECT *, json_extract_string(props, '$.k')::INT AS k FROM events)
),
kf AS (SELECT point_id, string_agg(r, ',' ORDER BY i) AS f FROM (SELECT point_id, unnest(f) AS r, generate_subscripts(f, 1) AS i FROM pt) WHERE r IN (SELECT id FROM fi) GROUP BY 1),
ke AS (SELECT point_id, string_agg(r, ',' ORDER BY i) AS e FROM (SELECT point_id, unnest(e) AS r, generate_subscripts(e, 1) AS i FROM pt) WHERE r IN (SELECT id FROM ev) GROUP BY 1)"""
_DR = """
ev AS (SELECT DISTINCT 'e' || doc_id AS id FROM labels),
fi AS (SELECT DISTINCT 'f-' || conv_id || '-' || turn AS id FROM conversations WHERE turn % 4 <> 2),
se AS (
  SELECT conv_id AS draft_id, turn AS idx, text, CASE role WHEN 'assistant' THEN 'PROFESSOR_FACT' WHEN 'user' THEN 'STUDENT_FACT' ELSE 'GENERIC' END AS kind,
         CASE WHEN turn % 3 = 0 THEN []::VARCHAR[] ELSE ['f-' || conv_id || '-' || turn, 'f-' || conv_id || '-' || (turn - 1)] END AS f,
         CASE WHEN turn % 5 = 3 THEN []::VARCHAR[] ELSE ['e' || conv_id, 'e' || (conv_id + turn)] END AS e FROM conversations
),
bf AS (SELECT DISTINCT draft_id, idx FROM (SELECT draft_id, idx, unnest(f) AS r FROM se) WHERE r NOT IN (SELECT id FROM fi)),
be AS (SELECT DISTINCT draft_id, idx FROM (SELECT draft_id, idx, unnest(e) AS r FROM se) WHERE r NOT IN (SELECT id FROM ev)),
js AS (SELECT se.*, bf.idx IS NOT NULL AS badf, be.idx IS NOT NULL AS bade FROM se LEFT JOIN bf ON bf.draft_id = se.draft_id AND bf.idx = se.idx LEFT JOIN be ON be.draft_id = se.draft_id AND be.idx = se.idx),
er AS (
  SELECT draft_id, idx, 'UNCONFIRMED_FLATTERY' AS code, w AS detail FROM js, (VALUES ('thing'), ('éreau'), ('schein')) AS b(w) WHERE contains(text, w)
  UNION ALL SELECT draft_id, idx, 'PAPER_READ_UNCONFIRMED', '' FROM js WHERE contains(text, 'tion') AND (contains(text, 'inor') OR contains(text, 'lich'))
  UNION ALL SELECT draft_id, idx, 'PROFESSOR_FACT_WITHOUT_EVIDENCE', '' FROM js WHERE kind = 'PROFESSOR_FACT' AND len(e) = 0
  UNION ALL SELECT draft_id, idx, 'UNKNOWN_EVIDENCE_ID', '' FROM js WHERE kind = 'PROFESSOR_FACT' AND bade
  UNION ALL SELECT draft_id, idx, 'STUDENT_FACT_WITHOUT_FACT', '' FROM js WHERE kind = 'STUDENT_FACT' AND len(f) = 0
  UNION ALL SELECT draft_id, idx, 'UNCONFIRMED_STUDENT_FACT', '' FROM js WHERE kind = 'STUDENT_FACT' AND badf
)"""
_SC = """
gd AS (
  SELECT source AS case_id, n_chars >= 1000 AS p, quality = 1 OR (toxic <> 1 AND doc_id % 2 = 0) AS r FROM labels JOIN documents USING (doc_id)
),
sc AS (SELECT case_id, count(*) FILTER (p AND r) AS tp, count(*) FILTER (p AND NOT r) AS fp, count(*) FILTER (NOT p AND r) AS fn, count(*) FILTER (NOT p AND NOT r) AS tn FROM gd GROUP BY case_id),
one AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(tn) AS tn FROM sc)"""


def _prf(src: str, extra: str = "") -> str:
    return f"""SELECT {extra} tp, fp, fn, tn, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1
FROM (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM {src})"""


_MET = f"""
prf AS ({_prf('one')}), prf1 AS ({_prf("sc WHERE case_id = 'src1'")}),
acc AS (SELECT avg((NOT EXISTS (SELECT 1 FROM err WHERE err.claim_id = cl.claim_id) = expected_valid)::INT) AS a, count(*) FILTER (NOT expected_valid)::DOUBLE AS n FROM cl),
met AS (
  SELECT 'disambig.precision' AS key, precision AS value, true AS higher_is_better, NULL::DOUBLE AS gate FROM prf
  UNION ALL SELECT 'disambig.recall', recall, true, 0.9 FROM prf UNION ALL SELECT 'disambig.f1', f1, true, NULL FROM prf
  UNION ALL SELECT 'claims.accuracy', a, true, 1.0 FROM acc UNION ALL SELECT 'claims.unsupported_detected', n, true, NULL FROM acc
)"""
ORACLES = {
    "validate_claims": f"WITH {_CL} SELECT * FROM err",
    "surviving_claims": f"WITH {_CL} SELECT claim_id, claim_type, status FROM cl WHERE claim_id NOT IN (SELECT claim_id FROM err)",
    "sanitize_points": f"""WITH {_PT} SELECT point_id, section, text, coalesce(kf.f, '') AS fact_ids, coalesce(ke.e, '') AS evidence_ids FROM pt LEFT JOIN kf USING (point_id) LEFT JOIN ke USING (point_id)
WHERE text <> '' AND ke.e IS NOT NULL AND (section NOT IN ('research_intersection', 'method_match') OR kf.f IS NOT NULL)""",
    "sanitize_summaries": f"""WITH {_PT} SELECT point_id AS summary_id, CASE WHEN text <> '' AND ke.e IS NOT NULL THEN ' ' || text || ' ' ELSE '' END AS summary,
CASE WHEN text <> '' THEN coalesce(ke.e, '') ELSE '' END AS evidence_ids FROM pt LEFT JOIN ke USING (point_id)""",
    "validate_draft": f"WITH {_DR} SELECT * FROM er",
    "draft_coverage": f"""WITH {_DR} SELECT draft_id, round(coalesce(avg((len(e) > 0 AND NOT bade)::INT) FILTER (kind = 'PROFESSOR_FACT'), 1.0), 6) AS professor_fact_coverage,
round(coalesce(avg((len(f) > 0 AND NOT badf)::INT) FILTER (kind = 'STUDENT_FACT'), 1.0), 6) AS student_fact_coverage FROM js GROUP BY draft_id""",
    "prune_draft": f"WITH {_DR} SELECT draft_id, idx, kind AS sentence_type FROM se WHERE NOT EXISTS (SELECT 1 FROM er WHERE er.draft_id = se.draft_id AND er.idx = se.idx)",
    "disambig_eval": f"WITH {_SC} {_prf('one')}",
    "disambig_eval_cases": f"WITH {_SC} {_prf('sc', 'case_id,')}",
    "claim_eval": f"""WITH {_CL}, {_SC}, {_MET} SELECT key, round(value, 6) AS value, higher_is_better, gate FROM met WHERE key LIKE 'claims%'""",
    "metric_gates": f"""WITH {_CL}, {_SC}, {_MET} SELECT key, round(value, 6) AS value, higher_is_better, gate, gate IS NULL OR value >= gate AS passed FROM met""",
    "gates_passed": f"WITH {_CL}, {_SC}, {_MET} SELECT bool_and(gate IS NULL OR value >= gate) AS gates_passed FROM met",
    "baseline_compare": f"""WITH {_CL}, {_SC}, {_MET},
b AS (SELECT key, value AS before FROM met WHERE key LIKE 'disambig.%')
SELECT key, round(before, 6) AS before, round(value, 6) AS after, round(value - before, 6) AS delta, coalesce(value - before < 0 AND abs(value - before) >= 1e-9, false) AS regressed, before IS NULL AS "new"
FROM met LEFT JOIN b USING (key)""",
}
