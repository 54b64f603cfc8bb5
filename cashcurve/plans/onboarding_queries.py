"""Query keys for step 10 (onboarding): K1-K7 C10 D11 D16 E5 J9."""

from __future__ import annotations

from pyspark.sql import functions as F

from cashcurve.operators import ledger as lg
from cashcurve.operators import onboarding as ob
from cashcurve.plans.ledger_queries import LEDGER_CTES, documents_of
from cashcurve.plans.oracle_tables import with_tables
from cashcurve.plans.registry import register
from cashcurve.sources.model import N_COMPANIES, ModelTables

APP_NAME = "the app"
MIN_USER_TURNS_TO_COMPLETE = 2   # J9 requests: sessions whose user answered at least twice


def _sql_text(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


SCRIPT_VALUES = ", ".join(f"({i + 1}, {_sql_text(t.format(app_name=APP_NAME))})"
                          for i, t in enumerate(ob.ONBOARDING_SCRIPT[1:]))


@register("onboarding_gate", oracle=with_tables(["companies", "sessions"], """
    SELECT c.id AS company_id,
           NOT EXISTS (SELECT 1 FROM sessions s WHERE s.company_id = c.id AND s.is_completed) AS show_onboarding,
           CASE WHEN EXISTS (SELECT 1 FROM sessions s WHERE s.company_id = c.id AND s.is_completed)
                THEN 'onboarding_already_completed' ELSE 'no_completed_session' END AS reason
    FROM companies c"""))
def q_onboarding_gate(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return ob.onboarding_gate(m.companies, m.onboarding_sessions)


@register("open_session", oracle=with_tables(["companies", "sessions"], """
    SELECT c.id AS company_id, o.id AS session_id, o.status
    FROM companies c LEFT JOIN (
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY id DESC) AS rn
                     FROM sessions WHERE NOT is_completed) WHERE rn = 1) o ON o.company_id = c.id"""))
def q_open_session(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return ob.open_session(m.companies, m.onboarding_sessions)


@register("transcript", oracle=with_tables(["sessions", "messages"], """
    SELECT s.company_id, m.session_id, m.id, m.role, m.content
    FROM messages m JOIN sessions s ON s.id = m.session_id ORDER BY 1, 2, 3"""))
def q_transcript(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return ob.transcript(m.onboarding_sessions, m.onboarding_messages, whole=False)


@register("scripted_reply", oracle=with_tables(["messages"], f"""
    SELECT m.session_id, m.id AS message_id, m.user_turn,
           COALESCE(s.reply, {_sql_text(ob.ONBOARDING_HANDOFF)}) AS reply
    FROM (SELECT *, count(*) FILTER (WHERE role = 'user') OVER (
                      PARTITION BY session_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS user_turn
          FROM messages) m
    LEFT JOIN (VALUES {SCRIPT_VALUES}) AS s(n, reply) ON s.n = m.user_turn
    WHERE m.role = 'user'"""))
def q_scripted_reply(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return ob.scripted_replies(m.onboarding_messages, ob.script_table(spark, APP_NAME))


@register("profile_merge", oracle=with_tables(["profile_patches"], """
    SELECT p.company_id, p.key, arg_max(p.value, p.seq) AS value, v.profile_version
    FROM profile_patches p
    JOIN (SELECT company_id, CAST(count(DISTINCT seq) AS INTEGER) AS profile_version
          FROM profile_patches GROUP BY 1) v ON v.company_id = p.company_id
    GROUP BY p.company_id, p.key, v.profile_version"""))
def q_profile_merge(spark, sf_dir):
    return ob.profile_merge(ModelTables(spark, sf_dir).profile_patches)


@register("apply_plan", oracle=with_tables(["sessions", "profile_patches", "connections"], """
    SELECT s.id AS session_id, s.company_id, COALESCE(k.keys, '') AS profile_keys,
           COALESCE(k.n, 0) AS n_profile_keys,
           COALESCE(f.xero, FALSE) AS suggest_xero, COALESCE(f.qbo, FALSE) AS suggest_quickbooks
    FROM sessions s
    LEFT JOIN (SELECT company_id, string_agg(key, ',' ORDER BY key) AS keys, CAST(count(*) AS INTEGER) AS n
               FROM (SELECT DISTINCT company_id, key FROM profile_patches) d GROUP BY 1) k
      ON k.company_id = s.company_id
    LEFT JOIN (SELECT company_id, bool_or(lower(service_name) = 'xero') AS xero,
                      bool_or(lower(service_name) = 'quickbooks') AS qbo FROM connections GROUP BY 1) f
      ON f.company_id = s.company_id"""))
def q_apply_plan(spark, sf_dir):
    m = ModelTables(spark, sf_dir)
    return ob.apply_plan(m.onboarding_sessions, ob.profile_merge(m.profile_patches), m.connections)


def calibration_runs_of(m: ModelTables):
    """K6 for every session, with what it asked for and what the landed pages gave."""
    s = m.onboarding_sessions
    requests = s.select(F.col("id").alias("session_id"), (F.col("id") % 3 != 0).alias("request_xero"), (F.col("id") % 4 != 1).alias("request_qbo"))
    return ob.calibration_runs(s, ob.profile_merge(m.profile_patches), m.connections, lg.sync_counts(documents_of(m)), requests)


@register("calibration_status", oracle=with_tables(["sessions", "profile_patches", "connections"], f"""
    SELECT s.id AS session_id, s.company_id,
           CASE WHEN EXISTS (SELECT 1 FROM profile_patches p WHERE p.company_id = s.company_id)
                THEN 'ok' ELSE 'skipped_no_profile' END AS extract_profile,
           CASE WHEN NOT s.want_x THEN 'skipped' WHEN x.id IS NOT NULL THEN 'ok' ELSE 'failed' END AS sync_xero,
           CASE WHEN s.want_x AND x.id IS NOT NULL THEN COALESCE(rx.n, 0) END AS sync_xero_rows,
           CASE WHEN NOT s.want_q THEN 'skipped' WHEN q.id IS NOT NULL THEN 'ok' ELSE 'failed' END AS sync_qbo,
           CASE WHEN s.want_q AND q.id IS NOT NULL THEN COALESCE(rq.n, 0) END AS sync_qbo_rows,
           CASE WHEN (x.id IS NULL AND s.want_x) OR (q.id IS NULL AND s.want_q) THEN 'failed' ELSE 'ok' END AS status,
           NULLIF(concat_ws('; ',
                  CASE WHEN x.id IS NULL AND s.want_x THEN 'xero: {ob.NO_CONNECTION_ERROR["xero"]}' END,
                  CASE WHEN q.id IS NULL AND s.want_q THEN 'quickbooks: {ob.NO_CONNECTION_ERROR["quickbooks"]}' END), '') AS error
    FROM (SELECT *, id % 3 <> 0 AS want_x, id % 4 <> 1 AS want_q FROM sessions) s
    LEFT JOIN connections x ON x.company_id = s.company_id AND x.service_name = 'xero'
    LEFT JOIN connections q ON q.company_id = s.company_id AND q.service_name = 'quickbooks'
    LEFT JOIN (SELECT company_id, count(*) AS n FROM all_lines WHERE provider = 'xero' GROUP BY 1) rx
      ON rx.company_id = s.company_id
    LEFT JOIN (SELECT company_id, count(*) AS n FROM all_lines WHERE provider = 'quickbooks' GROUP BY 1) rq
      ON rq.company_id = s.company_id""", LEDGER_CTES))
def q_calibration_status(spark, sf_dir):
    """Each session asks for a calibration, some without one of the syncs."""
    return calibration_runs_of(ModelTables(spark, sf_dir))


COMPLETED_AT = "2026-01-15T09:30:00"


@register("complete_sessions", oracle=with_tables(["sessions", "messages"], f"""
    SELECT s.id AS session_id, s.company_id,
           CASE WHEN s.is_completed OR r.session_id IS NOT NULL THEN 'completed' ELSE s.status END AS status,
           s.is_completed AS was_completed, (r.session_id IS NOT NULL AND NOT s.is_completed) AS completed_now,
           CASE WHEN r.session_id IS NOT NULL AND NOT s.is_completed THEN '{COMPLETED_AT}' END AS completed_at
    FROM sessions s LEFT JOIN (SELECT session_id FROM messages WHERE role = 'user' GROUP BY 1
                               HAVING count(*) >= {MIN_USER_TURNS_TO_COMPLETE}) r ON r.session_id = s.id AND r.session_id % 5 <> 0"""))
def q_complete_sessions(spark, sf_dir):
    """Sessions with enough answers are completed; every fifth request names another company and changes nothing."""
    m = ModelTables(spark, sf_dir)
    s = m.onboarding_sessions.select(F.col("id").alias("session_id"), "company_id")
    req = (m.onboarding_messages.filter(F.col("role") == "user").groupBy("session_id")
           .agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= MIN_USER_TURNS_TO_COMPLETE).join(s, "session_id"))
    company = F.when(F.col("session_id") % 5 == 0, F.col("company_id") + 1).otherwise(F.col("company_id"))
    return ob.complete_sessions(m.onboarding_sessions, req.select("session_id", company.cast("int").alias("company_id")), COMPLETED_AT)


PROFILE_CTES = [
    ("stored", "SELECT company_id, key, arg_max(value, seq) AS value FROM profile_patches WHERE seq % 2 = 0 GROUP BY 1, 2"),
    ("requested", "SELECT *, seq % 101 = 1 AS clears FROM profile_patches WHERE seq % 2 = 1"),
    ("versions", "SELECT company_id, count(DISTINCT seq) AS v FROM profile_patches GROUP BY 1"),
    ("cut", "SELECT v.company_id, max(r.seq) AS at FROM versions v LEFT JOIN requested r ON r.company_id = v.company_id AND r.clears GROUP BY 1"),
    ("live", """
        SELECT s.company_id, s.key, s.value, -1 AS seq FROM stored s JOIN cut c ON c.company_id = s.company_id WHERE c.at IS NULL
        UNION ALL
        SELECT r.company_id, r.key, r.value, r.seq FROM requested r JOIN cut c ON c.company_id = r.company_id
        WHERE c.at IS NULL OR r.seq >= c.at"""),
]


@register("profile_apply", oracle=with_tables(["profile_patches"], """
    SELECT l.company_id, l.key, first(l.value ORDER BY l.seq DESC) AS value, CAST(max(v.v) AS INTEGER) AS profile_version
    FROM live l JOIN versions v ON v.company_id = l.company_id GROUP BY 1, 2""", PROFILE_CTES))
def q_profile_apply(spark, sf_dir):
    """K5: stored profiles (the even patches) after merge and replace requests (the odd ones) in order."""
    p = ModelTables(spark, sf_dir).profile_patches
    base = ob.profile_merge(p.filter(F.col("seq") % 2 == 0))
    requests = p.filter(F.col("seq") % 2 == 1).withColumn("merge", F.col("seq") % 101 != 1)
    return ob.profile_apply(base, requests)


@register("new_sessions", oracle=with_tables(["companies", "sessions", "connections"], """
    SELECT (SELECT COALESCE(MAX(id), 0) FROM sessions) + row_number() OVER (ORDER BY c.id) AS id,
           c.id AS company_id, 'in_progress' AS status,
           COALESCE(bool_or(lower(k.service_name) = 'xero'), FALSE) AS snapshot_xero,
           COALESCE(bool_or(lower(k.service_name) = 'quickbooks'), FALSE) AS snapshot_quickbooks
    FROM companies c LEFT JOIN connections k ON k.company_id = c.id
    GROUP BY c.id"""))
def q_new_sessions(spark, sf_dir):
    """Every company starts a new onboarding session."""
    m = ModelTables(spark, sf_dir)
    return ob.new_sessions(m.companies.select(F.col("id").alias("company_id")), m.onboarding_sessions, m.connections)


@register("profile_replace", oracle=with_tables(["profile_patches"], """
    SELECT p.company_id, p.key, p.value, v.profile_version
    FROM profile_patches p
    JOIN (SELECT company_id, MAX(seq) AS last_seq, CAST(count(DISTINCT seq) AS INTEGER) AS profile_version
          FROM profile_patches GROUP BY 1) v ON v.company_id = p.company_id AND p.seq = v.last_seq"""))
def q_profile_replace(spark, sf_dir):
    """K5 with merge=false: each company's profile becomes its newest patch only."""
    return ob.profile_replace(ModelTables(spark, sf_dir).profile_patches)


@register("profile_lookup", oracle=f"""
    WITH newest AS (SELECT CAST(user_id % {N_COMPANIES} AS INTEGER) AS company_id, event_type, arg_max(event_id, event_id) AS seq,
                           arg_max(props, event_id) AS props, arg_max(user_id, event_id) AS u FROM events GROUP BY 1, 2)
    SELECT company_id, event_type || '.by.user' AS path, CAST(u AS VARCHAR) AS value, 'number' AS type FROM newest
    UNION ALL SELECT company_id, event_type || '.by.odd', CASE WHEN u % 2 = 1 THEN 'true' ELSE 'false' END, 'boolean' FROM newest
    UNION ALL SELECT company_id, event_type || '.props.k', json_extract_string(props, '$.k'), 'number' FROM newest
    UNION ALL SELECT company_id, event_type || '.tags', '["' || event_type || '",' || seq || ']', 'array' FROM newest""")
def q_profile_lookup(spark, sf_dir):
    """K9, H8: nested profiles merged from one JSON patch per event, looked up by path."""
    ev = ModelTables(spark, sf_dir).raw.events
    by = F.struct(F.col("user_id").alias("user"), (F.col("user_id") % 2 == 1).alias("odd"))
    doc = F.concat(F.lit('{"'), "event_type", F.lit('":{"by":'), F.to_json(by), F.lit(',"props":'), "props", F.lit(',"tags":["'), "event_type",
                   F.lit('",'), F.col("event_id").cast("string"), F.lit("]}}"))
    patches = ev.select((F.col("user_id") % N_COMPANIES).cast("int").alias("company_id"), F.col("event_id").alias("seq"), doc.alias("doc"))
    return ob.profile_lookup(ob.profile_documents(patches))
