"""Onboarding data operators: C10 D11 D16 E5 J9 K1-K9.

All per-session / per-company lookups of the reference become aggregates and
joins over every session at once.  The user-turn ordinal (E5) uses the
skew-safe running count, so one very long conversation is split across tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashcurve.functions.grouped import listed, running_count

# The scripted assistant turns and the hand-off text.  The
# product name is a parameter (``app_name``), not part of the fixed text.
ONBOARDING_SCRIPT = [
    "Welcome to {app_name}. What is your company or product called, and what do you sell in one or two sentences?",
    "How do you make revenue today (for example subscriptions, one-off sales, services, or a mix)?",
    "Roughly how large is your team, and what role do you play (founder, finance, operations, other)?",
    "What is the main outcome you want from {app_name} in the next 90 days?",
    "Anything else we should know before we open your workspace?",
]
ONBOARDING_HANDOFF = ("Thanks — that is everything we need for now. When you are ready, use "
                      "\"Save and open dashboard\" below. You can connect Xero or QuickBooks later under Settings.")
PROVIDERS = ("xero", "quickbooks")
NO_CONNECTION_ERROR = {"xero": "No Xero connection for this company.",
                       "quickbooks": "No QuickBooks connection for this company."}


def integration_flags(connections: DataFrame) -> DataFrame:
    """Per company, which providers are connected ({xero, quickbooks} flags)."""
    name = F.lower(F.coalesce(F.col("service_name"), F.lit("")))
    return connections.groupBy("company_id").agg(
        F.bool_or(name == "xero").alias("xero"), F.bool_or(name == "quickbooks").alias("quickbooks"))


def onboarding_gate(companies: DataFrame, sessions: DataFrame) -> DataFrame:
    """K1 + C10: show onboarding until the company has a completed session."""
    done = sessions.filter(F.col("is_completed")).select("company_id").distinct()
    c = companies.select(F.col("id").alias("company_id"))
    j = c.join(done.withColumn("_done", F.lit(True)), "company_id", "left")
    finished = F.coalesce(F.col("_done"), F.lit(False))
    return j.select("company_id", (~finished).alias("show_onboarding"),
                    F.when(finished, "onboarding_already_completed").otherwise("no_completed_session").alias("reason"))


def open_session(companies: DataFrame, sessions: DataFrame) -> DataFrame:
    """K2: newest (highest id) session without completed_at per company; NULL when none."""
    latest = sessions.filter(~F.col("is_completed")).groupBy("company_id").agg(F.max("id").alias("session_id"))
    c = companies.select(F.col("id").alias("company_id"))
    j = c.join(latest, "company_id", "left").join(
        sessions.select(F.col("id").alias("session_id"), "status"), "session_id", "left")
    return j.select("company_id", "session_id", "status")


def transcript(sessions: DataFrame, messages: DataFrame, whole: bool = True) -> DataFrame:
    """K3: messages of every session, scoped to the session's company (semi-join), in id order."""
    s = sessions.select(F.col("id").alias("session_id"), "company_id")
    m = messages.join(s, "session_id", "inner")
    return listed(m.select("company_id", "session_id", "id", "role", "content"), "company_id", "session_id", "id", whole=whole)


def script_table(spark, app_name: str = "the app") -> DataFrame:
    """K4 script as a small lookup table: user turn n (1-based) -> reply text."""
    rows = [(i + 1, t.format(app_name=app_name)) for i, t in enumerate(ONBOARDING_SCRIPT[1:])]
    return spark.createDataFrame(rows, "user_turn long, reply string")


def scripted_replies(messages: DataFrame, script: DataFrame) -> DataFrame:
    """K4 + E5 + D11: after the n-th user message of a session the assistant says script[n]
    (n = count of user rows so far); past the script it hands off."""
    turns = messages.select("session_id", "id", "role")      # counting needs no text: none is shuffled or checkpointed
    m = running_count(turns, "session_id", ["id"], F.col("role") == "user", "user_turn")
    u = m.filter(F.col("role") == "user")
    j = u.join(F.broadcast(script), "user_turn", "left")
    return j.select("session_id", F.col("id").alias("message_id"), "user_turn",
                    F.coalesce(F.col("reply"), F.lit(ONBOARDING_HANDOFF)).alias("reply"))


def profile_merge(patches: DataFrame) -> DataFrame:
    """K5: shallow merge of every company's profile patches in sequence order.

    The merged value of a key is the one of the newest patch that sets it
    (a newer NULL wins, as dict.update does); the version is 1 for the first
    write plus one per later write.  Output as (company, key, value) rows.
    """
    kv = patches.groupBy("company_id", "key").agg(F.max_by("value", "seq").alias("value"))
    ver = patches.groupBy("company_id").agg(F.countDistinct("seq").cast("int").alias("profile_version"))
    return kv.join(ver, "company_id")


def profile_replace(patches: DataFrame) -> DataFrame:
    """K5 with merge=false: the profile becomes the newest patch's keys only."""
    last = patches.groupBy("company_id").agg(F.max("seq").alias("seq"))
    kv = patches.join(last, ["company_id", "seq"], "left_semi")
    ver = patches.groupBy("company_id").agg(F.countDistinct("seq").cast("int").alias("profile_version"))
    return kv.select("company_id", "key", "value").join(ver, "company_id")


def apply_plan(sessions: DataFrame, profile: DataFrame, connections: DataFrame) -> DataFrame:
    """K7: sorted profile keys and suggested syncs per session."""
    keys = profile.groupBy("company_id").agg(F.array_sort(F.collect_set("key")).alias("k"))
    flags = integration_flags(connections)
    s = sessions.select(F.col("id").alias("session_id"), "company_id")
    j = s.join(keys, "company_id", "left").join(flags, "company_id", "left")
    return j.select("session_id", "company_id", F.array_join(F.coalesce("k", F.array()), ",").alias("profile_keys"),
                    F.coalesce(F.size("k"), F.lit(0)).alias("n_profile_keys"),
                    F.coalesce("xero", F.lit(False)).alias("suggest_xero"),
                    F.coalesce("quickbooks", F.lit(False)).alias("suggest_quickbooks"))


def profile_apply(base: DataFrame, requests: DataFrame) -> DataFrame:
    """K5: stored profiles after a sequence of merge and replace requests.

    ``base`` has (company_id, key, value, profile_version) rows, ``requests`` (company_id, seq, merge, key, value) rows, one
    per key of the request (a request without keys is one row with a NULL key).  Only what a company's last replace and
    the later requests set counts, plus the stored profile if nothing was replaced; per key the newest value wins.
    Every request raises the version by one; a company without a profile starts at 1.
    """
    per = requests.groupBy("company_id").agg(F.countDistinct("seq").alias("n"), F.max(F.when(~F.col("merge"), F.col("seq"))).alias("cleared"))
    version = base.groupBy("company_id").agg(F.max("profile_version").alias("stored"))
    rows = requests.select("company_id", "seq", "key", "value").unionByName(
        base.select("company_id", F.lit(None).cast(requests.schema["seq"].dataType).alias("seq"), "key", "value"))
    live = rows.join(per, "company_id", "left").filter(
        F.col("key").isNotNull() & (F.col("cleared").isNull() | (F.col("seq") >= F.col("cleared"))))
    g = live.groupBy("company_id", "key").agg(F.max_by("value", F.struct(F.col("seq").isNotNull(), F.col("seq"))).alias("value"), F.max("n").alias("n"))
    return g.join(version, "company_id", "left").select(
        "company_id", "key", "value", (F.coalesce("stored", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("int").alias("profile_version"))


def calibration_runs(sessions: DataFrame, profile: DataFrame, connections: DataFrame, sync_counts: DataFrame,
                     requests: DataFrame | None = None) -> DataFrame:
    """K6: one calibration run per session.

    ``requests`` (session_id, request_xero, request_qbo) says which syncs are wanted (default: both); a sync that is not
    is skipped.  extract_profile ok/skipped; a wanted sync fails when the company has no connection
    of that kind (the reference raises), otherwise it is ok with the rows the
    ingest upserted for that company and provider; status failed if any failed,
    errors joined with '; '.
    """
    has_profile = profile.select("company_id").distinct().withColumn("_prof", F.lit(True))
    flags = integration_flags(connections)
    rows = (sync_counts.groupBy("company_id").pivot("provider", list(PROVIDERS))
            .agg(F.sum("rows_upserted")))
    s = sessions.select(F.col("id").alias("session_id"), "company_id")
    if requests is None:
        s = s.withColumns({"request_xero": F.lit(True), "request_qbo": F.lit(True)})
    else:
        s = s.join(requests.select("session_id", "request_xero", "request_qbo"), "session_id")
    j = s.join(has_profile, "company_id", "left").join(flags, "company_id", "left").join(
        rows.select("company_id", F.col("xero").alias("xero_rows"), F.col("quickbooks").alias("qbo_rows")),
        "company_id", "left")
    x_on, q_on = F.col("request_xero"), F.col("request_qbo")
    x_ok = F.coalesce(F.col("xero"), F.lit(False))
    q_ok = F.coalesce(F.col("quickbooks"), F.lit(False))
    x_bad, q_bad = x_on & ~x_ok, q_on & ~q_ok
    errors = F.concat_ws("; ", F.when(x_bad, F.lit("xero: " + NO_CONNECTION_ERROR["xero"])),
                         F.when(q_bad, F.lit("quickbooks: " + NO_CONNECTION_ERROR["quickbooks"])))
    step = lambda on, ok: F.when(~on, "skipped").when(ok, "ok").otherwise("failed")
    return j.select(
        "session_id", "company_id",
        F.when(F.col("_prof"), "ok").otherwise("skipped_no_profile").alias("extract_profile"),
        step(x_on, x_ok).alias("sync_xero"), F.when(x_on & x_ok, F.coalesce(F.col("xero_rows"), F.lit(0))).alias("sync_xero_rows"),
        step(q_on, q_ok).alias("sync_qbo"), F.when(q_on & q_ok, F.coalesce(F.col("qbo_rows"), F.lit(0))).alias("sync_qbo_rows"),
        F.when(x_bad | q_bad, "failed").otherwise("ok").alias("status"),
        F.nullif(errors, F.lit("")).alias("error"))


def complete_sessions(sessions: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """Complete the requested sessions of the requesting company once, at ``now``.

    A request (session_id, company_id) for another company's session changes nothing; a session that is completed already is
    left as is.  ``completed_at`` is the time set by this change, NULL otherwise.
    """
    r = requests.select(F.col("session_id").alias("id"), "company_id", F.lit(True).alias("_req")).distinct()
    j = sessions.join(r, ["id", "company_id"], "left")
    change = F.coalesce(F.col("_req"), F.lit(False)) & ~F.col("is_completed")
    return j.select(F.col("id").alias("session_id"), "company_id",
                    F.when(change | F.col("is_completed"), "completed").otherwise(F.col("status")).alias("status"),
                    F.col("is_completed").alias("was_completed"), change.alias("completed_now"),
                    F.when(change, F.lit(now)).alias("completed_at"))


def new_sessions(requests: DataFrame, sessions: DataFrame, connections: DataFrame) -> DataFrame:
    """K8 + A7 + D16: one new in-progress session per requesting company, ids after the current
    maximum, each carrying the company's integration snapshot."""
    from cashcurve.operators.upsert import assign_ids, max_id
    need = requests.select("company_id")
    flags = integration_flags(connections)
    rows = assign_ids(need, ["company_id"], max_id(sessions)).join(flags, "company_id", "left")
    return rows.select("id", "company_id", F.lit("in_progress").alias("status"),
                       F.coalesce("xero", F.lit(False)).alias("snapshot_xero"),
                       F.coalesce("quickbooks", F.lit(False)).alias("snapshot_quickbooks"))


def profile_document(profile: DataFrame) -> DataFrame:
    """K9 + H8: the merged profile per company as a map (keys in sorted order) with its version.

    One map per company, built from (key, value) rows; its size is bounded by
    the profile's key vocabulary, not by the number of patches.
    """
    g = profile.groupBy("company_id", "profile_version").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("data"))
    return g.select("company_id", "profile_version", "data", F.array_sort(F.map_keys("data")).alias("profile_keys"))


def profile_documents(patches: DataFrame) -> DataFrame:
    """K5 on nested documents: company_id, key, value (VARIANT) of every company's profile after all its patches.

    ``patches``: company_id, seq, doc (a JSON object).  The merge is shallow: the newest patch that has a top-level key gives its
    value, whole, also if it is nested or null; documents that are no objects change nothing.
    """
    d = patches.select("company_id", "seq", F.try_parse_json("doc").alias("doc"))
    keys = d.lateralJoin(patches.sparkSession.tvf.variant_explode(F.col("doc").outer())).filter(F.col("key").isNotNull())
    return keys.groupBy("company_id", "key").agg(F.max_by("value", "seq").alias("value"))


def profile_lookup(profile: DataFrame, depth: int = 4) -> DataFrame:
    """K9 + H8: company_id, path, value (JSON text), type of every leaf of the profiles.

    Objects are opened down to ``depth`` levels; deeper ones, empty ones and lists are leaves.
    """
    tvf = profile.sparkSession.tvf
    kind = F.schema_of_variant("value")
    nested = F.startswith(kind, F.lit("OBJECT<")) & (kind != "OBJECT<>")
    level, leaves = profile.select("company_id", F.col("key").alias("path"), "value"), []
    for k in range(depth):
        last = k == depth - 1
        leaves.append(level if last else level.filter(~nested))
        if not last:
            inner = level.filter(nested).withColumnRenamed("value", "outer_value")
            level = inner.lateralJoin(tvf.variant_explode(F.col("outer_value").outer())).select(
                "company_id", F.concat_ws(".", "path", "key").alias("path"), "value")
    out = leaves[0]
    for more in leaves[1:]:
        out = out.unionByName(more)
    name = (F.when(kind == "VOID", "null").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(F.startswith(kind, F.lit("OBJECT")), "object")
            .when(F.startswith(kind, F.lit("ARRAY")), "array").otherwise("number"))
    return out.select("company_id", "path", F.to_json("value").alias("value"), name.alias("type"))
