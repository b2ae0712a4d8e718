"""Campaign, conversation overview, prompts and the inbound fold over the
derived patients (customer), inbound texts (events) and stored items
(conversations)."""

from __future__ import annotations

from pyspark.sql import functions as F

from carelake import functions as C
from carelake.functions.envelope import envelope_json, parse_envelope
from carelake.functions.history import message
from carelake.operators import conversations as V
from carelake.plans import derived as D
from carelake.plans.registry import register
from carelake.plans.tables import table
from carelake.session import checkpoint_root
from carelake.sinks.conversations import upsert

_SYS = V.DEFAULT_SMS_SYSTEM


def _hist_cols(col="conversation_history"):
    h = C.parse_history(col)
    return [F.size(h).alias("history_size"),
            F.array_join(F.transform(h, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
             .alias("history_text")]


_CAMPAIGN_SQL = f"""
{D.PATIENTS_SQL}, {D.CONV_ITEMS_SQL.strip()},
msgs AS (
  SELECT row_index, file, sent, {D.phone_sql(D.MOBILE_SQL)} AS phone, {D.NAME_SQL} AS patient_name, amount_due,
    'Hi ' || {D.MSG_NAME_SQL} || ', you have an outstanding bill amount due of $' || {D.money_sql('amount_due')}
      || '. Call 555-0100 at your convenience. Reply STOP to opt out.' AS message
  FROM patients),
attempts AS (
  SELECT m.*, CASE WHEN phone IS NULL THEN 'skipped'
    WHEN phone IN (SELECT phone_number FROM conv_items WHERE opt_out) THEN 'suppressed'
    WHEN sent THEN 'sent' ELSE 'failed' END AS outcome
  FROM msgs m),
writes AS (
  SELECT phone AS phone_number, patient_name, coalesce(amount_due, '') AS amount_due, 'balance' AS message_type,
    message AS last_outbound_message, 'msg-' || CAST(row_index AS VARCHAR) AS last_message_id,
    0 AS reply_count, false AS opt_out, 1 AS history_size, 'assistant: ' || message AS history_text
  FROM (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY row_index DESC) AS rn
        FROM attempts WHERE outcome = 'sent') WHERE rn = 1)"""


def _campaign(spark, sf):
    return V.run_campaign(D.patients(spark, sf), D.conversation_items(spark, sf), "balance")


@register("campaign", f"WITH {_CAMPAIGN_SQL} SELECT * FROM writes", headline=True)
def q_campaign(spark, sf):
    attempts, _ = _campaign(spark, sf)
    w = V.campaign_writes(attempts)
    return w.select("phone_number", "patient_name", "amount_due", "message_type", "last_outbound_message",
                    "last_message_id", "reply_count", "opt_out", *_hist_cols())


@register("campaign_summary", f"""
WITH {_CAMPAIGN_SQL}
SELECT file, sent, skipped, suppressed, failed,
  'SMS sent to ' || CAST(sent AS VARCHAR) || ' patient(s). ' || CAST(skipped AS VARCHAR)
    || ' skipped (no mobile number).' AS summary
FROM (SELECT file, count(*) FILTER (WHERE outcome = 'sent') AS sent,
        count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
        count(*) FILTER (WHERE outcome = 'suppressed') AS suppressed,
        count(*) FILTER (WHERE outcome = 'failed') AS failed
      FROM attempts GROUP BY file)""")
def q_campaign_summary(spark, sf):
    attempts, _ = _campaign(spark, sf)
    return V.campaign_summary(attempts, by="file")


@register("campaign_errors", f"""
WITH {_CAMPAIGN_SQL}
SELECT file, row_index, phone FROM attempts WHERE outcome = 'failed'""")
def q_campaign_errors(spark, sf):
    attempts, _ = _campaign(spark, sf)
    return V.campaign_errors(attempts, by="file")


@register("latest_per_phone", f"""
WITH {_CAMPAIGN_SQL}
SELECT phone, row_index, patient_name FROM (
  SELECT *, row_number() OVER (PARTITION BY phone ORDER BY row_index DESC) AS rn FROM msgs WHERE phone IS NOT NULL)
WHERE rn = 1""")
def q_latest_per_phone(spark, sf):
    m = V.campaign_messages(D.patients(spark, sf)).where(F.col("phone").isNotNull())
    return V.latest_per_phone(m.select("phone", "row_index", "patient_name"))


@register("suppress_opted_out", f"""
WITH {_CAMPAIGN_SQL}
SELECT row_index, phone FROM msgs
WHERE phone IS NOT NULL AND phone NOT IN (SELECT phone_number FROM conv_items WHERE opt_out)""")
def q_suppress_opted_out(spark, sf):
    m = V.campaign_messages(D.patients(spark, sf)).where(F.col("phone").isNotNull())
    return V.suppress_opted_out(m.select("row_index", "phone"), D.conversation_flags(spark, sf))


@register("upsert_conversations", f"""
WITH {_CAMPAIGN_SQL}
SELECT phone_number, patient_name, amount_due, message_type, reply_count, opt_out, last_outbound_message, history_size
FROM writes
UNION ALL
SELECT c.phone_number, c.patient_name, c.amount_due, c.message_type, c.reply_count, c.opt_out,
  CAST(NULL AS VARCHAR), CAST(coalesce(h.n, 0) AS INTEGER)
FROM conv_items c LEFT JOIN (SELECT conv_id, count(*) AS n FROM conv_msgs GROUP BY conv_id) h USING (conv_id)
WHERE c.phone_number NOT IN (SELECT phone_number FROM writes)""")
def q_upsert_conversations(spark, sf):
    _, convs = _campaign(spark, sf)
    return convs.select("phone_number", "patient_name", "amount_due", "message_type", "reply_count", "opt_out",
                        "last_outbound_message", F.size(C.parse_history("conversation_history")).alias("history_size"))


_LAST_USER_SQL = """(SELECT conv_id, content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) AS r
   FROM conv_msgs WHERE role = 'user') WHERE r = 1)"""


@register("conversation_overview", f"""
WITH {D.CONV_ITEMS_SQL.strip()}
SELECT c.phone_number AS phone, c.patient_name, c.amount_due, coalesce(c.message_type, 'balance') AS message_type,
  c.reply_count, c.opt_out, u.content AS last_reply
FROM conv_items c LEFT JOIN {_LAST_USER_SQL} u USING (conv_id)""")
def q_conversation_overview(spark, sf):
    return V.conversation_overview(D.conversation_items(spark, sf))


@register("last_user_message", f"""
WITH {D.CONV_ITEMS_SQL.strip()}
SELECT c.phone_number, u.content AS last_user_message, CAST(coalesce(h.n, 0) AS INTEGER) AS history_size
FROM conv_items c LEFT JOIN {_LAST_USER_SQL} u USING (conv_id)
LEFT JOIN (SELECT conv_id, count(*) AS n FROM conv_msgs GROUP BY conv_id) h USING (conv_id)""")
def q_last_user_message(spark, sf):
    cv = D.conversation_items(spark, sf)
    h = C.parse_history("conversation_history")
    return cv.select("phone_number", C.last_user_message(h).alias("last_user_message"),
                     F.size(h).alias("history_size"))


@register("chat_messages", """
WITH m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos, role, text FROM conversations),
c AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, 0 AS pos, 'system' AS role, 'Conversation ' || CAST(conv_id AS VARCHAR) AS content FROM c
UNION ALL SELECT conv_id, CAST(pos AS INTEGER), role, text FROM m
UNION ALL SELECT conv_id, CAST(n + 1 AS INTEGER), 'user', 'What is my balance?' FROM c""")
def q_chat_messages(spark, sf):
    """All turns of every conversation between its context and the question."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    cv = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    history = F.transform("turns", lambda t: message(t["role"], t["text"]))
    msgs = V.chat_messages(F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")), history, F.lit("What is my balance?"))
    return V.explode_messages(cv.withColumn("messages", msgs), ["conv_id"])


@register("sms_prompt", f"""
WITH {D.INBOUND_SQL.strip()}, {D.CONV_ITEMS_SQL.strip()},
hn AS (SELECT conv_id, count(*) AS n FROM conv_msgs GROUP BY conv_id),
q AS (
  SELECT i.msg_id, trim(i.body) AS body, c.conv_id, coalesce(hn.n, 0) AS n,
    coalesce(c.patient_name, 'Patient') AS pn, coalesce(c.amount_due, '') AS amt
  FROM inbound i LEFT JOIN conv_items c ON c.phone_number = i.phone LEFT JOIN hn ON hn.conv_id = c.conv_id
  WHERE {D.COMMAND_SQL.format(p='i.phone', b='i.body')} = 'message' AND NOT coalesce(c.opt_out, false))
SELECT msg_id, 0 AS pos, 'system' AS role,
  '{_SYS}' || CASE WHEN pn <> '' THEN chr(10) || chr(10) || 'Current patient: ' || pn || '.' ELSE '' END
    || CASE WHEN amt <> '' THEN ' Outstanding balance: $' || amt || '.' ELSE '' END AS content
FROM q
UNION ALL
SELECT q.msg_id, CAST(m.pos - greatest(m.n - 10, 0) AS INTEGER), m.role, m.content
FROM q JOIN conv_msgs m ON m.conv_id = q.conv_id AND m.pos > m.n - 10
UNION ALL
SELECT msg_id, CAST(least(n, 10) + 1 AS INTEGER), 'user', body FROM q""")
def q_sms_prompt(spark, sf):
    p = V.sms_prompt(D.inbound(spark, sf), D.conversation_items(spark, sf))
    return V.explode_messages(p, ["msg_id"])


_TIMELINE_SQL = f"""
{D.INBOUND_SQL.strip()}, {D.CONV_ITEMS_SQL.strip()},
cmd AS (SELECT msg_id, ts, trim(phone) AS phone, trim(body) AS body, reply, sent,
          {D.COMMAND_SQL.format(p='phone', b='body')} AS command FROM inbound),
tl AS (
  SELECT c.*, coalesce(last_value(CASE command WHEN 'stop' THEN true WHEN 'start' THEN false END IGNORE NULLS)
      OVER (PARTITION BY c.phone ORDER BY ts, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      s.opt_out, false) AS opted_out_before
  FROM cmd c LEFT JOIN conv_items s ON s.phone_number = c.phone),
act AS (
  SELECT *, CASE command WHEN 'ignore' THEN 'ignore' WHEN 'stop' THEN 'opt_out' WHEN 'help' THEN 'help'
    WHEN 'start' THEN 'resubscribe' ELSE CASE WHEN opted_out_before THEN 'suppressed' ELSE 'reply' END END AS action
  FROM tl)"""


def _actions(spark, sf):
    return V.inbound_actions(D.inbound(spark, sf), D.conversation_flags(spark, sf))


@register("optout_timeline", f"WITH {_TIMELINE_SQL} SELECT msg_id, phone, command, opted_out_before FROM tl")
def q_optout_timeline(spark, sf):
    t = V.optout_timeline(D.inbound(spark, sf), D.conversation_flags(spark, sf))
    return t.select("msg_id", "phone", "command", "opted_out_before")


@register("inbound_actions", f"WITH {_TIMELINE_SQL} SELECT msg_id, phone, command, action FROM act",
          headline=True)
def q_inbound_actions(spark, sf):
    return _actions(spark, sf).select("msg_id", "phone", "command", "action")


_ENVELOPE_SQL = f"""
{D.INBOUND_SQL.strip()}, {D.CONV_ITEMS_SQL.strip()},
rec AS (SELECT i.msg_id, i.ts, r.rec, CASE WHEN e.event_type = 'signup' THEN '' ELSE i.phone END AS phone,
          CASE WHEN e.event_type = 'signup' THEN '' WHEN r.rec = 2 THEN 'second ' || trim(i.body) ELSE trim(i.body) END AS body
        FROM inbound i JOIN events e ON e.event_id = i.msg_id
        JOIN (SELECT 1 AS rec UNION ALL SELECT 2) r ON r.rec = 1 OR e.event_type = 'error'),
cmd AS (SELECT *, {D.COMMAND_SQL.format(p='phone', b='body')} AS command FROM rec),
tl AS (SELECT c.*, coalesce(last_value(CASE command WHEN 'stop' THEN true WHEN 'start' THEN false END IGNORE NULLS)
         OVER (PARTITION BY c.phone ORDER BY ts, msg_id, rec ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         s.opt_out, false) AS opted_out_before
       FROM cmd c LEFT JOIN conv_items s ON s.phone_number = c.phone)"""


@register("envelope_actions", f"""
WITH {_ENVELOPE_SQL}
SELECT msg_id, rec, phone, command, CASE command WHEN 'ignore' THEN 'ignore' WHEN 'stop' THEN 'opt_out' WHEN 'help' THEN 'help'
    WHEN 'start' THEN 'resubscribe' ELSE CASE WHEN opted_out_before THEN 'suppressed' ELSE 'reply' END END AS action
FROM tl""")
def q_envelope_actions(spark, sf):
    """Envelopes as delivered -> records -> actions: every record of a message acts, redeliveries (none here) act once."""
    ib = D.inbound(spark, sf, keep=("event_type",))
    raw = ib.select("msg_id", "ts", envelope_json("event_type", "phone", "body").alias("raw"))
    records = parse_envelope(raw, id_cols=["msg_id", "ts"])
    return V.inbound_actions(records, D.conversation_flags(spark, sf), dedupe=True).select("msg_id", "rec", "phone", "command", "action")


@register("outbound_messages", f"""
WITH {_TIMELINE_SQL}
SELECT msg_id, phone, action,
  CASE action WHEN 'help' THEN 'For billing help call 555-0100. Reply STOP to opt out.'
              WHEN 'resubscribe' THEN 'You have been re-subscribed. Call 555-0100 for help.'
              ELSE left(coalesce(reply, ''), 1600) END AS sms_body
FROM act WHERE action IN ('help', 'resubscribe', 'reply')""")
def q_outbound_messages(spark, sf):
    return V.outbound_messages(_actions(spark, sf))


@register("outbound_cut", f"""
WITH {_TIMELINE_SQL}
SELECT msg_id, phone, left(reply, 30) AS sms_body FROM act WHERE action = 'reply'""")
def q_outbound_cut(spark, sf):
    """Answers longer than the allowed 30 characters are cut, without a marker."""
    out = V.outbound_messages(_actions(spark, sf), max_chars=30)
    return out.where(F.col("action") == "reply").select("msg_id", "phone", "sms_body")


@register("sms_prompt_in_order", f"""
WITH {_TIMELINE_SQL},
hn AS (SELECT phone_number, count(*) AS n FROM conv_msgs GROUP BY phone_number),
p AS (
  SELECT a.msg_id, a.phone, a.ts, a.body, a.reply, a.sent, coalesce(c.patient_name, 'Patient') AS pn, coalesce(c.amount_due, '') AS amt,
    coalesce(hn.n, 0) AS stored,
    coalesce(count(*) FILTER (WHERE a.sent) OVER (PARTITION BY a.phone ORDER BY a.ts, a.msg_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM act a LEFT JOIN conv_items c ON c.phone_number = a.phone LEFT JOIN hn ON hn.phone_number = a.phone
  WHERE a.action = 'reply'),
past AS (
  SELECT phone_number AS phone, pos, role, content FROM conv_msgs
  UNION ALL SELECT phone, stored + 2 * before + 1, 'user', body FROM p WHERE sent
  UNION ALL SELECT phone, stored + 2 * before + 2, 'assistant', reply FROM p WHERE sent)
SELECT msg_id, 0 AS pos, 'system' AS role,
  '{_SYS}' || CASE WHEN pn <> '' THEN chr(10) || chr(10) || 'Current patient: ' || pn || '.' ELSE '' END
    || CASE WHEN amt <> '' THEN ' Outstanding balance: $' || amt || '.' ELSE '' END AS content
FROM p
UNION ALL
SELECT p.msg_id, CAST(h.pos - greatest(stored + 2 * before - 10, 0) AS INTEGER), h.role, h.content
FROM p JOIN past h ON h.phone = p.phone AND h.pos > stored + 2 * before - 10 AND h.pos <= stored + 2 * before
UNION ALL
SELECT msg_id, CAST(least(stored + 2 * before, 10) + 1 AS INTEGER), 'user', body FROM p""", headline=True)
def q_sms_prompt_in_order(spark, sf):
    """Each answered message's prompt with the replies and STOPs that came before it."""
    checkpoint_root(spark)
    actions = _actions(spark, sf).checkpoint()
    p = V.sms_prompts_in_order(actions, D.conversation_items(spark, sf))
    return V.explode_messages(p, ["msg_id"])


@register("upsert_merge", f"""
WITH {_TIMELINE_SQL},
flags AS (SELECT phone, max_by(action = 'opt_out', (ts, msg_id)) AS flag FROM act
          WHERE action IN ('opt_out', 'resubscribe') GROUP BY phone)
SELECT coalesce(c.phone_number, f.phone) AS phone_number, c.patient_name, c.amount_due, c.reply_count,
  coalesce(f.flag, c.opt_out) AS opt_out
FROM conv_items c FULL JOIN flags f ON f.phone = c.phone_number""")
def q_upsert_merge(spark, sf):
    """STOP and START update one field of the stored item and create it when absent."""
    acts = _actions(spark, sf).where(F.col("action").isin("opt_out", "resubscribe"))
    last = F.max(F.struct("ts", "msg_id", (F.col("action") == "opt_out").alias("opt_out")))["opt_out"]
    changes = acts.groupBy(F.col("phone").alias("phone_number")).agg(last.alias("opt_out"))
    stored = D.conversation_items(spark, sf).select("phone_number", "patient_name", "amount_due", "reply_count", "opt_out")
    return upsert(stored, changes, mode="merge")


@register("fold_conversations", f"""
WITH {_TIMELINE_SQL},
rep AS (SELECT * FROM act WHERE action = 'reply' AND sent),
cnt AS (SELECT phone, count(*) AS n_rep FROM rep GROUP BY phone),
lastin AS (SELECT phone, body FROM (SELECT phone, body,
    row_number() OVER (PARTITION BY phone ORDER BY ts DESC, msg_id DESC) AS r FROM rep) WHERE r = 1),
flags AS (SELECT phone, flag FROM (SELECT phone, action = 'opt_out' AS flag,
    row_number() OVER (PARTITION BY phone ORDER BY ts DESC, msg_id DESC) AS r
    FROM act WHERE action IN ('opt_out', 'resubscribe')) WHERE r = 1),
allm AS (
  SELECT m.phone_number AS phone, 0 AS grp, CAST(NULL AS TIMESTAMP) AS ts, m.pos AS o1, 0 AS k, m.role, m.content
  FROM conv_msgs m WHERE m.phone_number IN (SELECT phone FROM cnt)
  UNION ALL SELECT phone, 1, ts, msg_id, 0, 'user', body FROM rep
  UNION ALL SELECT phone, 1, ts, msg_id, 1, 'assistant', reply FROM rep),
kept AS (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY grp DESC, ts DESC, o1 DESC, k DESC) AS rk FROM allm),
newh AS (SELECT phone, count(*) AS hs, string_agg(role || ': ' || content, chr(10) ORDER BY grp, ts, o1, k) AS ht
         FROM kept WHERE rk <= 20 GROUP BY phone),
oldh AS (SELECT phone_number AS phone, count(*) AS hs, string_agg(role || ': ' || content, chr(10) ORDER BY pos) AS ht
         FROM conv_msgs GROUP BY phone_number),
touched AS (SELECT phone FROM cnt UNION SELECT phone FROM flags),
keys AS (SELECT phone_number AS phone FROM conv_items UNION SELECT phone FROM touched)
SELECT k.phone AS phone_number, c.patient_name, c.amount_due, c.message_type,
  CASE WHEN cnt.n_rep > 0 THEN CAST(coalesce(c.reply_count, 0) + cnt.n_rep AS INTEGER) ELSE c.reply_count END AS reply_count,
  coalesce(f.flag, c.opt_out) AS opt_out,
  CASE WHEN cnt.n_rep > 0 THEN li.body END AS last_inbound_message,
  CAST(CASE WHEN cnt.n_rep > 0 THEN nh.hs ELSE coalesce(oh.hs, 0) END AS INTEGER) AS history_size,
  CASE WHEN cnt.n_rep > 0 THEN nh.ht ELSE coalesce(oh.ht, '') END AS history_text
FROM keys k LEFT JOIN conv_items c ON c.phone_number = k.phone LEFT JOIN cnt ON cnt.phone = k.phone
LEFT JOIN flags f ON f.phone = k.phone LEFT JOIN lastin li ON li.phone = k.phone
LEFT JOIN newh nh ON nh.phone = k.phone LEFT JOIN oldh oh ON oh.phone = k.phone""", headline=True)
def q_fold_conversations(spark, sf):
    # The actions feed two aggregations: checkpointed once (shared checkpoint
    # folder) instead of being recomputed, which also cuts their lineage.
    checkpoint_root(spark)
    actions = _actions(spark, sf).checkpoint()
    folded = V.fold_conversations(D.conversation_items(spark, sf), actions)
    return folded.select("phone_number", "patient_name", "amount_due", "message_type", "reply_count", "opt_out",
                         "last_inbound_message", *_hist_cols())
