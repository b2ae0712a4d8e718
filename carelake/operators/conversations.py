"""Outreach campaigns and the inbound-message fold.

Per-phone state is never gathered into one task: counts and "latest" values
are partial aggregates, the bounded history tail is a per-key top-k (Spark
applies the limit before the shuffle), and the running opt-out flag is the
bucketed scan in :mod:`carelake.operators.scan`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelake import functions as C
from carelake.functions.history import HISTORY, message
from carelake.operators.scan import DENSE_ROWS, carry_last, dense_buckets, hour_bucket, prefix_sum
from carelake.sinks.conversations import upsert

HISTORY_KEEP = 20      # messages stored per conversation
PROMPT_HISTORY = 10    # messages given to the reply prompt
SMS_MAX_CHARS = 1600   # outbound text is cut here (no marker)
REPLY_BLOCK = 4096     # replies of one phone handled together by the point-in-time history

# Automatic answers to HELP and START (%s = office phone).
HELP_TEXT = "For billing help call %s. Reply STOP to opt out."
RESUBSCRIBED_TEXT = "You have been re-subscribed. Call %s for help."

_FIRST_BUCKET = -(2 ** 62)   # sorts before every real time bucket

CONV_COLUMNS = ["phone_number", "patient_name", "amount_due", "message_type", "last_outbound_message",
                "last_message_id", "conversation_history", "reply_count", "opt_out", "last_inbound_message"]


# ---------------------------------------------------------------- campaign --
def campaign_messages(patients: DataFrame, message_type: str = "balance",
                      office_phone: str = C.outreach.DEFAULT_OFFICE_PHONE,
                      clinic: str = C.outreach.DEFAULT_CLINIC) -> DataFrame:
    """Per patient row: normalised phone (null = skipped) and the message text."""
    mobile = C.first_filled("mobile_number", "mobilenumber")
    name = C.message_name("first_name", "last_name")
    return patients.withColumns({
        "phone": C.normalize_phone(mobile),
        "patient_name": C.patient_name("first_name", "last_name"),
        "message": C.build_message(name, F.col("amount_due"), F.lit(message_type), office_phone, clinic),
        "message_type": F.lit(message_type),
    })


def suppress_opted_out(targets: DataFrame, convs: DataFrame, phone: str = "phone") -> DataFrame:
    """Drop targets whose stored conversation is opted out."""
    opted = convs.where(F.col("opt_out")).select(F.col("phone_number").alias(phone))
    return targets.join(opted, on=phone, how="left_anti")


def latest_per_phone(df: DataFrame, phone: str = "phone", order: str = "row_index") -> DataFrame:
    """The row with the greatest ``order`` per phone (later file rows win).

    A partial ``max(struct)`` aggregate: a phone with millions of rows is
    reduced map-side before the shuffle.
    """
    others = [c for c in df.columns if c not in (phone, order)]
    best = F.max(F.struct(F.col(order), *[F.col(c) for c in others])).alias("_best")
    return df.groupBy(phone).agg(best).select(phone, *[F.col(f"_best.{c}").alias(c) for c in [order, *others]])


def campaign_items(msgs: DataFrame) -> DataFrame:
    """The conversation item written for each successfully sent message."""
    return msgs.select(
        F.col("row_index"),
        F.col("phone").alias("phone_number"),
        F.col("patient_name"),
        F.coalesce(F.col("amount_due").cast("string"), F.lit("")).alias("amount_due"),
        F.col("message_type"),
        F.col("message").alias("last_outbound_message"),
        F.concat(F.lit("msg-"), F.col("row_index").cast("string")).alias("last_message_id"),
        C.history_json(F.array(message("assistant", F.col("message")))).alias("conversation_history"),
        F.lit(0).alias("reply_count"),
        F.lit(False).alias("opt_out"),
        F.lit(None).cast("string").alias("last_inbound_message"),
    )


def run_campaign(patients: DataFrame, convs: DataFrame, message_type: str = "balance",
                 respect_opt_out: bool = True, **msg_kw) -> tuple[DataFrame, DataFrame]:
    """Fold one campaign into the conversation table.

    Returns ``(attempts, new_convs)``: every patient row with its outcome
    (``skipped`` / ``suppressed`` / ``failed`` / ``sent``) and the new table.
    The send outcome is the input column ``sent``; failed rows write nothing.
    """
    msgs = campaign_messages(patients, message_type, **msg_kw)
    opted = convs.where(F.col("opt_out")).select(F.col("phone_number").alias("phone"), F.lit(True).alias("_opted")).distinct()
    marked = msgs.join(opted, on="phone", how="left") if respect_opt_out else msgs.withColumn("_opted", F.lit(None))
    attempts = marked.withColumn("outcome", F.when(F.col("phone").isNull(), "skipped")
                                 .when(F.coalesce(F.col("_opted"), F.lit(False)), "suppressed")
                                 .when(F.col("sent"), "sent").otherwise("failed")).drop("_opted")
    return attempts, upsert(convs, campaign_writes(attempts), key="phone_number", mode="replace")


def campaign_writes(attempts: DataFrame) -> DataFrame:
    """One item per phone: the last successfully sent row of the file."""
    written = campaign_items(attempts.where(F.col("outcome") == "sent"))
    return latest_per_phone(written, phone="phone_number").drop("row_index")


def campaign_errors(attempts: DataFrame, by: str = "file") -> DataFrame:
    """The failed sends of each campaign, one row each (the error list)."""
    return attempts.where(F.col("outcome") == "failed").select(by, "row_index", "phone")


def campaign_summary(attempts: DataFrame, by: str = "file") -> DataFrame:
    """Counts per campaign file and the summary line.  Failed sends stay rows
    (``attempts.where(outcome = 'failed')``) rather than an unbounded list."""
    agg = attempts.groupBy(by).agg(
        F.count_if(F.col("outcome") == "sent").alias("sent"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "suppressed").alias("suppressed"),
        F.count_if(F.col("outcome") == "failed").alias("failed"))
    return agg.withColumn("summary", F.format_string(
        "SMS sent to %d patient(s). %d skipped (no mobile number).", F.col("sent"), F.col("skipped")))


# ------------------------------------------------------------ conversations --
def conversation_overview(convs: DataFrame) -> DataFrame:
    """One row per stored conversation with defaults, most replies first."""
    h = C.parse_history("conversation_history")
    return (convs.select(
                F.coalesce(F.col("phone_number"), F.lit("")).alias("phone"),
                F.coalesce(F.col("patient_name"), F.lit("")).alias("patient_name"),
                F.coalesce(F.col("amount_due"), F.lit("")).alias("amount_due"),
                F.coalesce(F.col("message_type"), F.lit("balance")).alias("message_type"),
                F.coalesce(F.col("reply_count"), F.lit(0)).cast("int").alias("reply_count"),
                F.coalesce(F.col("opt_out"), F.lit(False)).alias("opt_out"),
                C.last_user_message(h).alias("last_reply"))
            .orderBy(F.col("reply_count").desc(), F.col("phone")))


def with_patient(inbound: DataFrame, convs: DataFrame, phone: str = "phone") -> DataFrame:
    """Attach the stored item to each inbound message; unknown phones get the
    defaults (name ``Patient``, no balance, empty history, not opted out)."""
    c = convs.select(F.col("phone_number").alias(phone), F.lit(True).alias("_known"),
                     "patient_name", "amount_due", "conversation_history",
                     F.col("opt_out").alias("stored_opt_out"))
    j = inbound.join(c, on=phone, how="left")
    # An absent attribute (null) reads as the default, for known and unknown phones alike.
    return (j.withColumn("patient_name", F.coalesce(F.col("patient_name"), F.lit("Patient")))
             .withColumn("amount_due", F.coalesce(F.col("amount_due"), F.lit("")))
             .withColumn("history", C.parse_history("conversation_history"))
             .withColumn("stored_opt_out", F.coalesce(F.col("stored_opt_out"), F.lit(False)))
             .drop("_known", "conversation_history"))


def _message_key(inbound: DataFrame) -> list[str]:
    """What tells messages apart; records of one envelope follow their order in it."""
    return ["msg_id"] + (["rec"] if "rec" in inbound.columns else [])


def _without_redeliveries(inbound: DataFrame) -> DataFrame:
    """A message delivered twice is handled once.  Records of one envelope share
    its ``msg_id``, so ``rec`` tells them apart; rows without an id are never merged."""
    key = _message_key(inbound)
    return inbound.where(F.col("msg_id").isNotNull()).dropDuplicates(key).unionByName(inbound.where(F.col("msg_id").isNull()))


def optout_timeline(inbound: DataFrame, convs: DataFrame, dedupe: bool = False, most: int | None = DENSE_ROWS) -> DataFrame:
    """Add ``command`` and ``opted_out_before``: the opt-out state just before
    each message (last STOP/START earlier for the phone, else the stored flag,
    else false), ordered by (ts, msg_id).

    The stored flag enters the bucketed scan as a virtual first event of its
    phone (a bucket before all others), so the message rows are never joined
    with the stored table on the phone key.  ``dedupe`` handles a message that
    is delivered twice once.  Records of one envelope (column ``rec``) follow
    their order in it.  Messages without a time are the oldest.  A phone with
    more than ``most`` messages in an hour is cut finer.
    """
    if dedupe:
        inbound = _without_redeliveries(inbound)
    order = ["ts", *_message_key(inbound)]
    staged = (inbound
              .withColumn("phone", C.pystrip(F.coalesce(F.col("phone"), F.lit(""))))
              .withColumn("command", C.classify_command("phone", "body"))
              .withColumn("body", C.pystrip(F.coalesce(F.col("body"), F.lit(""))))
              .withColumn("_flag", F.when(F.col("command") == "stop", F.lit(True))
                          .when(F.col("command") == "start", F.lit(False)))
              .withColumn("_hour", F.coalesce(hour_bucket(F.col("ts")), F.lit(_FIRST_BUCKET + 1)))
              .withColumn("_real", F.lit(True)))
    staged = dense_buckets(staged, ["phone"], "_hour", order, "_bucket", most).drop("_hour")
    stored = convs.where(F.col("opt_out").isNotNull()).select(
        F.col("phone_number").alias("phone"), F.col("opt_out").alias("_flag"),
        F.struct(F.lit(_FIRST_BUCKET).alias("coarse"), F.lit(0).alias("cell"), F.lit(0).alias("tie")).alias("_bucket"), F.lit(False).alias("_real"))
    timeline = staged.unionByName(stored, allowMissingColumns=True)
    scanned = carry_last(timeline, ["phone"], order, "_bucket", "_flag", "_prev", inclusive=False)
    return (scanned.where(F.col("_real"))
            .withColumn("opted_out_before", F.coalesce(F.col("_prev"), F.lit(False)))
            .drop("_flag", "_bucket", "_prev", "_real"))


def inbound_actions(inbound: DataFrame, convs: DataFrame, dedupe: bool = False) -> DataFrame:
    """ignore / opt_out / help / resubscribe / suppressed / reply per message.
    HELP is answered even when opted out."""
    t = optout_timeline(inbound, convs, dedupe=dedupe)
    cmd = F.col("command")
    action = (F.when(cmd == "ignore", "ignore").when(cmd == "stop", "opt_out").when(cmd == "help", "help")
               .when(cmd == "start", "resubscribe")
               .when(F.col("opted_out_before"), "suppressed").otherwise("reply"))
    return t.withColumn("action", action)


def fold_conversations(convs: DataFrame, actions: DataFrame, keep: int = HISTORY_KEEP) -> DataFrame:
    """Apply a batch of classified inbound messages to the stored items.

    ``reply`` rows that were sent append (user, assistant) and bump
    ``reply_count``; STOP/START set ``opt_out``; an item is created when absent.
    ``actions`` is read twice (aggregates and the history tail): pass it
    checkpointed when it is expensive to recompute.
    """
    pairs_needed = (keep + 1) // 2
    ok_reply = (F.col("action") == "reply") & F.coalesce(F.col("sent"), F.lit(False))
    flag = F.when(F.col("action") == "opt_out", F.lit(True)).when(F.col("action") == "resubscribe", F.lit(False))
    ordkey = [F.col(c) for c in ("ts", *_message_key(actions))]
    per_phone = (actions.where(ok_reply | flag.isNotNull())
                 .groupBy("phone")
                 .agg(F.count_if(ok_reply).alias("_replies"),
                      F.max(F.when(ok_reply, F.struct(*ordkey, F.col("body")))).getField("body").alias("_last_in"),
                      F.max(F.when(flag.isNotNull(), F.struct(*ordkey, flag.alias("f")))).getField("f").alias("_flag")))
    # Only the last ``keep / 2`` pairs can survive the cut: a per-phone top-k.
    w = Window.partitionBy("phone").orderBy(*[c.desc() for c in ordkey])
    tail = (actions.where(ok_reply)
            .withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= pairs_needed)
            .groupBy("phone")
            .agg(F.array_sort(F.collect_list(F.struct(*ordkey, F.col("body"), F.col("reply")))).alias("_tail")))
    none = F.array().cast(HISTORY)
    new_msgs = F.aggregate(F.coalesce(F.col("_tail"), F.array().cast(tail.schema["_tail"].dataType)), none,
                           lambda h, r: C.append_pair(h, r["body"], r["reply"]))
    changes = per_phone.join(tail, on="phone", how="left").withColumnRenamed("phone", "phone_number")

    cur = convs.select(*[F.col(c) if c in convs.columns else F.lit(None).cast(
        "boolean" if c == "opt_out" else "int" if c == "reply_count" else "string").alias(c) for c in CONV_COLUMNS])
    j = cur.join(changes, on="phone_number", how="full_outer")
    replied = F.coalesce(F.col("_replies"), F.lit(0)) > 0
    stored_h = C.parse_history("conversation_history")
    new_h = C.last_n(F.concat(stored_h, new_msgs), keep)
    return j.select(
        "phone_number", "patient_name", "amount_due", "message_type", "last_outbound_message", "last_message_id",
        F.when(replied, C.history_json(new_h)).otherwise(F.col("conversation_history")).alias("conversation_history"),
        F.when(replied, (F.coalesce(F.col("reply_count"), F.lit(0)) + F.col("_replies")).cast("int"))
         .otherwise(F.col("reply_count")).alias("reply_count"),
        F.coalesce(F.col("_flag"), F.col("opt_out")).alias("opt_out"),
        F.when(replied, F.col("_last_in")).otherwise(F.col("last_inbound_message")).alias("last_inbound_message"),
    )


def outbound_messages(actions: DataFrame, office_phone: str = C.outreach.DEFAULT_OFFICE_PHONE,
                      max_chars: int = SMS_MAX_CHARS) -> DataFrame:
    """The text sent back for each action that answers: HELP and START get the
    fixed texts, a reply its (input) answer cut to ``max_chars`` characters."""
    a = F.col("action")
    body = (F.when(a == "help", F.format_string(HELP_TEXT, F.lit(office_phone)))
             .when(a == "resubscribe", F.format_string(RESUBSCRIBED_TEXT, F.lit(office_phone)))
             .otherwise(C.truncate_text(F.coalesce(F.col("reply"), F.lit("")), max_chars)))
    return actions.where(a.isin("help", "resubscribe", "reply")).select("msg_id", "phone", "action",
                                                                         body.alias("sms_body"))


# ------------------------------------------------------------------ prompts --
DEFAULT_SMS_SYSTEM = "You answer patient text messages for the billing office."


def sms_prompt(inbound: DataFrame, convs: DataFrame, system_text: str = DEFAULT_SMS_SYSTEM,
               n: int = PROMPT_HISTORY) -> DataFrame:
    """Prompt message list for each inbound question from a phone that is not
    opted out: system text (+ patient, + balance), last ``n`` stored messages,
    the new message.  It sees the stored items only; :func:`sms_prompts_in_order`
    also sees the messages before it."""
    j = with_patient(inbound.withColumn("body", C.pystrip(F.coalesce(F.col("body"), F.lit("")))), convs)
    j = j.where((C.classify_command("phone", "body") == "message") & ~F.col("stored_opt_out"))
    return j.withColumn("messages", _prompt(F.col("history"), system_text, n))


def _prompt(history, system_text: str, n: int) -> "F.Column":
    name = F.coalesce(F.col("patient_name"), F.lit(""))
    amount = F.coalesce(F.col("amount_due"), F.lit(""))
    system = F.concat(F.lit(system_text),
                      F.when(name != "", F.concat(F.lit("\n\nCurrent patient: "), name, F.lit("."))).otherwise(F.lit("")),
                      F.when(amount != "", F.concat(F.lit(" Outstanding balance: $"), amount, F.lit(".")))
                       .otherwise(F.lit("")))
    return F.concat(F.array(message("system", system)), C.last_n(history, n), F.array(message("user", F.col("body"))))


def _with_recent_replies(replies: DataFrame, order: list[str], pairs: int) -> DataFrame:
    """Sent ``replies`` with ``_recent``: the last ``pairs`` (question, answer) messages of the phone up to and with
    this one.  A phone's replies are numbered bucket by bucket and cut into blocks; each block gets copies of the
    replies just before it, so that no task holds more than a block of a phone, however busy it is."""
    numbered = prefix_sum(replies.withColumn("_one", F.lit(1)), ["phone"], order, "_bucket", "_one", "_nth")
    at = F.col("_nth") - 1
    own = F.floor(at / REPLY_BLOCK)
    places = F.array(F.struct(own.alias("block"), F.lit(True).alias("real")))
    carried = F.array(F.struct((own + 1).alias("block"), F.lit(False).alias("real")))
    w = Window.partitionBy("phone", "_place.block").orderBy("_nth").rowsBetween(1 - pairs, 0)
    pair = F.array(message("user", F.col("body")), message("assistant", F.col("reply")))
    return (numbered.withColumn("_place", F.explode(F.when(at % REPLY_BLOCK > REPLY_BLOCK - pairs, F.concat(places, carried))
                                                    .otherwise(places)))
            .withColumn("_recent", F.flatten(F.collect_list(pair).over(w)))
            .where(F.col("_place.real")).drop("_one", "_nth", "_place"))


def sms_prompts_in_order(actions: DataFrame, convs: DataFrame, system_text: str = DEFAULT_SMS_SYSTEM,
                         n: int = PROMPT_HISTORY) -> DataFrame:
    """The prompt of each ``reply`` action as it was at its time: the last ``n`` messages are those of the stored item
    followed by the replies sent to the phone before this message (STOP and START before it have already decided the
    action).  ``actions`` is read several times: pass it checkpointed when it is expensive to recompute.  Among messages
    with equal (ts, msg_id, rec) any order may hold."""
    order = ["ts", *_message_key(actions)]
    replies = (actions.where(F.col("action") == "reply")
               .withColumn("_bucket", F.coalesce(hour_bucket(F.col("ts")), F.lit(_FIRST_BUCKET))))
    ok = F.coalesce(F.col("sent"), F.lit(False))
    sent = _with_recent_replies(replies.where(ok), order, (n + 1) // 2)
    timeline = sent.unionByName(replies.where(~ok), allowMissingColumns=True)
    before = carry_last(timeline, ["phone"], order, "_bucket", "_recent", "_before", inclusive=False)
    j = with_patient(before, convs)
    history = F.concat(F.col("history"), F.coalesce(F.col("_before"), F.array().cast(HISTORY)))
    return j.withColumn("messages", _prompt(history, system_text, n)).drop("_bucket", "_recent", "_before")


def chat_messages(ctx, history, question) -> "F.Column":
    """System context, the prior messages in order, then the question."""
    return F.concat(F.array(message("system", ctx)), history, F.array(message("user", question)))


def explode_messages(df: DataFrame, id_cols, col: str = "messages") -> DataFrame:
    """(id..., pos, role, content) rows from a message array."""
    return (df.select(*id_cols, F.posexplode(col).alias("pos", "_m"))
            .select(*id_cols, F.col("pos").cast("int").alias("pos"),
                    F.col("_m.role").alias("role"), F.col("_m.content").alias("content")))
