"""Inbound-message stream: per phone, the opt-out flag and the conversation
item are keyed state; each message yields its action.

:func:`inbound_stream` acts in order of arrival.  The stored item enters through
a stream-static join; the state function only orders the rows of one phone inside one
micro-batch (bounded by the trigger size) and applies the same rules as
:func:`inbound_actions` / :func:`fold_conversations`.

:func:`inbound_changes` acts in order of event time, as the batch does.  The
state of a phone is its item as of the watermark and the messages since then.
When an older message arrives the phone is folded again from that item; messages
whose outcome changes come out again with a higher ``revision``, and the
new item with them.  The stored items are rows of the stream, read once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake import functions as C
from carelake.functions.history import HISTORY
from carelake.operators.conversations import CONV_COLUMNS, HISTORY_KEEP
from carelake.session import scratch_dir
from carelake.streaming.common import with_event_clock
from carelake.streaming.keyed import fold_keys

OUTPUT_SCHEMA = ("msg_id long, phone string, command string, action string, "
                 "reply_count int, opt_out boolean, history_size int")


def _history(text):
    try:
        h = json.loads(text) if text else []
        return h if isinstance(h, list) else []
    except (ValueError, TypeError):
        return []


def _by_arrival(row: dict) -> tuple:
    return "t" not in row, row.get("t", 0), "msg_id" not in row, row.get("msg_id", 0), "rec" not in row, row.get("rec", 0)


def _fold(phone: str, rows: list[dict], state, _watermark, _timed_out) -> tuple[list[tuple], object, None]:
    rows.sort(key=_by_arrival)
    if state is None:
        stored = json.loads(rows[0].get("stored") or "{}")
        state = [stored.get("opt_out"), stored.get("reply_count"), _history(stored.get("history")), stored.get("last_inbound")]
    opt, count, hist, last_in = state
    out = []
    for r in rows:
        cmd = r["command"]
        if cmd == "ignore":
            act = "ignore"
        elif cmd == "stop":
            act, opt = "opt_out", True
        elif cmd == "help":
            act = "help"
        elif cmd == "start":
            act, opt = "resubscribe", False
        elif opt:
            act = "suppressed"
        else:
            act = "reply"
            if r.get("sent"):
                hist = (hist + [{"role": "user", "content": r["body"]},
                                {"role": "assistant", "content": r.get("reply")}])[-HISTORY_KEEP:]
                count = (count or 0) + 1
                last_in = r["body"]
        out.append((r.get("msg_id"), phone, cmd, act, count, opt, len(hist)))
    return out, [opt, count, hist, last_in], None


def inbound_stream(inbound: DataFrame, convs: DataFrame, dedupe_delay: str | None = None) -> DataFrame:
    """``inbound`` (streaming: msg_id, ts, phone, body, reply, sent) -> actions.

    Every message yields a row however late it comes; a late STOP takes effect
    from its arrival on.  Records of one envelope (column ``rec``) follow their
    order in it.  With ``dedupe_delay`` a message delivered twice (same ``msg_id``
    and ``rec`` within that event time) is handled once, at the price that
    messages later than the delay are dropped by the watermark.  Messages
    without a sender never reach the keyed step."""
    stored = convs.select(F.col("phone_number").alias("phone"), F.to_json(F.struct(
        "opt_out", "reply_count", F.col("conversation_history").alias("history"), F.col("last_inbound_message").alias("last_inbound"))).alias("stored"))
    inbound = inbound.withColumn("rec", F.col("rec") if "rec" in inbound.columns else F.lit(1))
    if dedupe_delay:
        inbound = (inbound.withColumn("_event_time", F.col("ts").cast("timestamp"))   # watermarks need TIMESTAMP
                   .withWatermark("_event_time", dedupe_delay).dropDuplicatesWithinWatermark(["msg_id", "rec"]))
    staged = (inbound
              .withColumn("command", C.classify_command("phone", "body"))
              .withColumn("phone", C.pystrip(F.coalesce(F.col("phone"), F.lit(""))))
              .withColumn("body", C.pystrip(F.coalesce(F.col("body"), F.lit("")))))
    blank = staged.where(F.col("phone") == "").select(
        "msg_id", "phone", "command", F.lit("ignore").alias("action"), F.lit(None).cast("int").alias("reply_count"),
        F.lit(None).cast("boolean").alias("opt_out"), F.lit(0).alias("history_size"))
    timed = staged.where(F.col("phone") != "").join(stored, on="phone", how="left").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    known = fold_keys(timed.select("phone", "t", "msg_id", "rec", "command", "body", "reply", "sent", "stored"), "phone", _fold, OUTPUT_SCHEMA)
    return known.unionByName(blank)


# ------------------------------------------------------------- event time --
_ITEM_TEXTS = ("patient_name", "amount_due", "message_type", "last_outbound_message", "last_message_id")
_OUTCOME = "action string, reply_count int, opt_out boolean, history_size int"
CHANGES = ("kind string, phone string, revision long, msg_id long, rec int, command string, " + _OUTCOME
           + ", last_inbound_message string, history_text string, history array<struct<role:string,content:string>>, "
           + ", ".join(f"{c} string" for c in _ITEM_TEXTS))


class _Item:
    """A phone's item: what messages change of it."""

    def __init__(self, opt_out=None, reply_count=None, history=(), last_inbound=None, replied=False, touched=False):
        self.opt_out, self.reply_count, self.history = opt_out, reply_count, list(history)
        self.last_inbound, self.replied, self.touched = last_inbound, replied, touched

    def copy(self) -> "_Item":
        return _Item(self.opt_out, self.reply_count, self.history, self.last_inbound, self.replied, self.touched)

    def take(self, row: tuple) -> tuple:
        """Apply one message; -> its outcome."""
        command, body, reply, sent = row[5:9]
        action = {"ignore": "ignore", "stop": "opt_out", "help": "help", "start": "resubscribe"}.get(command)
        if action is None:
            action = "suppressed" if self.opt_out else "reply"
        if action in ("opt_out", "resubscribe"):
            self.opt_out, self.touched = action == "opt_out", True
        elif action == "reply" and sent:
            self.history = (self.history + [("user", body), ("assistant", reply)])[-HISTORY_KEEP:]
            self.reply_count = (self.reply_count or 0) + 1
            self.last_inbound, self.replied, self.touched = body, True, True
        return action, self.reply_count, self.opt_out, len(self.history)


def _in_order(row: tuple) -> tuple:
    return row[1], row[0], row[3], row[2], row[4]   # rows without a time, then without an id, come first


def _seeded(item: _Item, seed: dict) -> _Item:
    """The item with the stored one before it."""
    stored = [(m.get("role"), m.get("content")) for m in seed.get("history", ())]
    count = None if seed["reply_count"] < 0 else seed["reply_count"]
    if item.reply_count is not None:
        count = (count or 0) + item.reply_count
    opt = seed["opt_out"] if seed["has_opt_out"] else None
    return _Item(opt if item.opt_out is None else item.opt_out, count, (stored + item.history)[-HISTORY_KEEP:],
                 item.last_inbound if item.replied else seed.get("last_inbound"), item.replied, item.touched)


def _fold_in_event_time(phone: str, news: list[dict], state, watermark_ms: int, _timed_out: bool) -> tuple[list[tuple], object, int | None]:
    s = state or {}
    item = _Item(s.get("opt_out"), s.get("reply_count"), [tuple(m) for m in s.get("history", ())], s.get("last_inbound"),
                 s.get("replied", False), s.get("touched", False))
    seeded, texts = s.get("seeded", False), s.get("texts", {})
    watermark = watermark_ms * 1000
    rows, new = [], False
    for row, outcome in s.get("recent", ()):   # in order
        if row[0] < watermark:
            item.take(row)   # nothing older is waited for: the item takes it in
        else:
            rows.append((tuple(row), tuple(outcome)))
    for r in news:
        if r["kind"] == "seed":
            if not seeded:   # a restarted stream may read the stored items again
                item = _seeded(item, r)
                seeded, texts = True, {c: r[c] for c in (*_ITEM_TEXTS, "history_text") if c in r}
                new = new or bool(rows)
            continue
        new = True
        rows.append(((r["t"], r["timed"], r["msg_id"], r["has_id"], r["rec"], r["command"], r["body"], r.get("reply"), r["sent"]), None))
    rows.sort(key=lambda x: _in_order(x[0]))
    revision = s.get("revision", 0) + 1
    out, recent, now = [], [], item.copy()
    for row, before in rows:
        outcome = now.take(row)
        if outcome != before:
            out.append(("message", phone, revision, row[2] if row[3] else None, row[4], row[5], *outcome, None, None, None, *[None] * len(_ITEM_TEXTS)))
        if not row[1] or row[0] < watermark:
            item = now.copy()
        else:
            recent.append((row, outcome))
    if new and (now.touched or seeded):
        text = None if now.replied else texts.get("history_text")
        history = [dict(zip(("role", "content"), m)) for m in now.history] if now.replied else None
        out.append(("item", phone, revision, None, None, None, None, now.reply_count, now.opt_out, None, now.last_inbound, text, history,
                    *[texts.get(c) for c in _ITEM_TEXTS]))
    after = {"seeded": seeded, "touched": item.touched, "revision": revision, "opt_out": item.opt_out, "reply_count": item.reply_count,
             "replied": item.replied, "last_inbound": item.last_inbound, "history": item.history, "texts": texts, "recent": recent}
    return out, after, max(watermark_ms, recent[0][0][0] // 1000) + 1 if recent else None


def inbound_changes(inbound: DataFrame, convs: DataFrame, lateness: str = "7 days") -> DataFrame:
    """``inbound`` (streaming: msg_id, ts, phone, body, reply, sent[, rec]) -> messages' outcomes and items, in event time.

    Rows of kind ``message`` are (phone, msg_id, rec, command) with their
    outcome, rows of kind ``item`` a phone's new stored item; of either the
    highest ``revision`` counts.  A message that comes up to ``lateness`` after
    later ones gives what the batch gives; one that is later still is taken in before the
    messages that are waited for.  Messages without a time are the oldest, as
    in the batch.  No message is dropped.

    ``convs``: the stored items, as a stream that is read once; a table is
    written to the shared scratch folder for that.
    """
    spark = inbound.sparkSession
    if not convs.isStreaming:
        folder = f"{scratch_dir(spark, 'stored-items')}/items"
        convs.write.parquet(folder)
        convs = spark.readStream.schema(convs.schema).parquet(folder)
    text = lambda c: F.col(c) if c in convs.columns else F.lit(None).cast("string")
    seed = convs.select(
        F.lit("seed").alias("kind"), F.col("phone_number").alias("phone"), F.lit(None).cast("timestamp").alias("ts"),
        F.coalesce("reply_count", F.lit(-1)).alias("reply_count"), F.col("opt_out").isNotNull().alias("has_opt_out"),
        F.coalesce("opt_out", F.lit(False)).alias("opt_out"), F.col("conversation_history").alias("history_text"),
        C.parse_history("conversation_history").cast(HISTORY).alias("history"), text("last_inbound_message").alias("last_inbound"),
        *[text(c).alias(c) for c in _ITEM_TEXTS])
    rec = F.col("rec") if "rec" in inbound.columns else F.lit(1)
    rows = inbound.select(
        F.lit("message").alias("kind"), C.pystrip(F.coalesce(F.col("phone"), F.lit(""))).alias("phone"), F.col("ts").cast("timestamp").alias("ts"),
        F.coalesce("msg_id", F.lit(0)).alias("msg_id"), F.col("msg_id").isNotNull().alias("has_id"), F.coalesce(rec, F.lit(1)).cast("int").alias("rec"),
        C.classify_command("phone", "body").alias("command"), C.pystrip(F.coalesce(F.col("body"), F.lit(""))).alias("body"), "reply",
        F.coalesce("sent", F.lit(False)).alias("sent"))
    blank = rows.where("phone = ''").select(F.lit("message").alias("kind"), "phone", F.lit(1).cast("long").alias("revision"),
                                             F.when(F.col("has_id"), F.col("msg_id")).alias("msg_id"), "rec", "command", F.lit("ignore").alias("action"),
                                             F.lit(0).alias("history_size"))
    both = rows.where("phone <> ''").unionByName(seed, allowMissingColumns=True)
    both = both.withColumns({"timed": F.col("ts").isNotNull(), "t": F.coalesce(F.unix_micros("ts"), F.lit(0))})
    both = both.fillna({"msg_id": 0, "has_id": False, "rec": 1, "sent": False, "reply_count": -1, "has_opt_out": False, "opt_out": False})
    both = with_event_clock(both, "ts", lateness).drop("ts")
    known = fold_keys(both, "phone", _fold_in_event_time, CHANGES, "_arrived")
    return known.unionByName(blank, allowMissingColumns=True)


def message_rows(changes: DataFrame) -> DataFrame:
    """The messages' outcomes among :func:`inbound_changes`."""
    return changes.where("kind = 'message'").select("msg_id", "rec", "phone", "command", "action", "reply_count", "opt_out", "history_size", "revision")


def item_rows(changes: DataFrame) -> DataFrame:
    """The stored items among :func:`inbound_changes`: ``CONV_COLUMNS`` and the revision."""
    items = changes.where("kind = 'item'").withColumn("phone_number", F.col("phone"))
    items = items.withColumn("conversation_history", F.when(F.col("history").isNotNull(), C.history_json("history")).otherwise(F.col("history_text")))
    return items.select(*CONV_COLUMNS, "revision")
