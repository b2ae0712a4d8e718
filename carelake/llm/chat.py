"""Chat formatting with typed content parts (native).

A message is a role and a list of parts: text, image, audio or document.  A
visitor turns every part into one string (its text, or a placeholder with the
attachment's number) and keeps a record of each attachment with the tokens
it will expand to.  A conversation becomes one string:

    <|turn|>role<|body|>part part ...<|end|>   for every turn

Control strings inside roles and texts are escaped reversibly, so the string
can be parsed back without a side table.  Texts that stand side by side are
escaped as one, as a control string may run across their border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import let

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: opening character, escapes so far, and what makes it a control string: ours (<|) and the common marks of other templates
_CONTROL = r"(<|\[)(\\*)(\||/?s>|/?INST\])"
_ESCAPED = r"(<|\[)\\(\\*)(\||/?s>|/?INST\])"
PLACEHOLDER = r"<\|(image|audio|document):\d+\|>"

#: tokens that one unit of an attachment expands to: image patches of 28 x 28 pixels, audio seconds, document pages
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 600

PART = ("struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")


def escape(text: Column) -> Column:
    """No control string is left: one backslash goes behind the opening character (one more if there are some)."""
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _whole(x: Column) -> Column:
    return F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)).cast("long")


def _image(p: Column) -> Column:
    return F.ceil(_whole(p["width"]) / PATCH) * F.ceil(_whole(p["height"]) / PATCH)


def _audio(p: Column) -> Column:
    return F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_RATE)


def _document(p: Column) -> Column:
    return _whole(p["pages"]) * PAGE_TOKENS


ATTACHMENTS = {"image": _image, "audio": _audio, "document": _document}


def visit(p: Column, number: Column) -> Column:
    """One part -> (piece, type, ref, tokens): a piece of the body (texts not yet escaped), and what an attachment leaves behind.

    Null or unknown types count as text; a null text is empty.
    """
    kind = F.coalesce(p["type"], F.lit("text"))
    piece, tokens = F.coalesce(p["text"], F.lit("")), F.lit(0).cast("long")
    for name, expand in ATTACHMENTS.items():
        piece = F.when(kind == name, F.concat(F.lit(f"<|{name}:"), number.cast("string"), F.lit("|>"))).otherwise(piece)
        tokens = F.when(kind == name, expand(p).cast("long")).otherwise(tokens)
    return F.struct(piece.alias("piece"), F.when(kind.isin(*ATTACHMENTS), kind).alias("type"), p["ref"].alias("ref"), tokens.alias("tokens"))


def text_parts(text: Column) -> Column:
    """A plain message as parts: one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
                            F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def flatten_message(parts: Column) -> Column:
    """Array of visited parts, attachments numbered from 0 within the message."""
    def numbered(ps: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            ahead = F.size(F.filter(F.slice(ps, F.lit(1), i), lambda q: q["type"].isin(*ATTACHMENTS)))
            return visit(p, ahead)
        return F.transform(ps, one)
    return let(F.coalesce(parts, F.array().cast(f"array<{PART}>")), numbered)


def message_body(seen: Column) -> Column:
    """The visited parts as one string: placeholders as they are, each run of texts between them escaped as a whole."""
    none = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))

    def add(a: Column, s: Column) -> Column:
        text = F.struct(a["done"].alias("done"), F.concat(a["run"], s["piece"]).alias("run"))
        return F.when(s["type"].isNull(), text).otherwise(F.struct(F.concat(a["done"], escape(a["run"]), s["piece"]).alias("done"), F.lit("").alias("run")))
    return F.aggregate(seen, none, add, lambda a: F.concat(a["done"], escape(a["run"])))


def format_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) -> (conv_id, formatted, attachments, expanded_tokens).

    Turns sort by turn (null first), then role, then the text before it is escaped, so ties have one
    order; null roles are empty; a null conv_id is a conversation of its own.
    Other columns are left out.  A conversation is one string, hence one group;
    its rows are formatted before they are gathered.
    """
    rows = messages.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), flatten_message(F.col("parts")).alias("seen"))
    body = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY), message_body(F.col("seen")), F.lit(END))
    found = F.transform(F.filter("seen", lambda s: s["type"].isNotNull()),
                        lambda s: F.struct(F.col("turn").alias("turn"), s["type"].alias("type"), s["ref"].alias("ref"), s["tokens"].alias("tokens")))
    raw = F.array_join(F.transform("seen", lambda s: s["piece"]), "")
    rows = rows.select("conv_id", "turn", "role", raw.alias("raw"), body.alias("body"), found.alias("found"))
    per = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "raw", "body", "found"))).alias("t"))
    per = per.select("conv_id", F.array_join(F.transform("t", lambda x: x["body"]), "").alias("formatted"),
                     F.flatten(F.transform("t", lambda x: x["found"])).alias("attachments"))
    return per.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def parse(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text, pieces of the raw body) read back from ``formatted`` alone.

    ``text`` is the body's text without placeholders, unescaped run by run.
    """
    def turn(chunk: Column) -> Column:
        both = F.split(F.regexp_replace(chunk, r"<\|end\|>$", ""), r"<\|body\|>", 2)
        return let(both, lambda b: F.struct(unescape(b[0]).alias("role"), F.array_join(F.transform(F.split(b[1], PLACEHOLDER, -1), unescape), "").alias("text"),
                                            b[1].alias("body")))
    chunks = F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda c, i: i > 0)  # nothing stands before the first mark
    return formatted.withColumn("turns", F.transform(chunks, turn))


def loss_spans(parsed: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Add ``loss``: the texts under the loss mask (those of the trained roles), in order."""
    return parsed.withColumn("loss", F.transform(F.filter("turns", lambda t: t["role"].isin(*trained)), lambda t: t["text"]))
