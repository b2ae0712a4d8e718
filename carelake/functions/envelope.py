"""Inbound-message envelopes: a notification wrapper whose ``Records[i].Sns.Message``
holds the message JSON as text, or the bare message object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions.text import _c, pystrip

INBOUND_FIELDS = T.StructType([
    T.StructField("originationNumber", T.StringType()),
    T.StructField("destinationIdentity", T.StringType()),
    T.StructField("messageBody", T.StringType()),
])
ENVELOPE = T.StructType([
    T.StructField("Records", T.ArrayType(T.StructType([
        T.StructField("Sns", T.StructType([T.StructField("Message", T.StringType())]))]))),
    *INBOUND_FIELDS.fields,
])


def parse_envelope(df: DataFrame, raw: str = "raw", id_cols: Sequence[str] = ()) -> DataFrame:
    """One row per record: ``(id..., rec, phone, body)``.

    Every record is handled (not only the first).  A record whose message is not
    valid JSON yields empty phone and body; the sender is ``originationNumber``,
    else ``destinationIdentity``.  A bare message counts as one record.  One pass
    over the input: both shapes become a list of messages, exploded once.
    """
    # parsed once, in a projection of its own: the fields below only refer to it
    df = df.select(*id_cols, F.from_json(F.col(raw), ENVELOPE).alias("_env"))
    env = F.col("_env")
    wrapped = F.transform(env["Records"], lambda r: F.from_json(r["Sns"]["Message"], INBOUND_FIELDS))
    bare = F.array(F.struct(*[env[f.name].alias(f.name) for f in INBOUND_FIELDS.fields]))
    msgs = F.when(env["Records"].isNotNull(), wrapped).otherwise(bare)
    exploded = df.select(*id_cols, F.posexplode_outer(msgs).alias("_pos", "_m"))
    phone = F.coalesce(F.nullif(F.col("_m.originationNumber"), F.lit("")),
                       F.nullif(F.col("_m.destinationIdentity"), F.lit("")), F.lit(""))
    body = F.coalesce(F.col("_m.messageBody"), F.lit(""))
    return exploded.select(*id_cols, (F.coalesce(F.col("_pos"), F.lit(0)) + 1).cast("int").alias("rec"),
                           pystrip(phone).alias("phone"), pystrip(body).alias("body"))


def envelope_json(kind, phone, body) -> Column:
    """Test envelopes by kind: view -> bare object; signup -> malformed message;
    error -> two records; anything else -> one wrapped record."""
    msg = F.to_json(F.struct(_c(phone).alias("originationNumber"), _c(body).alias("messageBody")))
    msg2 = F.to_json(F.struct(_c(phone).alias("originationNumber"),
                              F.concat(F.lit("second "), _c(body)).alias("messageBody")))

    def rec(m):
        return F.struct(F.struct(m.alias("Message")).alias("Sns"))

    k = _c(kind)
    return (F.when(k == "view", F.to_json(F.struct(_c(phone).alias("destinationIdentity"),
                                                   _c(body).alias("messageBody"))))
             .when(k == "signup", F.to_json(F.struct(F.array(rec(F.lit("not json"))).alias("Records"))))
             .when(k == "error", F.to_json(F.struct(F.array(rec(msg), rec(msg2)).alias("Records"))))
             .otherwise(F.to_json(F.struct(F.array(rec(msg)).alias("Records")))))
