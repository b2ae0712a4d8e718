"""Conversation history: an ordered array of {role, content} messages.

Stored at the edge as a JSON string; inside Spark always a typed array so every
operation stays a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelake.functions.text import _c

MESSAGE = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
HISTORY = T.ArrayType(MESSAGE)


def message(role, content) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), _c(content).alias("content"))


def parse_history(c) -> Column:
    """JSON text -> array; null, empty or malformed text -> empty array."""
    return F.coalesce(F.from_json(_c(c), HISTORY), F.array().cast(HISTORY))


def history_json(h) -> Column:
    return F.to_json(_c(h))


def last_user_message(h) -> Column:
    """Content of the last message whose role is ``user`` (null when none)."""
    users = F.filter(_c(h), lambda m: m["role"] == "user")
    return F.try_element_at(users, F.lit(-1))["content"]


def last_n(h, n: int) -> Column:
    """The last ``n`` messages (all of them when fewer)."""
    arr = _c(h)
    return F.slice(arr, F.greatest(F.size(arr) - F.lit(n - 1), F.lit(1)), F.lit(n))


def append_pair(h, user, reply) -> Column:
    return F.concat(_c(h), F.array(message("user", user), message("assistant", reply)))
