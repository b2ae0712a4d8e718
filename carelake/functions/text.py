"""String, key and time helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() removes every character for which str.isspace() is true;
# Spark's trim() removes spaces only.  Fixed value: the isspace() set.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")

# Characters allowed in a stored file name; everything else becomes "_".
_UNSAFE_RE = "[^a-zA-Z0-9.\\-_]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pystrip(c) -> Column:
    """Strip leading/trailing whitespace the way Python's ``str.strip`` does
    (a character-set trim: no regular expression per row)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def basename(key) -> Column:
    """Last path segment; the whole key when that segment is empty."""
    last = F.element_at(F.split(_c(key), "/"), -1)
    return F.when(last == "", _c(key)).otherwise(last)


def extension(name) -> Column:
    """Lower-case text after the last dot, '' without a dot (ingest rule)."""
    return F.regexp_extract(F.lower(_c(name)), r"\.([^.]*)$", 1)


def extension_or_name(name) -> Column:
    """Lower-case text after the last dot, the whole lower-cased name without one
    (question-answering rule)."""
    low = F.lower(_c(name))
    return F.when(F.instr(low, ".") > 0, F.regexp_extract(low, r"\.([^.]*)$", 1)).otherwise(low)


def safe_filename(name) -> Column:
    return F.regexp_replace(pystrip(_c(name)), _UNSAFE_RE, "_")


def upload_key(user, ts, name) -> Column:
    """``uploads/user_id={user}/year={YYYY}/month={MM}/{safe name}`` (UTC)."""
    return F.concat(
        F.lit("uploads/user_id="), pystrip(_c(user)),
        F.lit("/year="), F.date_format(_c(ts), "yyyy"),
        F.lit("/month="), F.date_format(_c(ts), "MM"),
        F.lit("/"), safe_filename(name),
    )


def output_key(key, prefix: str = "parquet/") -> Column:
    """``uploads/a/b.csv`` -> ``parquet/a/b.csv.parquet``."""
    return F.concat(F.lit(prefix), F.regexp_replace(_c(key), "^uploads/", ""), F.lit(".parquet"))


def truncate_text(c, n: int, marker: str = "") -> Column:
    """Cut to ``n`` characters; append ``marker`` only when something was cut."""
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(marker))).otherwise(col)


def utc_minute_text(c) -> Column:
    return F.date_format(_c(c), "yyyy-MM-dd HH:mm 'UTC'")


def normalize_email(c) -> Column:
    return F.lower(pystrip(_c(c)))


def display_name(email) -> Column:
    return F.substring_index(_c(email), "@", 1)


def make_valid_text(content) -> Column:
    """Binary -> UTF-8 text, malformed sequences replaced by U+FFFD."""
    return F.make_valid_utf8(_c(content).cast("string"))


def named(name: str) -> Column:
    """The column of exactly this name, whatever signs it has (dots, blanks, backticks)."""
    return F.col("`" + name.replace("`", "``") + "`")
