"""Patient-row normalisation, message templates and inbound command rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from carelake.functions.text import _c, pystrip

# Opt-out / help / opt-in keywords recognised in an inbound text.
STOP_WORDS = ("STOP", "STOPALL", "UNSUBSCRIBE", "CANCEL", "END", "QUIT")
HELP_WORDS = ("HELP",)
START_WORDS = ("START", "UNSTOP")

# The two outreach templates.  {name}, {amount}, {phone}, {clinic}
# are filled per row; contact number and clinic name are parameters.
BALANCE_TEMPLATE = ("Hi %s, you have an outstanding bill amount due of $%s. "
                    "Call %s at your convenience. Reply STOP to opt out.")
WELLNESS_TEMPLATE = ("Hi %s, this is a reminder to schedule your Annual Wellness Visit. "
                     "Please call %s at %s. Reply STOP to opt out.")
DEFAULT_OFFICE_PHONE = "555-0100"
DEFAULT_CLINIC = "Example Clinic"

# A plain decimal numeral (optional sign, optional fraction, surrounding space).
_NUMERAL_RE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)\s*$"


def normalize_phone(c) -> Column:
    """ASCII digits only; 10 digits -> +1..., 11 starting with 1 -> +..., else null."""
    digits = F.regexp_replace(_c(c).cast("string"), "[^0-9]", "")
    n = F.length(digits)
    return (F.when(n == 10, F.concat(F.lit("+1"), digits))
             .when((n == 11) & digits.startswith("1"), F.concat(F.lit("+"), digits)))


def money_text(c) -> Column:
    """Amount as text with two decimals; missing/''/0 -> 0.00; unparsable -> stripped original."""
    raw = _c(c).cast("string")
    missing = raw.isNull() | (raw == "")
    cleaned = F.regexp_replace(raw, ",", "")
    parsed = F.when(cleaned.rlike(_NUMERAL_RE), pystrip(cleaned).try_cast("decimal(18,2)"))
    return (F.when(missing, F.lit("0.00"))
             .when(parsed.isNotNull(), parsed.cast("string"))
             .otherwise(pystrip(raw)))


def patient_name(first, last) -> Column:
    """``first last`` stripped; '' when both are blank (stored form)."""
    f = F.coalesce(pystrip(_c(first)), F.lit(""))
    l_ = F.coalesce(pystrip(_c(last)), F.lit(""))
    return pystrip(F.concat(f, F.lit(" "), l_))


def message_name(first, last) -> Column:
    """Name used inside a message: the stored name, or ``Patient`` when blank."""
    return F.coalesce(F.nullif(patient_name(first, last), F.lit("")), F.lit("Patient"))


def build_message(name, amount, message_type, office_phone: str = DEFAULT_OFFICE_PHONE,
                  clinic: str = DEFAULT_CLINIC) -> Column:
    """``balance`` -> bill reminder; any other type -> wellness reminder."""
    balance = F.format_string(BALANCE_TEMPLATE, _c(name), money_text(amount), F.lit(office_phone))
    wellness = F.format_string(WELLNESS_TEMPLATE, _c(name), F.lit(clinic), F.lit(office_phone))
    return F.when(F.coalesce(_c(message_type) == "balance", F.lit(False)), balance).otherwise(wellness)


def first_filled(*cols) -> Column:
    """First argument that is neither null nor '' ; '' when none is."""
    return F.coalesce(*[F.nullif(_c(x), F.lit("")) for x in cols], F.lit(""))


def classify_command(phone, body) -> Column:
    """ignore | stop | help | start | message."""
    p = F.coalesce(pystrip(_c(phone)), F.lit(""))
    b = F.coalesce(pystrip(_c(body)), F.lit(""))
    u = F.upper(b)
    return (F.when((p == "") | (b == ""), F.lit("ignore"))
             .when(u.isin(*STOP_WORDS), F.lit("stop"))
             .when(u.isin(*HELP_WORDS), F.lit("help"))
             .when(u.isin(*START_WORDS), F.lit("start"))
             .otherwise(F.lit("message")))


def normalize_headers(cells) -> Column:
    """Header cells lower-cased and stripped; a null header becomes ''."""
    return F.transform(_c(cells), lambda x: F.coalesce(F.lower(pystrip(x)), F.lit("")))
