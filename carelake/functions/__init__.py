"""Column -> Column functions.  All are built-in expressions."""

from carelake.functions.text import (  # noqa: F401
    basename, display_name, extension, extension_or_name, make_valid_text, normalize_email,
    output_key, pystrip, safe_filename, truncate_text, upload_key, utc_minute_text,
)
from carelake.functions.outreach import (  # noqa: F401
    build_message, classify_command, first_filled, message_name, money_text,
    normalize_headers, normalize_phone, patient_name,
)
from carelake.functions.history import (  # noqa: F401
    HISTORY, MESSAGE, append_pair, history_json, last_n, last_user_message, parse_history,
)
