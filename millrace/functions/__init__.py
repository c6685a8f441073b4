from millrace.functions.scalar import (  # noqa: F401
    cap_at,
    complete_units,
    compact_whitespace,
    empty_safe_words,
    iso_timestamp,
    mean_of_rounded,
    month_start,
    percent,
    ratio,
    severity_score,
    upper_trim,
    with_json_fields,
)
