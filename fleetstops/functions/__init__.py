from .cleaning import (
    drop_last_char,
    empty_to_null_double,
    empty_to_null_double_lenient,
    make_point,
    parse_report_time,
    strip_header,
    substring_tail,
    truncate_text,
)
from .time import (
    display_time,
    empty_if_null,
    epoch_micros,
    floor_div,
    hour_of_day,
    look_back_start,
    minutes_stopped,
    minutes_to_seconds,
    stop_length_rounded,
    stop_length_seconds,
    stop_length_trunc,
)
