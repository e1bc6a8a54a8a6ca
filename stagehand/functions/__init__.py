"""Native column expressions (no per-row Python)."""
from .casts import (blank, nonblank, nullif, safe_int, safe_double, safe_date,  # noqa: F401
                    safe_datetime, safe_rank, safe_rating, flag, int_nonblank,
                    truncate, rate, cast_kind)
from .literals import (parse_pair_list, parse_string_list, link_type_map,  # noqa: F401
                       LINK_COLUMN_TO_TYPE)
