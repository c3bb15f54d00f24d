"""Column-expression helpers (all JVM-side, codegen friendly)."""

from fleetlog.functions.text import (  # noqa: F401
    strip_ws, ts_text, iso_text, parse_iso_timestamp, parse_number, epoch_micros,
    round6, exact_sum, fixed, py_float,
)
from fleetlog.functions.calendar import (  # noqa: F401
    month_start, month_end_label, month_bounds, resolve_range, normalize_boundary,
    parse_boundary, Period,
)
