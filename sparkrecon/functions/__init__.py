from sparkrecon.functions.rows import field_diff, map_text, row_hash, row_map
from sparkrecon.functions.text import (
    display_label,
    file_stem,
    match_percentage,
    norm_key,
    run_id,
    schema_from_filename,
    status_text,
    strip_text,
    title_text,
)

__all__ = [
    "display_label",
    "field_diff",
    "file_stem",
    "map_text",
    "match_percentage",
    "norm_key",
    "row_hash",
    "row_map",
    "run_id",
    "schema_from_filename",
    "status_text",
    "strip_text",
    "title_text",
]
