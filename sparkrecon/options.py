"""Options of the engine: plain frozen dataclasses, safe to ship in closures."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

INDEXED = "indexed"
FIRST_MATCH = "first_match"

# Fields that identify the person a record belongs to. They are
# expected to differ between two schemas and take no part in the comparison.
ENTITY_FIELDS = ("employee_id", "contractor_id")

# File endings that hold dumps.
DUMP_EXTENSIONS = ("docx", "sql", "txt")

# Fixed value: at most this many detail rows per table and class stand in the
# nested document of a table, which says whether it was cut. Details written row
# by row are never cut.
DETAIL_CAP = 100

# Keys of configuration files that belong to parts that are not
# built (see the README) or that Spark decides itself.
FOREIGN_KEYS = (
    "batch_size", "chromadb_path", "chunk_overlap", "chunk_size", "dest-schema",
    "embedding_model", "ge_dir", "source-schema",
)


@dataclass(frozen=True)
class ReconOptions:
    """How two sides of a table are reconciled.

    ``mode``
        ``indexed``: every destination row meets the *last* source row of its
        key. ``first_match``: every source row meets the *first* destination
        row of its key; the other destination rows are extra.
    ``exclude_fields``
        Fields left out of the comparison (``indexed`` only).
    ``null_token``
        Text a null key turns into, so null keys equal each other.
    ``compat_empty_side``
        ``False`` classifies everything as missing/extra if one side is empty;
        ``True`` leaves those rows unclassified and the table successful.
    ``skew``
        ``auto`` looks for hot keys if the side that keeps its duplicates is
        larger than ``skew_min_bytes``; ``always`` and ``never`` force it.
    """

    mode: str = INDEXED
    exclude_fields: tuple[str, ...] = ENTITY_FIELDS
    null_token: str = "None"
    compat_empty_side: bool = False
    skew: str = "auto"
    skew_min_bytes: int = 4 << 30
    skew_min_rows: int = 1_000_000

    def __post_init__(self) -> None:
        if self.mode not in (INDEXED, FIRST_MATCH):
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.skew not in ("auto", "always", "never"):
            raise ValueError(f"unknown skew setting {self.skew!r}")


@dataclass(frozen=True)
class IngestOptions:
    """How dump files are read and parsed.

    ``split``
        ``file`` reads each file as one record, ``statement`` splits text files
        at ``;`` while reading, so that one large file feeds many tasks, and
        ``auto`` does so for files of more than ``whole_file_bytes``. Both give
        the same statements; one without ``;`` at the end does not count.
    ``quote_aware``
        ``True`` keeps a ``;`` inside a literal. A quote that no other one ends is a
        sign like any other.
    ``backslash_escapes``
        ``True`` lets a backslash protect the quote after it, ``False`` reads
        literals as in standard SQL, where only a doubled quote is one.
    The other switches choose between the corrected reading of a text dump
    (default) and the lenient historic one (:meth:`historic`).
    """

    split: str = "auto"
    whole_file_bytes: int = 8 << 20
    recursive: bool = False
    quote_aware: bool = False
    backslash_escapes: bool = True
    mixed_quotes: bool = True
    multiline_tuples: bool = True
    keep_empty_items: bool = True
    quoted_null_is_text: bool = True

    def __post_init__(self) -> None:
        if self.split not in ("auto", "file", "statement"):
            raise ValueError(f"unknown split {self.split!r}")

    @classmethod
    def historic(cls, **kwargs: Any) -> IngestOptions:
        """Any quote toggles the string state, tuples over several lines and
        empty unquoted items are dropped, and a quoted ``'NULL'`` is null."""
        return cls(
            mixed_quotes=False,
            multiline_tuples=False,
            keep_empty_items=False,
            quoted_null_is_text=False,
            **kwargs,
        )


@dataclass(frozen=True)
class RunOptions:
    """A whole validation run over two schemas of dump files.

    ``max_differences`` cuts the listing of a result, per table and class; details
    are whole in any case. ``document_rows`` cuts the nested documents of tables."""

    schemas: tuple[str, ...] = ()
    data_directory: str = ""
    schema_paths: dict[str, str] = field(default_factory=dict)
    source_files: tuple[str, ...] = ()
    dest_files: tuple[str, ...] = ()
    use_direct_comparison: bool = False
    max_differences: int | None = None
    document_rows: int = DETAIL_CAP
    run_expectations: bool = True
    report_directory: str | None = None
    chunk_store: str | None = None
    recon: ReconOptions | None = None
    ingest: IngestOptions = IngestOptions()

    @classmethod
    def from_dict(cls, raw: dict[str, Any]) -> RunOptions:
        """Options from plain values; ``recon`` and ``ingest`` may be dicts as well.
        Unknown names are an error, those of ``FOREIGN_KEYS`` are passed over."""
        picked = _known(cls, {k: v for k, v in raw.items() if k not in FOREIGN_KEYS})
        for name in ("schemas", "source_files", "dest_files"):
            picked[name] = tuple(picked.get(name) or ())
        for name, kind in (("recon", ReconOptions), ("ingest", IngestOptions)):
            if isinstance(picked.get(name), dict):
                inner = _known(kind, picked[name])
                listed = {k: tuple(v) for k, v in inner.items() if isinstance(v, list)}
                picked[name] = kind(**inner | listed)
        return cls(**picked)

    @classmethod
    def from_yaml(cls, path: str) -> RunOptions:
        import yaml

        with open(path, encoding="utf-8") as handle:
            return cls.from_dict(yaml.safe_load(handle) or {})

    def schema_pair(self) -> tuple[str, str]:
        """Direct comparison takes exactly two schemas, in source/destination order."""
        if len(self.schemas) != 2:
            raise ValueError(f"exactly two schemas are needed, got {len(self.schemas)}")
        return self.schemas[0], self.schemas[1]

    def directory_of(self, schema: str) -> str:
        """An explicit mapping wins over ``data_directory/schema``."""
        if schema in self.schema_paths:
            return self.schema_paths[schema]
        return f"{self.data_directory.rstrip('/')}/{schema}"

    @property
    def recon_options(self) -> ReconOptions:
        if self.recon is not None:
            return self.recon
        return ReconOptions(mode=INDEXED if self.use_direct_comparison else FIRST_MATCH)


def _known(kind: type, raw: dict[str, Any]) -> dict[str, Any]:
    unknown = sorted(set(raw) - {f.name for f in fields(kind)})
    if unknown:
        raise ValueError(f"unknown options of {kind.__name__}: {', '.join(unknown)}")
    return dict(raw)
