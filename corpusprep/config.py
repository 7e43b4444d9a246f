"""Operator parameters.

The settings object is plain data: its values become literals inside Column
expressions, so nothing here is evaluated per row.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace
from typing import Any


@dataclass(frozen=True)
class Settings:
    # image triage
    apply_max_res: bool = False
    max_image_res_px: int = 1200
    exclude_decorative: bool = False
    decorative_threshold_px: int = 50
    embed_small_images: bool = False
    small_image_threshold_kb: int = 50
    # tables
    max_rows_display: int | None = None       # a limit only where one is asked for; so the next three
    max_columns_display: int | None = None
    max_cell_chars: int | None = None
    max_name_chars: int | None = None
    part_rows: int = 10_000                   # order keys in a part of a table
    # converted documents
    pandoc_toc: bool = False
    # our own switches
    skip_temp_files: bool = True          # drop ~$x.xlsx etc. at discovery
    legacy_double_escape: bool = False    # CSV / workbook cells escaped twice
    converter_formats: bool = True        # extra formats of the external converter list

    @classmethod
    def from_dict(cls, values: dict[str, Any] | None) -> "Settings":
        """Known keys are taken, unknown keys are dropped."""
        values = values or {}
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def get(self, key: str, default: Any = None) -> Any:
        return getattr(self, key, default)

    def with_(self, **changes: Any) -> "Settings":
        return replace(self, **changes)


DEFAULT = Settings()
