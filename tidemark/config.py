"""One configuration object for environment, flags and API."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field, fields

from .operators.snapshot import ROWS_PER_FILE

PREFIX = "TIDEMARK_"


def split_tables(text: str) -> list[str]:
    return [x for part in text.split(",") if (x := part.strip())]


def truth(raw: object) -> bool:
    return raw if isinstance(raw, bool) else str(raw).strip().lower() in ("1", "t", "true", "yes", "on")


def mask_url(url: str) -> str:
    return re.sub(r"(://[^:/@]+:)[^@]*@", r"\1***@", url)


@dataclass
class Config:
    source_url: str = ""
    root: str = ""
    slot_name: str = "tidemark"
    publication: str = ""
    merge_on_read: bool = False
    parallel_tables: int = 4
    flush_rows: int = 10_000
    flush_interval: float = 2
    rows_per_file: int = ROWS_PER_FILE
    include_tables: list[str] = field(default_factory=list)
    exclude_tables: list[str] = field(default_factory=list)
    listen_addr: str = ":5433"
    log_level: str = "info"

    @classmethod
    def load(cls, env: dict[str, str] | None = None, **flags) -> Config:
        """Environment first, flags over it."""
        env, found = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = flags[f.name] if flags.get(f.name) is not None else env.get(PREFIX + f.name.upper())
            if raw is not None:
                found[f.name] = split_tables(raw) if f.name.endswith("_tables") and isinstance(raw, str) else truth(raw) if isinstance(f.default, bool) else type(f.default)(raw) if isinstance(f.default, (int, float, str)) else raw
        return cls(**found)

    def validate(self) -> None:
        wrong = [f"{n} is required" for n in ("source_url", "root") if not getattr(self, n)]
        wrong += ["include_tables and exclude_tables exclude each other"] * bool(self.include_tables and self.exclude_tables)
        wrong += [f"{n} must be positive" for n in ("flush_rows", "flush_interval", "parallel_tables") if getattr(self, n) <= 0]
        wrong += ["rows_per_file must not be negative"] * (self.rows_per_file < 0)
        if wrong:
            raise ValueError("; ".join(wrong))

    def validate_query(self) -> None:
        if not self.root:
            raise ValueError("root is required")
