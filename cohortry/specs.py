"""Parameters of a cohort study. Plain dataclasses: no environment variables, no globals to patch."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class WindowSpec:
    """Inclusive windows over an integer period index, relative to a subject's first event ``t0``."""

    early: int = 5
    late: int = 15
    observed_until: int = 2001 * 4 + 3
    first_valid: int = 1950 * 4
    max_span: int = 60


@dataclass(frozen=True)
class CohortSpec:
    windows: WindowSpec = field(default_factory=WindowSpec)
    min_events: int = 3
    min_source_events: int = 3
    min_score: float = 0.3
    tags_per_event: int = 3
    top_k: int = 10
    theta: float = 0.2

    def with_(self, **changes) -> "CohortSpec":
        return replace(self, **changes)


@dataclass(frozen=True)
class DatasetSpec:
    """One dataset switch: which field (partition value) a job reads and writes, and its pinned fingerprint."""

    field_name: str
    root: str
    pinned_fingerprint: str | None = None

    def table(self, name: str) -> str:
        return f"{self.root}/{name}/field={self.field_name}"


@dataclass(frozen=True)
class FeatureSpec:
    """An ordered feature list. ``banned`` names may never be asked for; booleans become doubles."""

    numeric: tuple[str, ...] = (
        "early_prod", "early_breadth", "source_prod", "source_breadth",
        "source_age", "early_overlap", "t0",
    )
    boolean: tuple[str, ...] = ("interacted",)
    banned: frozenset[str] = frozenset({"y", "late_overlap", "late_prod", "late_tags", "h_index"})

    def columns(self, drop: tuple[str, ...] = ()) -> list[str]:
        cols = [c for c in self.numeric + self.boolean if c not in set(drop)]
        bad = sorted(set(cols) & self.banned)
        if bad:
            raise ValueError(f"banned features requested: {bad}")
        return cols
