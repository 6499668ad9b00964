"""Job parameters with the bounds the tools declare (bounds are semantics)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime

DETAIL_LEVELS = ("summary", "standard", "full")
FORMATS = ("json", "markdown")

# Fixture clock (FIXTURES.md part B pins "now").
FIXTURE_AS_OF = datetime(2024, 1, 31, 0, 0, 0)


@dataclass(frozen=True)
class Weights:
    """Scoring constants; defaults are the reference values."""

    # Scoring weights and caps.
    frequency: float = 0.35
    severity: float = 0.35
    votes: float = 0.30
    convergence_boost: float = 2.0
    vote_share: float = 0.8
    comment_share: float = 0.2
    thread_unit: float = 10.0
    thread_cap: float = 50.0
    recency_peak: float = 30.0
    recency_days: float = 7.0
    severity_cap: float = 100.0


@dataclass(frozen=True)
class Params:
    as_of: datetime = FIXTURE_AS_OF
    timeframe_days: int = 30
    top_voted_limit: int = 50
    mailbox_id: int | None = None
    mailbox_name: str | None = None
    portal_name: str | None = None
    detail_level: str = "summary"
    max_priorities: int = 5
    kpi_context: str | None = None
    include_comments: bool = True
    status: str | None = None
    fmt: str = "json"
    weights: Weights = field(default_factory=Weights)
    # live postings below which the emerging loop stops checkpointing each round
    emerging_checkpoint_every: int = 1

    def __post_init__(self) -> None:
        if not 1 <= self.timeframe_days <= 90:
            raise ValueError("timeframe_days must be within 1..90")
        if not 1 <= self.top_voted_limit <= 200:
            raise ValueError("top_voted_limit must be within 1..200")
        if not 1 <= self.max_priorities <= 10:
            raise ValueError("max_priorities must be within 1..10")
        if self.detail_level not in DETAIL_LEVELS:
            raise ValueError(f"detail_level must be one of {DETAIL_LEVELS}")
        if self.fmt not in FORMATS:
            raise ValueError(f"fmt must be one of {FORMATS}")

    def with_(self, **kw) -> "Params":
        return replace(self, **kw)

    # An empty string means "no filter" for mailbox, portal and status.
    @property
    def portal(self) -> str | None:
        return self.portal_name or None

    @property
    def status_filter(self) -> str | None:
        return self.status or None
