"""Query parameters: the dashboard's filter dict as one frozen value.

Every date that the analyses derive (effective start, symmetric experiment
window, look-back horizons) is computed here in Python so that it reaches the
plan as a literal: literal bounds on ``date`` give static partition pruning
and Parquet row-group skipping.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from datetime import date, timedelta


def _d(v) -> date | None:
    if v is None or v == "" or v == "None":
        return None
    if isinstance(v, date):
        return v
    return date.fromisoformat(str(v))


@dataclass(frozen=True)
class Params:
    start: date
    end: date
    as_of: date
    test_start: date | None = None
    # list filters: None or empty means "no predicate"
    os: tuple[str, ...] | None = ("Apple", "Android")
    versions: tuple[float, ...] | None = None
    countries: tuple[str, ...] | None = None
    low_payers_only: bool = False
    exclude_testing_countries: bool = True
    exclude_first_purchase: bool = False
    # fixed business constants of the analyses
    version_floor: float = 0.3775
    excluded_countries: tuple[str, ...] = ("NATION_3", "NATION_7", "NATION_11")
    home_markets: tuple[str, ...] = ("AMERICA", "EUROPE")
    store_fee: float = 0.30
    promo_config_id: int = 5
    promo_days_back: int = 7
    # rows of a detail table; None: all of them
    detail_limit: int | None = None
    switcher_limit: int | None = None
    switch_since: date | None = None
    # behaviour switches; defaults reproduce the original analyses exactly
    fix_units: bool = False
    enrich_mode: str = "user"
    # apply the testing-country exclusion in every channel panel (originally
    # only the KPI, adoption and latency panels apply it)
    apply_exclusions_everywhere: bool = False
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self):
        for name in ("start", "end", "as_of", "test_start", "switch_since"):
            object.__setattr__(self, name, _d(getattr(self, name)))

    def replace(self, **kw) -> "Params":
        return dataclasses.replace(self, **kw)

    # --- derived dates ------------------------------------------------------

    @property
    def effective_start(self) -> date:
        """Later of start and test start, unless the test starts after the range."""
        ts = self.test_start
        if ts is None or ts > self.end:
            return self.start
        return ts if self.start < ts else self.start

    @property
    def experiment_window(self) -> tuple[date, date, date]:
        """Symmetric before/after window around the test start.

        Returns ``(range_start, test_start, range_end)`` where the before period
        has as many days as the after period (test start up to as_of).
        """
        ts = self.test_start or self.start
        n = (self.as_of - ts).days + 1
        return ts - timedelta(days=n), ts, self.as_of

    def days_before(self, n: int) -> date:
        return self.as_of - timedelta(days=n)


def default_params() -> Params:
    """Parameters of every oracle run (see FIXTURES.md)."""
    return Params(
        start=date(2024, 1, 1),
        end=date(2024, 1, 30),
        as_of=date(2024, 1, 30),
        test_start=date(2024, 1, 15),
        # the test binding keeps the promo config id at $.k of the snapshot
        extra={"promo_config_path": "$.k"},
    )


#: Values of the filter panel under which some keys run once more: lists, a single version, low-payer countries.
FILTERED = {"os": ("Apple",), "versions": (0.3776, 0.3779, 0.3781), "countries": tuple(f"NATION_{i}" for i in range(0, 25, 2))}
ONE_VERSION = {"versions": (0.3778,)}
LOW_PAYERS = {"low_payers_only": True, "apply_exclusions_everywhere": True}


def limited(rows: int | None):
    """For ``DataFrame.transform``: the first ``rows`` rows, all without a limit."""
    return lambda df: df if rows is None else df.limit(rows)
