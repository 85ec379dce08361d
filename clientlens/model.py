"""Parameters shared by every operator: date windows, slices and the code tables."""

from __future__ import annotations

import calendar
from dataclasses import dataclass
from datetime import date

# Fixed values. Each is the default of a parameter, never a constant inside a query.

TRANSFERRED = 3
CANCELLED = 1
LOST = 2
ENQUIRY_STATUS = {0: "Open", 1: "Cancel", 2: "Lost", 3: "Transfer", 4: "Confirmed", 5: "BID Enquiry"}
ENQUIRY_TYPE = {1: "Project", 2: "Annual Contract", 3: "Shutdown", 4: "Callout", 5: "Tender"}

EXCLUDED_SECTOR = 5
SECTORS = {1: "industrial", 2: "marine", 3: "oilgas", 6: "offshore", 10: "petrochemical", 12: "renewable"}

BLACKLISTED_STATUS = (6,)
CLOSED_STATUS = (2, 4, 11, 12)
CRITICAL_CATEGORY = 2

GCC_COUNTRIES = (1, 5, 16, 2, 3, 4)

DIVISION_NAMES = {225: "I&M", 3: "ONE"}
OTHER_GROUP = "Other"
NON_MARINE_GROUP = "Non Marine"

CUSTOMER_PAYMENT = 12
HIGH_VALUE = 500_000
LIFECYCLE_FLOOR = date(2020, 1, 1)


def months_before(day: date, months: int) -> date:
    """The same day of the month `months` earlier, or the last day of a shorter month."""
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    return date(year, month + 1, min(day.day, calendar.monthrange(year, month + 1)[1]))


@dataclass(frozen=True)
class Windows:
    """The lifecycle windows of one reporting day; both ends of each are named here once."""

    as_of: date
    active_months: int = 12
    inactive_months: int = 36
    floor: date = LIFECYCLE_FLOOR
    # the window of invoice figures, where it is not the active one
    job_day: date | None = None
    job_months: int | None = None

    @property
    def active_from(self) -> date:
        return months_before(self.as_of, self.active_months)

    @property
    def active_to(self) -> date:
        return self.as_of

    @property
    def inactive_from(self) -> date:
        return months_before(self.as_of, self.inactive_months)

    @property
    def inactive_to(self) -> date:
        return self.active_from

    @property
    def lost_to(self) -> date:
        return self.inactive_from

    @property
    def previous_from(self) -> date:
        return months_before(self.as_of, 2 * self.active_months)

    @property
    def previous_to(self) -> date:
        return self.active_from

    @property
    def job_from(self) -> date:
        return months_before(self.job_to, self.job_months or self.active_months)

    @property
    def job_to(self) -> date:
        return self.job_day or self.as_of

    @property
    def previous_job_from(self) -> date:
        return months_before(self.job_to, 2 * (self.job_months or self.active_months))

    @property
    def previous_job_to(self) -> date:
        return self.job_from


@dataclass(frozen=True)
class Slice:
    """Five optional equality filters; `None` leaves a dimension open."""

    division: int | None = None
    subdivision: int | None = None
    country: int | None = None
    region: int | None = None
    sector: int | None = None

    def only(self, *names: str) -> "Slice":
        """The same slice with every dimension but the named ones left open."""
        return Slice(**{name: getattr(self, name) for name in names})

    def is_open(self) -> bool:
        return self == NO_SLICE


NO_SLICE = Slice()
