"""Eligibility and recall predicates as one null-safe column each."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions import exprs as X

REMOTE_MODES = ("fully_remote", "remote_first")
US_SCOPES = ("us-only", "us-canada")


@dataclass(frozen=True)
class Eligibility:
    """Hard filters shared by the hull and the recall ranker; empty values filter nothing."""

    functions: tuple[str, ...] = ()
    levels: tuple[str, ...] = ()
    country: str = ""
    remote: bool = False
    min_comp: float = 0
    include_staffing: bool = False
    include_management: bool = False
    unknown_comp: str = "drop"  # or "keep": unstated salaries pass a floor

    def column(self) -> Column:
        parts = []
        if self.functions:
            parts.append(F.col("function").isin(*self.functions))
        if self.levels:
            parts.append(F.col("level").isin(*self.levels))
        if self.remote:
            parts.append(F.col("work_mode").isin(*REMOTE_MODES))
        if self.country:
            parts.append(in_country(self.country))
        if self.min_comp:
            parts.append(pays(F.col("salary_max_k"), self.min_comp, self.unknown_comp))
        if not self.include_staffing:
            parts.append(~X.flag(F.col("is_staffing")))
        if not self.include_management:
            parts.append(~X.flag(F.col("management")))
        return F.coalesce(X.all_of(parts) if parts else F.lit(True), F.lit(False))


@dataclass(frozen=True)
class HullConfig(Eligibility):
    """Adds the visa requirement and lexical recall on titles."""

    require_visa: bool = False
    titles: tuple[str, ...] = ()

    def column(self) -> Column:
        parts = [super().column()]
        if self.require_visa:
            parts.append(F.coalesce(F.col("visa_sponsorship") == "yes", F.lit(False)))
        if terms := X.terms_of(self.titles):
            parts.append(X.contains_any(F.col("title"), terms) | X.list_contains_any(F.col("alt_titles"), terms))
        return X.all_of(parts)


@dataclass(frozen=True)
class RecallConfig(Eligibility):
    """Adds the currency guard, and the seeds of the learned ranker."""

    seeds: tuple[str, ...] = ()
    case_fold: bool = False

    def objective(self) -> Column:
        """All filters but function and level, which label classes rather than restrict."""
        out = super().column()
        return out & in_dollars() if self.country.strip().upper() == "US" else out

    def column(self) -> Column:
        return self.objective()

    def haystack(self) -> Column:
        return X.haystack(F.col("title"), F.col("alt_titles"), F.col("skills"), F.col("sub_function"), self.case_fold)

    def is_seed(self) -> Column:
        return X.any_of([self.haystack().contains(s) for s in X.terms_of(self.seeds)])


def in_country(country: str) -> Column:
    """The code equals the country; for the US, a scope that covers it will do."""
    code = country.strip().upper()
    here = F.coalesce(F.col("country_code") == code, F.lit(False))
    return here | F.coalesce(F.col("remote_scope").isin(*US_SCOPES), F.lit(False)) if code == "US" else here


def pays(c: Column, floor: float, unknown: str = "drop") -> Column:
    """A stated amount of at least the floor; null, zero, NaN and -1 are unstated."""
    stated = X.amount(c)
    enough = stated >= float(floor)
    return enough | (stated <= 0) if unknown == "keep" else enough


def in_dollars() -> Column:
    return F.coalesce(F.nullif(F.col("salary_currency"), F.lit("")), F.lit("USD")) == "USD"
