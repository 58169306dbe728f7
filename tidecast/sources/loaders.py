"""Readers of panels: macro CSV layouts, user CSV and Parquet, single series, vintages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators._base import DATE
from ..operators.panel import DataBundle, as_panel, combine


class RawDataError(Exception):
    """Anything wrong with a raw file."""


class RawParseError(RawDataError):
    """The file is not in the expected layout."""


class RawVersionFormatError(RawDataError):
    """A vintage is not written as YYYY-MM."""


class RawVersionUnavailableError(RawDataError):
    """There is no file of that vintage."""


class RawDownloadError(RawDataError):
    """A file could not be fetched."""


class RawNetworkError(RawDownloadError):
    """The network did not answer."""


class RawManifestError(RawDataError):
    """A manifest cannot be read or does not match its files."""


class VintageUnavailableError(RawDataError):
    """No vintage at or before the origin."""


#: Named groups of states.
_DIVISIONS = {
    "new_england": "CT ME MA NH RI VT", "middle_atlantic": "NJ NY PA", "east_north_central": "IL IN MI OH WI", "west_north_central": "IA KS MN MO NE ND SD",
    "south_atlantic": "DE DC FL GA MD NC SC VA WV", "east_south_central": "AL KY MS TN", "west_south_central": "AR LA OK TX",
    "mountain": "AZ CO ID MT NV NM UT WY", "pacific": "AK CA HI OR WA",
}
_REGIONS = {
    "northeast": ("new_england", "middle_atlantic"), "midwest": ("east_north_central", "west_north_central"),
    "south": ("south_atlantic", "east_south_central", "west_south_central"), "west": ("mountain", "pacific"),
}
STATE_GROUPS: dict[str, tuple[str, ...]] = {
    **{f"census_division_{k}": tuple(v.split()) for k, v in _DIVISIONS.items()},
    **{f"census_region_{k}": tuple(s for d in v for s in _DIVISIONS[d].split()) for k, v in _REGIONS.items()},
    "contiguous_48_plus_dc": tuple(sorted({s for v in _DIVISIONS.values() for s in v.split()} - {"AK", "HI"})),
}
#: Named groups of state series.
VARIABLE_GROUPS: dict[str, tuple[str, ...]] = {
    "labor_market_core": ("ICLAIMS", "LF", "NA", "PARTRATE", "UR"), "employment_sector": ("CONS", "FIRE", "GOVT", "INFO", "MFG", "MFGHRS", "MINNG", "PSERV"),
    "gsp_output": ("NQGSP", "CONSTNQGSP", "FIRENQGSP", "GOVNQGSP", "INFONQGSP", "MANNQGSP", "NATURNQGSP", "PSERVNQGSP", "UTILNQGSP"),
    "housing": ("BPPRIVSA", "RENTS", "STHPI"), "trade": ("EXPORTS", "IMPORTS"), "income": ("OTOT",),
}


def _group(name: str | None, groups: Mapping[str, tuple[str, ...]], everything: str, custom: Sequence[str] | None) -> list[str] | None:
    if custom is not None:
        members = [c.strip() for c in custom]
        if not members or not all(members):
            raise ValueError("a group of one's own names its members")
        return members
    if name in (None, everything):
        return None
    if name not in groups:
        raise ValueError(f"unknown group {name}; one of {sorted(groups)}")
    return list(groups[name])


def resolve_fred_sd_state_group(group: str | None = None, members: Sequence[str] | None = None) -> list[str] | None:
    """States of a named group, or of one's own; None: all."""
    own = None if members is None else [m.upper() for m in members]
    return _group(group, STATE_GROUPS, "all_states", own)


def resolve_fred_sd_variable_group(group: str | None = None, members: Sequence[str] | None = None) -> list[str] | None:
    return _group(group, VARIABLE_GROUPS, "all_sd_variables", members)


def select_state_panel(panel: DataFrame, states: Sequence[str] | None = None, variables: Sequence[str] | None = None) -> DataFrame:
    """Columns ``<variable>_<state>`` of the asked states and variables."""
    keep = [c for c in panel.columns if c != DATE and (states is None or c.rsplit("_", 1)[-1] in states) and (variables is None or c.rsplit("_", 1)[0] in variables)]
    return panel.select(DATE, *keep)


def parse_version(version: str) -> tuple[int, int]:
    part = version.split("-")
    if len(part) != 2 or not all(p.isdigit() for p in part) or len(part[0]) != 4 or not 1 <= int(part[1]) <= 12:
        raise RawVersionFormatError(f"{version!r} is not YYYY-MM")
    return int(part[0]), int(part[1])


def _code_row(cells: Sequence[str]) -> bool:
    """A row of transformation codes: small whole numbers, the first cell free."""
    body = [c.strip() for c in cells[1:] if c.strip()]
    return bool(body) and all(c.replace(".0", "").isdigit() and 1 <= int(float(c)) <= 7 for c in body)


def load_macro_csv(spark: SparkSession, path: str, date_format: str = "M/d/yyyy") -> DataBundle:
    """A header row and a transformation-code row in either order, then data.

    Only the first two lines come to the driver; dates that do not parse are an error.
    """
    first = [r["value"] for r in spark.read.text(path).limit(2).collect()]
    if len(first) < 2:
        raise RawParseError("fewer than two lines")
    rows = [line.split(",") for line in first]
    header, codes = (rows[1], rows[0]) if _code_row(rows[0]) else (rows[0], rows[1] if _code_row(rows[1]) else None)
    names = [c.strip().strip('"') for c in header]
    raw = spark.read.csv(path, header=False, schema=", ".join(f"`_{i}` string" for i in range(len(names))))
    data = raw.where(~F.trim("_0").isin(header[0].strip(), codes[0].strip() if codes else header[0].strip(), "Transform:") & (F.trim("_0") != ""))
    date = F.coalesce(F.expr(f"try_to_date(trim(_0), '{date_format}')"), F.expr("try_to_date(trim(_0), 'yyyy-MM-dd')"))
    panel = data.select(date.alias(DATE), *[F.expr(f"try_cast(`_{i}` as double)").alias(n) for i, n in enumerate(names) if i])
    bad = panel.where(F.col(DATE).isNull()).limit(1).count()
    if bad:
        raise RawParseError("dates that do not parse")
    tcodes = {n: int(float(c)) for n, c in zip(names[1:], codes[1:]) if c.strip()} if codes else {}
    return DataBundle(panel, {"tcodes": tcodes, "source": path})


load_fred_md = load_fred_qd = load_macro_csv


def load_series_csv(spark: SparkSession, path: str, name: str) -> DataBundle:
    """Two columns: date and value; a dot is a missing value."""
    raw = spark.read.csv(path, header=True)
    d, v = raw.columns[:2]
    return DataBundle(raw.select(F.to_date(d).alias(DATE), F.expr(f"try_cast(`{v}` as double)").alias(name)), {"source": path})


load_fred_series = load_series_csv


def load_custom_csv(spark: SparkSession, path: str, date: str = DATE, columns: Sequence[str] | None = None, rename: Mapping[str, str] | None = None) -> DataBundle:
    return DataBundle(as_panel(spark.read.csv(path, header=True), date, columns, rename), {"source": path})


def load_custom_parquet(spark: SparkSession, path: str, date: str = DATE, columns: Sequence[str] | None = None, rename: Mapping[str, str] | None = None) -> DataBundle:
    return DataBundle(as_panel(spark.read.parquet(path), date, columns, rename), {"source": path})


def load_state_panel(spark: SparkSession, path: str, states: Sequence[str] | None = None, variables: Sequence[str] | None = None) -> DataBundle:
    """Columns ``VARIABLE_STATE`` to a long panel (variable, state, date, value)."""
    raw = spark.read.csv(path, header=True)
    names = [c for c in raw.columns if "_" in c]
    names = [c for c in names if (not states or c.rsplit("_", 1)[1] in states) and (not variables or c.rsplit("_", 1)[0] in variables)]
    wide = raw.select(F.to_date(raw.columns[0]).alias(DATE), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in names])
    long = wide.unpivot([DATE], names, "name", "value")
    return DataBundle(
        long.select(F.regexp_extract("name", "^(.*)_([^_]+)$", 1).alias("variable"), F.regexp_extract("name", "^(.*)_([^_]+)$", 2).alias("state"), DATE, "value"), {"source": path}
    )


load_fred_sd = load_state_panel


def combine_bundles(*bundles: DataBundle) -> DataBundle:
    return DataBundle(combine(*[b.panel for b in bundles]), {"sources": [b.metadata.get("source") for b in bundles]})


def vintages_from_wide(frame: DataFrame, vintage: str, date: str, columns: Sequence[str]) -> DataFrame:
    """Grouped-wide vintages to the long table (vintage, date, series, value)."""
    keyed = frame.select(F.to_date(vintage).alias("vintage"), F.to_date(date).alias(DATE), *[F.col(c).cast("double").alias(c) for c in columns])
    return keyed.unpivot(["vintage", DATE], list(columns), "series", "value")


custom_vintages = vintages_from_wide
