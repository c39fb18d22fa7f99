"""All reports on an incident table, from one pass over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blotter.functions.dates import month_of
from blotter.functions.names import column
from blotter.operators import charts
from blotter.operators.counts import category_values, crosstab, group_sizes, outcome_by, trend
from blotter.operators.matrices import WIDTH, stacked_counts, write_crosstab
from blotter.operators.ranking import top_groups
from blotter.schema import TOP_LOCATIONS, TOP_TYPES
from blotter.sources.tables import write_results, write_table
from blotter.staging import stage

_YEAR_TYPE = ("Year", "Primary Type")
_KEYS = ["Year", "Month", "Primary Type", "Location Description", "Arrest"]


def count_incidents(df: DataFrame) -> DataFrame:
    """Incidents per year, month, type, place and arrest, staged.

    This is the only pass over the table. It has at most as many rows as there are
    combinations of these few values, and every report is a sum over it.
    """
    keyed = df.select(
        column("Year").try_cast("int").alias("Year"),
        month_of(column("Date")).alias("Month"),
        column("Primary Type"),
        column("Location Description"),
        column("Arrest").try_cast("boolean").alias("Arrest"),
    )
    return stage(keyed.groupBy(*[column(k) for k in _KEYS]).agg(F.count(F.lit(1)).alias("n")), "counts")


def incident_reports(
    df: DataFrame,
    types: list[str] = TOP_TYPES,
    locations: list[str] = TOP_LOCATIONS,
    top: int = 15,
    counts: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The reports and the tables behind their charts, by name; ``counts`` if the incidents are counted already."""
    counts = count_incidents(df) if counts is None else counts
    all_types = crosstab(counts, *_YEAR_TYPE, category_values(counts, "Primary Type"), weight="n")
    return {
        "types_by_year": all_types,
        "types_by_year_chart": charts.stacked_bars(all_types, "Year"),
        **_named_reports(counts, types, locations, top),
    }


def _named_reports(counts: DataFrame, types: list[str], locations: list[str], top: int) -> dict[str, DataFrame]:
    """The reports whose width the named types fix."""
    year_type, place = _YEAR_TYPE, "Location Description"
    named_types = crosstab(counts, *year_type, types, weight="n")
    yearly = trend(counts, *year_type, types, weight="n")
    monthly = trend(counts, "Month", "Primary Type", types, weight="n")
    arrests = outcome_by(counts, place, "Arrest", keys_in=locations, weight="n")
    return {
        "named_types_by_year": named_types,
        "named_types_by_year_chart": charts.stacked_bars(named_types, "Year"),
        "type_trends": yearly,
        "type_trends_chart": charts.lines(yearly, "Year"),
        "arrests_by_location": arrests,
        "arrests_by_location_chart": charts.outcome_bars(arrests, place),
        "largest_outcome_groups": top_groups(counts, [place, "Arrest"], top, weight="n"),
        "types_by_month": monthly,
        "types_by_month_chart": charts.month_lines(monthly, "Month"),
    }


def write_reports(df: DataFrame, path: str, wide: bool = False, width: int = WIDTH) -> list[str]:
    """Write every report below ``path`` as CSV; returns their names.

    With ``wide`` the matrix of all types is written in tables of ``width`` types each, and its
    chart from the long counts, so that any number of types will do.
    """
    counts = count_incidents(df)
    if wide:
        write_crosstab(counts, *_YEAR_TYPE, f"{path}/types_by_year", width, "n")
        stacked = stacked_counts(group_sizes(counts, list(_YEAR_TYPE), "n", "n"), *_YEAR_TYPE)
        write_table(stacked, f"{path}/types_by_year_chart")
        reports = _named_reports(counts, TOP_TYPES, TOP_LOCATIONS, 15)
    else:
        reports = incident_reports(df, counts=counts)
    for name, report in reports.items():
        write_results(report, f"{path}/{name}")
    return [*(["types_by_year", "types_by_year_chart"] if wide else []), *reports]
