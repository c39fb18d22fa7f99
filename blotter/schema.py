"""The incident table: fields, categories of interest and feature lists."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. They are facts about the incident data and must stay as they
# are for reports and feature vectors to come out right.
# ---------------------------------------------------------------------------

INCIDENT_FIELDS = [
    "ID",
    "Case Number",
    "Date",
    "Block",
    "IUCR",
    "Primary Type",
    "Description",
    "Location Description",
    "Arrest",
    "Domestic",
    "District",
    "Ward",
    "Community Area",
    "FBI Code",
    "Year",
    "Latitude",
    "Longitude",
]

# Columns of the raw export that the cleaned table does not carry.
RAW_ONLY_FIELDS = ["Beat", "X Coordinate", "Y Coordinate", "Location", "Updated On"]

# The ten offence types that the reports single out.
TOP_TYPES = [
    "THEFT",
    "CRIMINAL DAMAGE",
    "NARCOTICS",
    "OTHER OFFENSE",
    "BATTERY",
    "BURGLARY",
    "ASSAULT",
    "DECEPTIVE PRACTICE",
    "ROBBERY",
    "MOTOR VEHICLE THEFT",
]

# The ten kinds of place that the arrest report singles out.
TOP_LOCATIONS = [
    "STREET",
    "RESIDENCE",
    "APARTMENT",
    "PARKING LOT/GARAGE(NON.RESID.)",
    "SIDEWALK",
    "OTHER",
    "RESIDENCE-GARAGE",
    "SMALL RETAIL STORE",
    "RESTAURANT",
    "ALLEY",
]

# Text that the usual CSV tools read as "no value".
NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# How occurrence times are written; one letter reads one and two digits.
DATE_PATTERN = "M/d/yyyy h:mm:ss a"

MONTH_LABELS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Everything a token may not contain, besides the blank.
TOKEN_SEPARATORS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'

# Columns made numeric before the two-component projection ...
PROJECTION_CASTS = ["District", "Ward", "Community Area", "Year", "Arrest", "Domestic"]
# ... and those left out of it.
PROJECTION_DROPS = [
    "Case Number",
    "IUCR",
    "Date",
    "Block",
    "FBI Code",
    "Description",
    "Loc_Descr_Int",
    "Prim_Type_Int",
]

# Columns that the offence-type task leaves out.
TYPE_TASK_DROPS = ["Case Number", "Block", "Description", "District", "Community Area"]

# ---------------------------------------------------------------------------

KEY = "ID"

# Every field but the key is read as text, so that codes such as "08B" and
# "0820" survive; the canonical table below gives the others their types.
INCIDENT_SCHEMA = T.StructType(
    [T.StructField(n, T.LongType() if n == KEY else T.StringType()) for n in INCIDENT_FIELDS]
)

CANONICAL_TYPES = {
    "Arrest": "boolean",
    "Domestic": "boolean",
    "District": "int",
    "Ward": "int",
    "Community Area": "int",
    "Year": "int",
    "Latitude": "double",
    "Longitude": "double",
}
