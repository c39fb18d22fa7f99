from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from blotter.schema import INCIDENT_FIELDS  # noqa: E402
from blotter.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.default.parallelism": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
    yield session


HEADER = ",".join(INCIDENT_FIELDS)

# Invented records in the shape of the cleaned incident table.
RECORDS = [
    "1,ZK1,01/05/2019 5:00:00 AM,12 W ELM RD,117,THEFT,FROM A SHED,STREET,FALSE,FALSE,14,21,52,3,2019,10.11,-20.61",
    '2,ZK2,01/06/2019 12:15:00 AM,34 W ELM RD,90X,ASSAULT,"WITH A STICK, AT NIGHT",APARTMENT,TRUE,TRUE,15,22,53,07Q,2019,10.12,-20.62',
    "3,ZK3,02/07/2019 12:30:00 PM,56 W ELM RD,233,BATTERY,AMONG FRIENDS,GARDEN - SHED / FENCE,FALSE,FALSE,16,23,54,11P,2019,10.13,-20.63",
    "4,ZK4,03/01/2020 11:59:59 PM,78 W ELM RD,117,THEFT,OF A BOAT,STREET,TRUE,FALSE,14,21,52,3,2020,10.14,-20.64",
    "5,ZK5,03/02/2020 10:24:00 AM,90 W ELM RD,117,THEFT,OF A BOAT,PIER/DOCK(PRIVATE),FALSE,FALSE,,21,52,3,2020,10.15,-20.65",
    "6,ZK6,not a date,91 W ELM RD,233,BATTERY,AMONG FRIENDS,,FALSE,TRUE,16,23,54,11P,2020,10.16,-20.66",
]


@pytest.fixture(scope="session")
def incident_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("incidents") / "incidents.csv"
    path.write_text("\n".join([HEADER, *RECORDS]) + "\n")
    return str(path)
