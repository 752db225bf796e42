import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from fleetlife.session import local_session

    session = local_session(cores=8, shuffle_partitions=8)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def panel(spark):
    from fleetlife.session import stage
    from fleetlife.sources.testdata import events_panel

    return stage(events_panel(spark, SF))


@pytest.fixture(scope="session")
def summary(panel):
    from fleetlife.operators.lifecycle import drive_summary
    from fleetlife.session import stage

    return stage(drive_summary(panel))


@pytest.fixture(scope="session")
def scores(panel):
    from fleetlife.operators.lifecycle import labels
    from fleetlife.session import stage
    from fleetlife.sources.testdata import EVENT_SETTINGS, formula_scores

    return stage(formula_scores(labels(panel, EVENT_SETTINGS.horizons)))
