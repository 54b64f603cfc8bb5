"""The command-line runner lists every registered query and writes a result."""

import json
import os

from cashcurve.__main__ import main
from tests.conftest import SF_SMALL


def test_list_names_every_query(capsys):
    from cashcurve.plans.catalog import QUERIES
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert all(k in out for k in QUERIES)


def test_run_writes_json(spark, tmp_path):
    out = str(tmp_path / "runway")
    assert main(["run", "runway", SF_SMALL, out, "--format", "json"]) == 0
    files = [f for f in os.listdir(out) if f.endswith(".json")]
    rows = [json.loads(line) for f in files for line in open(os.path.join(out, f))]
    assert len(rows) == 25 and {"company_id", "status_message", "status_color"} <= set(rows[0])


def test_every_query_is_described_with_survey_ids():
    from cashcurve.plans.catalog import QUERIES
    from cashcurve.plans.descriptions import DESCRIPTIONS
    assert set(QUERIES) == set(DESCRIPTIONS)
    assert all(ids.strip() and text.strip() for ids, text in DESCRIPTIONS.values())
