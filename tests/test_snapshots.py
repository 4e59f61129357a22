import json

import pytest

from sitegauge.sources.fixtures import relation
from sitegauge.sources.snapshots import read, write


def test_round_trip(spark, tmp_path):
    rows = relation(spark, "peer").join(relation(spark, "rubric").select("check_name", "max_score"), "check_name")
    rows = rows.selectExpr("name", "grp", "size", "check_name", "score", "max_score as max", "'pass' as state", "'inferred' as evidence")
    write(rows, str(tmp_path / "out"), "2024-05-01")
    back = read(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert str(back.first().snapshot_date) == "2024-05-01"


def test_other_version(spark, tmp_path):
    (tmp_path / "v1.json").write_text(json.dumps({"schema_version": 1, "profiles": []}))
    with pytest.raises(Exception, match="snapshot version 1"):
        read(spark, str(tmp_path / "v1.json")).collect()


def test_labels_stay(spark, tmp_path):
    rows = [(n, "cat", "ecommerce", "boutique", f"https://{n}.example", c, 1, 2, "partial", "verified", labels) for n, labels in (("a", ["auth.md", "API Catalog"]), ("b", [])) for c in ("ssr", "social")]
    kept = spark.createDataFrame(rows, "name string, category string, grp string, size string, url string, check_name string, score long, max long, state string, evidence string, agent_passed array<string>")
    write(kept, str(tmp_path / "out"), "2024-05-01")
    back = read(spark, str(tmp_path / "out")).select(kept.columns)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, kept.collect()), key=str)
