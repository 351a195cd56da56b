"""Properties of plans: native operators run no Python on executors, scans read the columns they need."""

import re

import pytest

from lexmend.llm import common
from lexmend.llm.queries import queries

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_source_mixing", "op7_exact_dedup", "op8_quality_rules"])
def test_native(spark, name):
    assert not re.search("Python|Pandas|Arrow", plan(queries()[name](spark, FOLDER)))


@pytest.mark.parametrize("name", ["op1_license_scan", "op5_language_id", "op7_exact_dedup", "op8_quality_rules", "op10_toxicity"])
def test_only_id_and_text_are_read(spark, name):
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan(queries()[name](spark, FOLDER))):
        assert set(re.findall(r"(\w+):", schema)) <= {"doc_id", "text"}


def test_rules_shuffle_nothing(spark):
    assert "Exchange" not in plan(queries()["op8_quality_rules"](spark, FOLDER))


def test_staged_tables_can_be_cleared(spark):
    kept = common.staged(spark.range(10), "numbers")
    assert kept.count() == 10 and kept.inputFiles()
    common.drop_staged(kept)
    with pytest.raises(Exception, match="(?i)not exist|PATH_NOT_FOUND|FileNotFound"):
        spark.read.parquet(kept.inputFiles()[0]).count()
