"""Tasks by name."""

import pytest
from pyspark.sql import functions as F

from trailweave.operators import registry as R


def test_tasks(spark):
    assert {"r2r", "reverie", "soon", "cvdn", "eqa", "scanqa", "llava"} <= R.known()
    text = spark.range(1).select(R.load("soon").prompt("object_grounding", F.lit("a bed"), F.lit(1), F.lit(2)).alias("p")).first().p
    assert "(0) not exist (1) <cand>" in text and "Target: a bed" in text
    with pytest.raises(ValueError, match="no prompt"):
        R.load("cvdn").prompt("summarization")
    with pytest.raises(ValueError, match="unknown task"):
        R.load("nope")


def test_own_parts():
    mine = R.load("r2r", summary=len)
    assert mine.summary is len and R.load("r2r").summary is not len
    R.register(R.Task("mine", scores=len))
    assert R.load("mine").scores is len
