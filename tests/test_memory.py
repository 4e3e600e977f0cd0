"""Memory that one task holds: Spark adds up what a task's sorts and aggregates took at most, a page each at least."""

from __future__ import annotations

import pytest
from conftest import SMALL

from annalix.plans import registry

#: MB; a page is 32 MB with the settings of the tests.
MOST = 400


def peak_mb(spark, name: str) -> float:
    """The largest peak execution memory of a task of the query."""
    sc = spark.sparkContext
    sc.setJobGroup(f"memory-{name}", name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # the plan of tables that are too large for it
    try:
        registry.queries()[name](spark, SMALL).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    largest = sc._gateway.new_array(sc._jvm.double, 1)
    largest[0] = 1.0
    tracker, store, peaks = sc.statusTracker(), sc._jsc.sc().statusStore(), []
    for job in tracker.getJobIdsForGroup(f"memory-{name}"):
        for stage in tracker.getJobInfo(job).stageIds:
            told = store.taskSummary(stage, 0, largest)
            if told.isDefined():  # else the stage was skipped
                peaks.append(told.get().peakExecutionMemory().apply(0) / 1e6)
    assert max(peaks) > 0
    return max(peaks)


@pytest.mark.parametrize("name", ["aud_03", "aud_05", "sink_15", "aud_01", "aud_01_first", "scan_03_asof", "sink_15_versions", "aud_04"])
def test_no_task_holds_a_whole_audit(spark, name):
    assert peak_mb(spark, name) < MOST
