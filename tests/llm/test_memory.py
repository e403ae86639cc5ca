"""What the driver keeps of its memory between the jobs of a pipeline."""

import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from corpusspark.llm import common  # noqa: E402


@pytest.mark.parametrize(("held", "collect", "collected"), [(600, False, 1), (400, False, 0), (400, True, 1)])
def test_a_large_heap_is_collected(monkeypatch, held, collect, collected):
    calls = []
    heap = SimpleNamespace(totalMemory=lambda: held, maxMemory=lambda: 1000)
    java = SimpleNamespace(lang=SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap)))
    jvm = SimpleNamespace(java=java, System=SimpleNamespace(gc=lambda: calls.append("gc")))
    monkeypatch.setattr(common, "trim_native", lambda spark: calls.append("trim"))
    common.hand_back(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=jvm)), collect)
    assert calls == ["gc"] * collected + ["trim"]


def test_each_write_hands_memory_back(spark, monkeypatch):
    calls, trim = [], common.trim_native
    monkeypatch.setattr(common, "trim_native", lambda session: calls.append(trim(session)))
    assert common.materialise(spark.range(3), "small").count() == 3
    assert common.materialise(spark.range(3), "small", free=True).count() == 3
    assert calls == [True, True]  # the JVM knows the command
