"""What the driver's Python keeps after the classifier is fitted."""

import sys
from pathlib import Path

import pytest

from conceptframe.llm import toxicity


def held_mb():
    return next(int(x.split()[1]) for x in Path("/proc/self/status").read_text().splitlines() if x.startswith("RssAnon")) / 1024


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_the_driver_gives_back_what_the_fit_used(table, spark, monkeypatch):
    last, between = [], []

    def fit(texts, toxic):
        held = [bytes(600) for _ in range(400_000)]
        last.append(held[-1])  # what stays lies above what goes, so that the heap cannot shrink from its end
        between.append(held_mb())
        return toxicity.Model(None, None, constant=len(texts) / 10)

    monkeypatch.setattr(toxicity, "fit", fit)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    model = toxicity.train(table([(i, "some words") for i in range(20)]), labels)
    assert 0 < model.constant < 2 and between[0] - held_mb() > 150
