"""A gazetteer beyond the bound for workers finds and masks what the whole one does."""

import pytest

from conftest import at, write_tables
from textward.llm import p3_personal

GIVEN = ["Anna", "Bruno", "Clara", "Dmitri", "Elena", "Fritz", "Greta", "Hugo"]
FAMILY = ["Meier", "Rossi", "Dubois", "Ivanov", "Garcia", "Weber", "Novak", "Silva"]


@pytest.mark.parametrize("bound", [50_000, 2])
def test_rare_names_stay_known(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(p3_personal, "NAMES", bound)
    texts = []
    for k, (g, f) in enumerate(zip(GIVEN, FAMILY)):
        texts += [f"Hello, my name is {g} {f}. Please help."] * (10 - k)
    told = len(texts)
    texts += [f"Yesterday {g} {f} came to the office." for g, f in zip(GIVEN, FAMILY)]
    texts += ["Nothing of the kind here."]
    rows = [{"request_id": i, "text": t, "direction": "input", "ts": at(i), "received_at": at(i)} for i, t in enumerate(texts)]
    folder = write_tables(tmp_path / "t", {"scan_requests": rows})
    got = {r.record_id for r in p3_personal.found(spark, folder).collect() if r.pii_type == "person_name"}
    assert got == set(range(told + len(GIVEN)))
    masked = {r.record_id: r.masked for r in p3_personal.masked(spark, folder).collect()}
    assert masked[told + 7] == "Yesterday [PERSON_NAME] came to the office."
