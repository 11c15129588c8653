"""Small tables of word counts for small inputs."""

from __future__ import annotations

import pytest


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    from tideline.llm import linededup

    monkeypatch.setattr(linededup, "BUCKETS", 1 << 12)
