import pytest

from nearweave.llm import common, lines


@pytest.fixture(autouse=True)
def small_constants(monkeypatch):
    """Arrays of fixed size, which would be most of a small test's time, are smaller here; results don't depend on them."""
    monkeypatch.setattr(common, "FILTER", 10)
    monkeypatch.setattr(lines, "BITS", 12)
