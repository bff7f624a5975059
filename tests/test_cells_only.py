"""What doesn't write records reads no raw text, and gives what reading whole records gives."""

import pytest
from gridloom.operators.filters import Contains
from gridloom.sheet import Sheet
from gridloom.sources import generate


@pytest.fixture
def sheet(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    generate.generate(path, 200_000, 5, b",", 2)
    return Sheet.open(spark, path, step=20_000)


def test_cells_are_those_of_the_records(sheet):
    whole = sheet.rows_frame().select("row", "fields").orderBy("row").collect()
    assert sheet.cells_frame().orderBy("row").collect() == whole
    edited = sheet.edit({(5, 1): "x", (6, 0): 'with "quotes"'})
    assert edited.cells_frame().orderBy("row").collect() == edited.rows_frame().select("row", "fields").orderBy("row").collect()
    split = sheet.split(0, "quotes", 2)
    assert split.cells_frame().orderBy("row").collect() == split.rows_frame().select("row", "fields").orderBy("row").collect()


def test_matches_are_placed_without_records(sheet):
    found = sheet.filter([Contains(0, 'with "quotes"')])
    assert found.places().orderBy("row").collect() == found.matches.select("row").orderBy("row").collect()
    assert found.count() == found.matches.count() and sum(found._by_part) == found.count()
    plan = found.places()._jdf.queryExecution().optimizedPlan().toString()
    assert "raw" not in plan and "fields" in plan


def test_replacements_are_counted_on_cells(sheet):
    out, total = sheet.replace_all("value", "VALUE")
    assert total == sum(v.count("value") for r in sheet.rows_frame().select("fields").collect() for v in r["fields"]) > 0
    assert sheet.replace_all("nowhere to be found", "x") is None
    assert out.find("value") is None
