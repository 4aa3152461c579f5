"""The given tables in their adapted shape, at keys that larger copies reach."""

from __future__ import annotations

from __spark_entry__ import queries


def test_cards_of_pages_with_large_ids(spark, tmp_path):
    """Squares of ids beyond 129,099 minutes left the range of decimal seconds."""
    ids = [0, 1, 249, 129_200, 392_065, 800_000, 4_000_000, None]
    rows = [(i, f"https://www.a.example/{i}", f"<title>T {i}</title><p>x  y</p>") for i in ids]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.id: r for r in queries()["item_cards"](spark, str(tmp_path)).collect()}
    assert [got[i].age for i in (0, 1, 249)] == ["just now", "1m ago", "2024-01-17"]
    assert got[129_200].age == "-29714-01-15"
    assert got[800_000].age == got[4_000_000].age == got[392_065].age
    assert got[None].age is None
    assert {r.host for r in got.values()} == {"a.example"} and got[800_000].preview == "T 800000 x y"
