"""Snapshots of many pages, and what is refused."""

import json

import pytest

from siftline.sources.pages import SnapshotError, plan, read_pages


def put(folder, **pages):
    for name, page in pages.items():
        (folder / f"{name}.json").write_text(page if isinstance(page, str) else json.dumps(page))
    return f"{folder}/p1.json"


def schema(spark):
    return spark.createDataFrame([], "id long, name string, sections array<struct<id:long>>").schema


def test_many_pages_side_by_side(spark, tmp_path):
    n = 40
    pages = {f"p{k}": {"count": 3 * n, "next": f"p{k + 1}.json" if k < n else None, "results": [{"id": 3 * k + i, "name": f"n{k}", "sections": [{"id": i}]} for i in range(3)]} for k in range(1, n + 1)}
    first = put(tmp_path, **pages, other={"results": [{"id": -1}], "next": None})
    got = read_pages(spark, first, schema(spark))
    rows = got.collect()
    assert sorted(r["id"] for r in rows) == list(range(3, 3 * n + 3)) and {r["page"] for r in rows} == set(range(1, n + 1))
    assert got.rdd.getNumPartitions() > 1 and all(r["sections"][0]["id"] == r["id"] % 3 for r in rows)
    assert len(plan(spark, first)) == n


def test_one_page_and_an_empty_one(spark, tmp_path):
    assert [r["id"] for r in read_pages(spark, put(tmp_path, p1={"results": [{"id": 4, "name": 7}]}), schema(spark)).collect()] == [4]
    (tmp_path / "e").mkdir()
    assert read_pages(spark, put(tmp_path / "e", p1={"count": 0, "results": [], "next": ""}), schema(spark)).count() == 0


@pytest.mark.parametrize("pages,says", [
    ({"p1": {"detail": "not found"}}, "malformed page 1"),
    ({"p1": [{"id": 1}]}, "malformed page 1"),
    ({"p1": {"results": {"id": 1}}}, "malformed page 1"),
    ({"p1": {"results": [], "next": "p2.json"}, "p2": {"detail": "x"}}, "malformed page 2"),
    ({"p1": {"results": [{"id": 1}, 5, None]}}, "2 rows of page 1 are no objects"),
    ({"p1": {"count": 3, "results": [{"id": 1}], "next": "p2.json"}, "p2": {"results": [{"id": 2}]}}, "3 rows announced, 2 found"),
    ({"p1": {"results": [], "next": "p9.json"}}, "page 2 is missing"),
    ({"p1": {"results": [], "next": "https://elsewhere/p2.json"}}, "leads elsewhere"),
    ({"p1": {"results": [], "next": "../p2.json"}}, "leads elsewhere"),
    ({"p1": {"results": [], "next": "/etc/p2.json"}}, "leads elsewhere"),
    ({"p1": {"results": [], "next": "p2.json"}, "p2": {"results": [], "next": "p1.json"}}, "leads back"),
    ({"p1": {"results": [], "next": "p2.json"}, "p2": {"results": [], "next": "p3.json"}, "p3": {"results": []}}, "more than 2 pages"),
])
def test_refusals(spark, tmp_path, pages, says):
    with pytest.raises(SnapshotError, match=says):
        plan(spark, put(tmp_path, **pages), most=2)
