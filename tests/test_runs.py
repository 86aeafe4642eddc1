import json

import pytest

from lexigrove.__main__ import main
from lexigrove.plans import runs
from lexigrove.sources import pages as P
from lexigrove.sources import reader as R
from tests.paged import make


def line(text, y, x1=50.0, x2=550.0):
    return {"text": text, "x1": x1, "y1": y, "x2": x2, "y2": y + 12}


PROSE = ["The landing gear shall withstand the limit load of the airframe on the ground", "and the doors of the gear are locked by hooks which are shown in the manual", "Every inspection of the landing gear follows the manual and its limits", "The limit load of the gear is shown in the manual of the airframe"]


def page(n, **more):
    spans = [line(t, 60.0 + 20 * i) for i, t in enumerate(PROSE)]
    return {"text": "\n".join(PROSE), "spans": spans, "images": [], "ink": [(50, 60 + 20 * i, 550, 72 + 20 * i) for i in range(len(PROSE))]} | more


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    home = tmp_path_factory.mktemp("paged")
    (home / "in" / "sub").mkdir(parents=True)
    figure = page(2, spans=[line(t, 500.0 + 20 * i) for i, t in enumerate(PROSE)] + [line("Fig. 1 Gear", 400.0, 120.0, 330.0)], ink=[(120, 150, 330, 390)] + [(50, 500 + 20 * i, 550, 512 + 20 * i) for i in range(4)])
    table = page(3, spans=[line(t, 600.0 + 20 * i) for i, t in enumerate(PROSE)], ink=[(100, 100 + 40 * i, 401, 102 + 40 * i) for i in range(4)] + [(100 + 100 * i, 100, 101 + 100 * i, 222) for i in range(4)])
    gear = [page(1), figure, table, {"bad": True}, {"text": "", "spans": [], "ink": []}]
    (home / "in" / "gear.pdf").write_text(json.dumps(gear))
    (home / "in" / "sub" / "fuel.PDF").write_text(json.dumps([page(i) for i in range(40)]))
    (home / "in" / "broken.pdf").write_text("{")
    return home


def test_ranges_are_read_by_many_tasks(spark, files):
    found = R.counted(R.listed(spark, str(files / "in")), make).cache()
    assert {r.doc_id: (r.page_count, r.error is None) for r in found.collect()} == {"gear": (5, True), "fuel": (40, True), "broken": (0, False)}
    plan = R.planned(found, None, 8)
    assert sorted((r.doc_id, r.pages[0], len(r.pages)) for r in plan.collect()) == [("fuel", i, 8) for i in (1, 9, 17, 25, 33)] + [("gear", 1, 5)]
    assert sorted((r.doc_id, r.pages) for r in R.planned(found, "2-3,39,99").collect()) == [("fuel", [2, 3, 39]), ("gear", [2, 3])]
    got = R.read(plan, make).cache()
    assert got.where("doc_id = 'fuel'").count() == 40
    bad = {r.page: r.error for r in got.where("doc_id = 'gear'").collect()}
    assert bad[1] is None and bad[2] is None and "bad page" in bad[4] and "bad page" in bad[5]  # what stood behind it in its range
    assert R.read(plan, lambda: None).where("error IS NULL").count() == 0


def test_the_data_source(spark, files):
    spark.dataSource.register(R.PageSource)
    load = lambda **more: spark.read.format("lexigrove_pages").options(reader="tests.paged:make", **more).load(str(files / "in" / "sub"))
    df = load(step=5)
    assert df.rdd.getNumPartitions() == 8 and df.count() == 40 and [r.page for r in load(pages="7,1-2").orderBy("page").collect()] == [1, 2, 7]
    row = df.where("page = 3").first()
    assert row.doc_id == "fuel" and row.spans[0].text == PROSE[0] and len(row.gray) == 480_000


def test_extraction_run(spark, files):
    out = str(files / "out")
    got = {(r.doc_id, r.page): r for r in runs.run_extract(spark, str(files / "in"), out, make, step=1).collect()}
    assert len(got) == 45 and got["gear", 1].page_class in "AB" and got["gear", 1].status == "ok" and got["gear", 5].page_class in "CD"
    docs = P.documents(spark, f"{out}/documents/*").cache()
    assert sorted((r.doc_id, r.page_count, len(r.pages)) for r in docs.collect()) == [("fuel", 40, 40), ("gear", 5, 5)]
    gear = {p.page: p for p in docs.where("doc_id = 'gear'").first().pages}
    assert gear[1].text.startswith(PROSE[0]) and gear[4].notes and list(gear) == [1, 2, 3, 4, 5]
    assert {r.page for r in P.admission(P.pages_of(docs)).where("reason IS NULL AND doc_id = 'gear'").collect()} == {1, 2, 3}
    assert runs.run_extract(spark, str(files / "in"), out, make, resume=True).count() == 0
    again = runs.run_extract(spark, str(files / "in"), out, make, pages="1")
    assert again.count() == 2 and {len(r.pages) for r in P.documents(spark, f"{out}/documents/*").collect()} == {1}


def test_region_runs(spark, files):
    out = str(files / "regions")
    run = lambda **more: {(r.doc_id, r.page): (r.formulas, r.tables, r.figures) for r in runs.run_regions(spark, str(files / "in"), out, make, step=1, **more).collect()}
    first = run(pages="1-3")
    assert len(first) == 6 and first["gear", 2][2] == 1 and first["gear", 3][1] == 1 and first["gear", 1] == (0, 0, 0)
    blocks = lambda: {(r.doc_id, r.page, r.region_id, r.method) for r in runs.blocks_of(spark, out).collect()}
    assert ("gear", 2, "figure_00", "caption_anchor") in blocks() and any(m == "cv_line_grid" for *_, m in blocks())
    before = blocks()
    assert run(pages="1-3", mode="resume") == {} and blocks() == before
    assert set(run(pages="2-5", mode="merge")) == {("gear", 5), ("fuel", 4), ("fuel", 5)} and before <= blocks()
    assert set(run(pages="3", mode="reprocess")) == {("gear", 3), ("fuel", 3)} and before <= blocks()
    assert set(run(pages="1", mode="new", skip_unchanged=True)) == {("gear", 1), ("fuel", 1)} and blocks() == set()
    assert run(pages="1", mode="new", skip_unchanged=True) == {}
    (files / "in" / "sub" / "fuel.PDF").write_text(json.dumps([page(1)]))
    assert set(run(pages="1", mode="new", skip_unchanged=True)) == {("fuel", 1)}


def test_commands(spark, files, capsys):
    source, out = str(files / "in" / "gear.pdf"), str(files / "cli")
    assert main(["extract", source, out, "--reader", "tests.paged:make", "--pages", "1-2"], spark) == 0
    assert len(json.loads(capsys.readouterr().out)) == 2
    assert main(["regions", source, out, "--reader", "tests.paged:make", "--pages", "2", "--mode", "merge"], spark) == 0
    assert json.loads(capsys.readouterr().out) == [{"doc_id": "gear", "page": 2, "formulas": 0, "tables": 0, "figures": 1}]
    assert main(["extract", str(files / "none"), out, "--reader", "tests.paged:make"], spark) == 2
    assert main(["check"], spark) == 0
    assert json.loads(capsys.readouterr().out)["failed"] == []
