import json

import pytest

from lexigrove.__main__ import main


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("commands")
    (home / "pages").mkdir()
    page = lambda n, text, **more: {"page": n, "page_class": "A", "status": "ok", "text": text, "notes": [], "provenance": {}, "needs_vlm": False} | more
    docs = {
        "gear": [page(1, "4.1 Landing gear loads\nThe landing gear shall withstand the limit load of the airframe on ground."), page(2, "4.2 Doors\nDoors of the gear are locked by hooks, and the lock is shown to the crew in flight.")],
        "fuel": [page(1, "1 Fuel tanks\nTanks are vented to the outside air and hold fuel for two hours of flight at least."), page(2, "x = 1", status="failed")],
    }
    for name, pages in docs.items():
        (home / "pages" / f"{name}_pages.json").write_text(json.dumps({"doc_id": name, "source_path": f"/in/{name}.pdf", "pages": pages}))
    assert main(["build", str(home / "pages"), str(home / "index")], spark) == 0
    return home


def test_query_probe_and_eval(spark, built, capsys):
    at = str(built / "index")
    assert main(["query", at, "limit load of the landing gear"], spark) == 0
    assert capsys.readouterr().out.startswith("[1] gear.pdf, p. 1, clause 4.1")
    assert main(["query", at, "limit load of the landing gear", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["chunk_id"] == "gear|1-1|4.1|1"
    assert main(["query", at, "zeppelin mooring mast"], spark) == 3 and main(["query", at, " "], spark) == 1
    assert main(["query", str(built / "none"), "x y"], spark) == 2 and main(["eval", at, str(built / "none.json")], spark) == 2
    capsys.readouterr()
    assert main(["probe", at], spark) == 0
    assert json.loads(capsys.readouterr().out) == {"checked": 3, "recall_at_5": 1.0}
    (built / "gold.json").write_text(json.dumps({"items": [{"query": "tanks vented outside", "doc_id": "fuel", "page": 1}, {"query": "doors of the gear", "clause_id": "4.2"}, {"query": "zeppelin mast", "relevant": False}]}))
    assert main(["eval", at, str(built / "gold.json")], spark) == 0
    assert json.loads(capsys.readouterr().out)["recall_1"] == 1.0


def test_audit_and_summary(spark, built, capsys):
    assert main(["summary", str(built / "pages")], spark) == 0
    assert [(r["doc_id"], r["pages"], r["failed"]) for r in json.loads(capsys.readouterr().out)] == [("fuel", 2, 1), ("gear", 2, 0)]
    assert main(["audit", str(built / "pages")], spark) == 0 and json.loads(capsys.readouterr().out) == []
