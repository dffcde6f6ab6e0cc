import json

from vellum.operators import stream
from vellum.sources import biblatex, markup, plaintext, readers


def test_items_words_and_runs(spark, tmp_path):
    items = [
        {"id": "a", "kind": "token", "form": "hel", "joinNext": True, "segment": {"segmentId": "s1"}},
        {"id": "b", "kind": "break", "type": "line"},
        {"id": "c", "kind": "token", "form": "lo", "norm": "LO"},
        {"id": "d", "kind": "token", "form": "x", "joinNext": True, "segment": {"segmentId": None}},
        {"id": "e", "kind": "object", "type": "gap"},
        {"id": "f", "kind": "token", "form": "y"},
    ]
    (tmp_path / "t.json").write_text(json.dumps({"id": "doc", "version": 1, "content": {"items": items}}))
    rows = readers.read_items(spark, str(tmp_path))
    got = {r["item_id"]: r for r in stream.words(rows).collect()}
    assert got["a"]["word"] == got["c"]["word"] and got["d"]["word"] != got["f"]["word"] and got["c"]["read_form"] == "LO"
    runs = {r["item_id"]: r for r in stream.segment_runs(rows).collect()}
    assert [runs[i]["run"] for i in "abcdef"] == [1, 1, 1, 2, 2, 2]
    assert runs["c"]["segment"]["seg_id"] == "s1" and runs["f"]["segment"]["seg_id"] is None and runs["d"]["has_start"]


def test_tei_leiden_layout_and_entries():
    body = """<TEI xmlns="x"><teiHeader>no</teiHeader><text><body><div type="book" n="1"><head>Of ships</head><lg><l n="1">two <supplied>br</supplied>oken <del>oars</del></l>
<l n="2">lie <choice><sic>hear</sic><corr>here</corr></choice> <gap reason="lost"/> <choice><abbr>St</abbr><expan>Saint</expan></choice> a<lb break="no"/>way</l></lg></div></body></text></TEI>"""
    items = markup.tei_items(body)
    words = {x["form"]: x for x in items if x["kind"] == "token"}
    assert list(words) == ["two", "broken", "oars", "lie", "hear", "St", "a", "way"]
    assert words["broken"]["marks"] == [{"kind": "supplied", "attrs": None, "from": 0, "to": 2}] and words["oars"]["marks"][0]["kind"] == "del"
    assert (words["hear"]["norm"], words["hear"]["unchecked"], words["St"]["marks"][0]["attrs"]) == ("here", True, {"expan": "Saint"})
    assert words["a"]["join_next"] and [x["type"] for x in items if x["kind"] == "object"] == ["paratext", "gap"] and [x["label"] for x in items if x["has_start"]] == ["1", "1", "2"]
    found = markup.leiden_items("arm[a] ca[no] [....] [---] [ca. 5] ⟦del⟧ un(it) open[ wo-\nrd")
    assert [x["form"] or x["attrs"]["extent"] for x in found if x["kind"] != "break"] == ["arma", "cano", "4", "unknown", "5", "del", "unit", "open[", "wo", "rd"]
    assert [m["kind"] for x in found for m in x["marks"]] == ["supplied", "supplied", "del", "expansion"] and found[-3]["join_next"]
    alto = '<alto xmlns="a"><Layout><Page WIDTH="100" HEIGHT="200"><TextLine><String CONTENT="salve" HPOS="10" VPOS="20" WIDTH="50" HEIGHT="10"/></TextLine></Page></Layout></alto>'
    assert markup.layout_words(alto) == [{"line": 0, "n": 0, "form": "salve", "x": 0.1, "y": 0.1, "w": 0.5, "h": 0.05}]
    read = biblatex.entries('@string{p = "Press"} @book{a, title = {One {Two}}, journal = p # " House", year = 1990} @article{b, title = } @misc{c, month = feb,}')
    assert [(e["kind"], e["key"], e["fields"]) for e in read if not e["fault"]] == [("book", "a", {"title": "One {Two}", "journaltitle": "Press House", "year": "1990"}), ("misc", "c", {"month": "2"})]
    assert [e["kind"] for e in read if e["fault"]] == ["article"]


def test_dates_of_entries(spark):
    text = """@phdthesis{a, school = {Turin}, year = 1998, month = sep} @mastersthesis{b, year = { 2003 }, type = {Tesi}} @book{c, year = {ca. 1600}, month = {4}}
@book{d, year = 1750, month = {{December}}} @book{e, year = 1750, month = {13}} @book{f, year = 1750, date = {1751}} @misc{g, month = jul} @techreport{h, year = 1980, month = {07}}"""
    rows = biblatex.read_biblatex(spark.createDataFrame([(1, text), (2, None)], "doc int, text string"), "doc").orderBy("n").collect()
    assert [(r["key"], r["kind"], r["fields"]) for r in rows] == [
        ("a", "thesis", {"type": "phdthesis", "institution": "Turin", "date": "1998-09"}), ("b", "thesis", {"type": "Tesi", "date": "2003"}), ("c", "book", {"year": "ca. 1600", "month": "4"}),
        ("d", "book", {"date": "1750-12"}), ("e", "book", {"month": "13", "date": "1750"}), ("f", "book", {"year": "1750", "date": "1751"}), ("g", "misc", {"month": "7"}), ("h", "report", {"type": "techreport", "date": "1980-07"}),
    ]


def test_keys_doubles_and_empty_fields():
    read = biblatex.entries('@string{key = "K"} @book{, title = {x}} @book{a"b, title = {x}} @book{c, journal = {one}, note = {}, journaltitle = key # {2}, year = 1900}')
    assert [(e["key"], e["fields"], bool(e["fault"])) for e in read] == [(None, {}, True), (None, {}, True), ("c", {"journaltitle": "K2", "note": "", "year": "1900"}, False)]


def test_numbered_text(spark):
    docs = spark.createDataFrame([(1, "1 arma virumque\ncano\n2) Troiae qui"), (2, "no number\nhere"), (3, "one [1.5] two [1.6]\nthree")], "doc_id int, text string")
    lines = plaintext.text_lines(docs)
    ways = {}
    for r in plaintext.detect_numbering(lines).orderBy("doc_id", "rank").collect():
        ways.setdefault(r["doc_id"], []).append(r["kind"])
    assert ways == {1: ["line-start-number", "every-line"], 2: ["every-line"], 3: ["bracketed", "every-line"]}
    got = plaintext.numbered_words(lines.where("doc_id = 3"), "bracketed").orderBy("line", "pos").collect()
    assert [(r["form"], r["label"]) for r in got] == [("one", None), ("two", "1.5"), ("three", "1.6")]
    every = plaintext.numbered_words(lines.where("doc_id = 2"), "every-line").orderBy("line", "pos").collect()
    assert [(r["form"], r["label"]) for r in every] == [("no", "1"), ("number", None), ("here", "2")]


def test_leiden_joins_only_at_the_end_of_a_line():
    found = [(x["form"], x["join_next"]) for x in markup.leiden_items("wo- rd wo- \nrd") if x["kind"] == "token"]
    assert found == [("wo-", False), ("rd", False), ("wo", True), ("rd", False)]


def test_readers_keep_keys_beside_a_null_one(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "a ⟦b⟧ [ca. 5]"), (None, "c"), (7, None)], "doc_id long, text string").coalesce(1)
    got = [(r["doc_id"], r["pos"], r["form"], [m["kind"] for m in r["marks"]], r["attrs"]) for r in markup.read_leiden(docs).collect()]
    assert got == [(big, 0, "a", [], None), (big, 1, "b", ["del"], None), (big, 2, None, [], {"extent": "5", "unit": "character", "precision": "low"}), (None, 0, "c", [], None)]
    broken = spark.createDataFrame([(big, "<TEI><text>a</TEI>"), (None, '<TEI><text><body><hi rend="b">x</hi></body></text></TEI>')], "doc_id long, text string").coalesce(1)
    bad, good = markup.read_tei(broken).collect()
    assert bad["doc_id"] == big and bad["fault"] and bad["pos"] is None
    assert good["doc_id"] is None and good["marks"][0]["attrs"] == {"rend": "b"}
