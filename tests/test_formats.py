"""Parsers, writers and regeneration, on small files made here."""

from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from segmenta.functions import inline
from segmenta.schema import unit
from segmenta.sinks import files, regen
from segmenta.sources import detect, html, json_i18n, office, po, tabular, tmx, unit_json, xliff
from segmenta.sources.common import open_package, units_frame

TMX = """<?xml version="1.0" encoding="UTF-8"?>
<tmx version="1.4"><header srclang="en-US" datatype="plaintext"/><body>
<tu tuid="a" usagecount="9"><prop type="x-vendor-status">approved</prop><prop type="project">P</prop><note>hint</note>
<tuv xml:lang="en-US"><seg>Hello <bpt i="1" type="bold">&lt;b&gt;</bpt>you<ept i="1">&lt;/b&gt;</ept> &amp; me</seg></tuv><tuv xml:lang="en-GB"><seg>Hullo</seg></tuv><tuv xml:lang="fr_fr"><seg>Bonjour</seg></tuv></tu>
<tu><tuv xml:lang="en-US"><seg>One <hi type="italic">deep <sub>er</sub></hi></seg></tuv><tuv xml:lang="fr-FR"><seg>Un</seg></tuv></tu>
<tu><tuv xml:lang="en-US"><seg>Two</seg></tuv></tu>
</body></tmx>"""
XLIFF = """<?xml version="1.0"?><xliff version="1.2"><file original="x" source-language="en" target-language="{loc}" datatype="plaintext"><body><group>
<trans-unit id="u1"><source>Hello <g id="1" ctype="bold">you</g></source><target state="final">{hi}</target><note>n</note></trans-unit>
<trans-unit id="u2"><source>Bye</source></trans-unit></group></body></file></xliff>"""
PO = """msgid ""
msgstr ""
"Language: ru\\n"
"Plural-Forms: nplurals=3; plural=(n%10==1 && n%100!=11 ? 0 : n%10>=2 && n%10<=4 && (n%100<10 || n%100>=20) ? 1 : 2);\\n"

# translator
#. extracted
#: a.c:1
#, fuzzy, c-format
msgid "one\\tfile"
msgstr "odin"

msgctxt "menu"
msgid "file"
msgid_plural "files"
msgstr[0] "fajl"
msgstr[1] "fajla"
msgstr[2] ""

#~ msgid "old"
#~ msgstr "old"
"""


def package(entries: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = package({"[Content_Types].xml": "<Types/>", "word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Sec</w:t></w:r><w:r><w:tab/><w:t>ond</w:t></w:r></w:p></w:body></w:document>"})
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
PPTX = package({
    "ppt/presentation.xml": f'<p:presentation {A}><p:sldIdLst><p:sldId id="1" r:id="r2"/><p:sldId id="2" r:id="r1"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Target="slides/slide1.xml"/><Relationship Id="r2" Target="slides/slide2.xml"/></Relationships>',
    "ppt/slides/slide1.xml": f"<p:sld {A}><a:p><a:r><a:t>late</a:t></a:r></a:p></p:sld>",
    "ppt/slides/slide2.xml": f"<p:sld {A}><a:p><a:r><a:t>early</a:t></a:r></a:p><a:p><a:r><a:t>next</a:t></a:r></a:p></p:sld>",
})
IDML = package({"designmap.xml": "<D/>", "Stories/Story_u1.xml": '<Story><ParagraphStyleRange><CharacterStyleRange><Content>Plain</Content></CharacterStyleRange></ParagraphStyleRange><ParagraphStyleRange><CharacterStyleRange><Content>A </Content></CharacterStyleRange><CharacterStyleRange FontStyle="Bold"><Content>b</Content></CharacterStyleRange></ParagraphStyleRange></Story>'})
HTML = '<html lang="en"><head><meta name="description" content="About"><title>T</title></head><body><p>Plain</p><p>With <b>bold <i>in</i></b></p><img alt="Pic"><ul><li>a<li>b</ul></body></html>'


def test_tmx_targets_and_codes():
    a, b, c = tmx.parse(TMX.encode())
    assert a["source"] == "Hello you & me" and a["source_locale"] == "en-US" and a["target"] is None
    assert list(a["targets"]) == ["en-GB", "fr-FR"] and a["status"] == "approved" and a["meta"]["usage_count"] == 9 and a["extensions"] == {"project": "P"}
    assert [t["type"] for t in a["tags"]["source_ties"]] == ["bold.open", "bold.close"] and [t["type"] for t in b["tags"]["source_ties"]][:2] == ["italic.open", "custom.open"]
    assert [u["unit_id"] for u in (b, c)] == ["auto_0", "auto_1"]
    one = tmx.parse(TMX.encode(), "fr-CA")
    assert one[0]["target"] == "Bonjour" and one[0]["targets"] == {} and one[2]["target"] is None
    text = tmx.parse(TMX.encode(), mode="text")
    assert text[0]["status"] == "unknown" and text[0]["comments"] == []


def test_split_scan_equals_whole_files(spark, tmp_path):
    big = TMX.replace("</body></tmx>", "".join(f'<tu><tuv xml:lang="en-US"><seg>line {i}</seg></tuv></tu>\n' for i in range(500)) + "</body></tmx>")
    (tmp_path / "a.tmx").write_text(big)
    (tmp_path / "b.tmx").write_text(TMX)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        split = tmx.read(spark, str(tmp_path))
        whole = tmx.read(spark, str(tmp_path), splittable=False)
        key = lambda df: sorted((r.doc_id.rpartition("/")[2], r.ordinal, r.unit_id, r.source) for r in df.select("doc_id", "ordinal", "unit_id", "source").collect())
        assert split.rdd.getNumPartitions() >= 1 and key(split) == key(whole) and len(key(split)) == 506
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_xliff_states_and_merged_locales():
    u1, u2 = xliff.parse(XLIFF.format(loc="fr", hi="Salut").encode())
    assert (u1["source"], u1["target"], u1["status"], u2["status"]) == ("Hello you", "Salut", "approved", "new")
    both = XLIFF.format(loc="fr", hi="Salut").replace("</xliff>", "") + XLIFF.format(loc="de", hi="Hallo").partition('version="1.2">')[2]
    u1, u2 = xliff.parse(both.encode())
    assert {k: v["text"] for k, v in u1["targets"].items()} == {"fr": "Salut", "de": "Hallo"} and u1["target"] is None
    two = '<xliff version="2.1" srcLang="en" trgLang="fr"><file id="f"><unit id="u"><notes><note>n</note></notes><segment id="s"><source>a <pc id="1" type="fmt:bold">b</pc></source><target>c</target></segment></unit></file></xliff>'
    (u,) = xliff.parse(two.encode())
    assert u["unit_id"] == "u:s" and u["tags"]["source_ties"][0]["type"] == "strong.open"
    assert inline.render(u["source"], u["tags"]["source_parts"], u["tags"]["source_ties"], "html") == "a <strong id=\"1\" type=\"fmt:bold\">b</strong>"
    out = regen.regen_xliff(two.encode(), {"u:s": "neu & x"}).decode()
    assert "<target>neu &amp; x</target>" in out and xliff.parse(out.encode())[0]["target"] == "neu & x"
    one = XLIFF.format(loc="fr", hi="Salut").encode()
    again = xliff.parse(regen.regen_xliff(one, {"u2": "Tschüs", "u1": "Ça"}))
    assert [u["target"] for u in again] == ["Ça", "Tschüs"] and again[0]["status"] == "approved"


def test_po_round_trip_and_modes():
    units = po.parse(PO)
    assert [u["unit_id"] for u in units] == ["one\tfile", "menu\x04file", "menu\x04file[1]", "menu\x04file[2]"]
    assert [u["status"] for u in units] == ["draft", "translated", "translated", "new"]
    assert [u["plural"] and u["plural"]["category"] for u in units] == [None, "one", "few", "many"]
    again = po.parse(files.po_text(units, "ru"))
    assert [(u["unit_id"], u["target"], u["status"]) for u in again] == [(u["unit_id"], u["target"], u["status"]) for u in units]
    assert [c["context_key"] for c in again[0]["comments"]] == ["extracted", "translator"]
    assert po.parse(PO, "target_as_source")[0]["source"] == "odin" and po.parse(PO, "source")[0]["target"] is None
    new = regen.regen_po(PO.encode(), {"one\tfile": "neu", "menu\x04file[2]": "fajlov"}).decode()
    assert '#~ msgid "old"' in new and 'msgstr[2] "fajlov"' in new and po.parse(new)[0]["target"] == "neu"
    assert po.unescape(r"\101\x41\n\"") == 'AA\n"'


def test_tables():
    rows = tabular.rows_units([["id", "en_US", "fr-fr", "status", "extra"], ["a", "Hi", "Salut", "translated", "x"], ["", "Yo", "", "odd", ""]])
    assert rows[0]["target"] == "Salut" and rows[0]["target_locale"] == "fr-FR" and rows[0]["extensions"] == {"extra": "x"} and rows[1]["unit_id"] == "csv:1" and rows[1]["status"] == "unknown"
    multi = tabular.rows_units([["id", "en", "fr", "de"], ["a", "Hi", "Salut", ""]], source_locale="en")
    assert list(multi[0]["targets"]) == ["fr"] and multi[0]["target_locales"] == ["fr", "de"]
    plain = tabular.rows_units([["Hello"], ["World"]])
    assert [u["unit_id"] for u in plain] == ["csv:0", "csv:1"] and plain[0]["target"] is None
    letters = tabular.rows_units([["key", "english", "french", "note"], ["k", "e", "f", "n"]], target_locale="fr_FR", selectors={"source": "B", "target": "french", "id": "A", "comment": "D"})
    assert letters[0]["target_locale"] in ("fr_FR", "fr-FR") and letters[0]["comments"][0]["context"] == "n"
    with pytest.raises(ValueError, match="two columns"):
        tabular.resolve(["en", "fr", "FR"])
    assert tabular.locales_from_name("/x/en_US_fr_FR.csv") == ("en-US", "fr-FR") and tabular.locales_from_name("plain.csv") is None
    book = files.xlsx_bytes([["id", "en", "fr"], ["a", "x & y", "z"]])
    assert tabular.xlsx_rows(book) == [["id", "en", "fr"], ["a", "x & y", "z"]]
    assert tabular.xlsx_rows(regen.regen_xlsx(book, {"a": "neu"}, "fr"))[1] == ["a", "x & y", "neu"]
    assert regen.regen_csv(b"id,en,fr\na,Hi,Salut\nb,Yo,\n", {"b": "Oh, la"}, "fr") == b'id,en,fr\na,Hi,Salut\nb,Yo,"Oh, la"\n'


def test_json_resources():
    text = '{"a": {"b": "x", "n": 1, "l": ["y"]}, "a.b": "z", "c": null}'
    assert [(k, v) for k, v, _ in json_i18n.flatten(json_i18n._load(text))] == [("a.b", "x"), ("a.b#2", "z")]
    units = json_i18n.parse(text)
    assert files.json_tree(units) == {"a": {"b": "x"}, "a.b": "z"}
    many = json_i18n.parse('{"en": {"k": "Hi"}, "fr": {"k": "Salut"}, "de": {}}', "en")
    assert many[0]["targets"]["fr"]["text"] == "Salut" and len(many) == 1
    assert json.loads(regen.regen_json(text.encode(), {"a.b#2": "neu"}))["a.b"] == "neu"
    assert json_i18n.parse('{"k": "Hi", "m": "x"}', target_locale="fr", target_texts={"fr": '{"k": "Salut"}'})[1]["status"] == "new"


def test_json_resources_are_written_read_and_rewritten_in_pieces(spark, tmp_path):
    import random

    rng = random.Random(3)
    keys = [".".join(rng.choices(["a", "b", "c", 'd"\n'], k=rng.choice([1, 2, 2, 3]))) for _ in range(60)] + ["", "z.", "a#2"]
    units = [{"unit_id": k, "source": f"t{i} \u00fc", "doc_id": "x", "ordinal": i, "extensions": {"json_path": '["p.q", "r"]'} if i == 7 else {}} for i, k in enumerate(keys)]
    df = units_frame(spark, [unit(**u) for u in units]).repartition(5)
    for name, flat in (("nested", False), ("flat", True)):
        files.write_json_i18n(df, str(tmp_path / f"{name}.json"), flat=flat)
        assert (tmp_path / f"{name}.json").read_text() == json.dumps(files.json_tree(units, flat=flat), ensure_ascii=False, indent=2)
    files.write_json_i18n(df.where("false"), str(tmp_path / "none.json"))
    assert (tmp_path / "none.json").read_text() == "{}"
    text = '\ufeff {"a": {"b": "x\\u00e9", "n": 1, "l": ["y", {"k": "v"}]},\r\n "a.b": "z", "c": null, "a.b" :"w", "e": {}, "a.b#2": "v"} \n'
    (tmp_path / "odd.json").write_bytes(text.encode())
    read = [(r.unit_id, r.source, r.extensions) for r in json_i18n.read(spark, str(tmp_path / "odd.json")).orderBy("ordinal").collect()]
    assert read == [(u["unit_id"], u["source"], u["extensions"]) for u in json_i18n.parse(text[1:])]
    assert [r[0] for r in read] == ["a.b", "a.b#2", "a.b#3", "a.b#2#2"]
    new = spark.createDataFrame([("a.b", 'neu "1"'), ("a.b#3", ""), ("other", "o")], "unit_id string, target string")
    regen.rewrite(spark, str(tmp_path / "odd.json"), str(tmp_path / "new.json"), new, regen.json_file())
    assert (tmp_path / "new.json").read_bytes().decode() == text[1:].replace('"x\\u00e9"', '"neu \\"1\\""').replace('"w"', '""')
    (tmp_path / "many.json").write_text('{"en": {"k": "Hi"}, "fr": {"k": "Salut"}}')
    assert json_i18n.read(spark, str(tmp_path / "many.json")).first().targets["fr"].text == "Salut"


def test_html_units_and_regeneration():
    units = html.page_units(HTML)
    assert [u["unit_id"] for u in units] == ["html:meta:0", "html:title:1", "html:p:2", "html:p:3", "html:img:4", "html:li:5", "html:li:6"]
    assert units[3]["source"] == "With bold in" and len(units[3]["tags"]["source_ties"]) == 4
    new = regen.regen_html(HTML.encode(), {"html:p:2": "Neu", "html:img:4": "Bild"}).decode()
    assert "<p>Neu</p>" in new and 'alt="Bild"' in new
    assert html.page_units(None) == [] and html.page_units("") == [] and html.page_units("<p>a<p>b")[1]["source"] == "b"


@pytest.mark.parametrize(("data", "new"), [(DOCX, regen.regen_office), (PPTX, regen.regen_office), (IDML, regen.regen_idml)])
def test_packages(data, new):
    units = detect.parse_bytes(data)
    targets = {u["unit_id"]: f"neu {i} & <x>" for i, u in enumerate(units)}
    again = detect.parse_bytes(new(data, targets))
    assert [u["source"] for u in again] == list(targets.values())


def test_package_details():
    d = office.parse_office(DOCX)
    assert [u["unit_id"] for u in d] == ["word/document.xml:p0", "word/document.xml:p2"] and d[1]["source"] == "Sec\tond" and d[0]["next_context"]["source"] == "Sec\tond"
    assert [u["source"] for u in office.parse_office(PPTX)] == ["early", "next", "late"]
    assert len(office.parse_idml(IDML)[1]["tags"]["source_ties"]) == 4
    with pytest.raises(ValueError, match="no translation"):
        regen.regen_office(DOCX, {}, missing="error")
    with pytest.raises(ValueError, match="without a place"):
        regen.regen_office(DOCX, {"nowhere": "x"}, extra="error")
    with pytest.raises(ValueError, match="unsafe"):
        open_package(package({"../x": "y"}))


def test_detection():
    for data, kind in [(TMX.encode(), "tmx"), (XLIFF.encode(), "xliff"), (PO.encode(), "po"), (b"a,b\n1,2", "csv"), (b'{"k": "v"}', "json_i18n"), (DOCX, "docx"), (PPTX, "pptx"), (IDML, "idml"), (HTML.encode(), "html"), (files.xlsx_bytes([["a"]]), "xlsx"), (unit_json.dump([]).encode(), "json")]:
        assert detect.detect_bytes(data) == kind
    for bad in (b"plain", b"<x/>", b"PKxx"):
        with pytest.raises(ValueError, match="unknown|broken"):
            detect.detect_bytes(bad)
    with pytest.raises(ValueError, match="macros"):
        detect.detect("a.docm", b"PK")


def test_inline_rules():
    ties = [{"id": "c1", "type": "link.open", "attributes": {"href": "javascript:x", "title": "t", "onclick": "y"}, "pair_id": "p1"}, {"id": "c2", "type": "link.close", "attributes": {}, "pair_id": "p1"}]
    parts = [{"kind": "code", "value": "c1"}, {"kind": "text", "value": "a<b"}, {"kind": "code", "value": "c2"}]
    inline.validate(parts, ties)
    assert inline.render("a<b", parts, ties, "html") == '<a title="t">a&lt;b</a>'
    assert inline.render("a<b", parts, ties, "xliff12") == '<bx id="c1" rid="1" ctype="link"/>a&lt;b<ex id="c2" rid="1"/>'
    assert inline.render("other", parts, ties, "tmx") == "other"
    for broken, own in [(parts[:1], ties), ([*parts, parts[0]], ties), (parts, ties[:1])]:
        with pytest.raises(inline.InlineError):
            inline.validate(broken, own)
    odd = [{"id": "c1", "type": "custom.standalone", "attributes": {}}]
    with pytest.raises(inline.InlineError):
        inline.render("", [{"kind": "code", "value": "c1"}], odd, "html")


def test_files_through_spark(spark, tmp_path):
    units = units_frame(spark, [unit(unit_id=f"k{i}", source=f"Hello {i} & <x>", target=f"Salut {i}", target_locale="fr", source_locale="en", status="translated", comments=[{"context": "c", "extensions": {}}]) for i in range(5)])
    for suffix in ("tmx", "xliff", "csv", "xlsx", "po", "json"):
        path = str(tmp_path / f"out.{suffix}")
        assert files.write(units, path) > 0
        back = detect.read(spark, path).orderBy("ordinal")
        text = F.coalesce("target", F.get(F.map_values("targets"), 0)["text"])
        got = [(r.source, r.t) for r in back.select("source", text.alias("t")).collect()]
        assert got == [(f"Hello {i} & <x>", f"Salut {i}") for i in range(5)], suffix
    assert files.convert(spark, str(tmp_path / "out.tmx"), str(tmp_path / "again.xliff")) > 0
    unit_json.write_lines(units, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 5
    empty = units.where("false")
    for suffix in ("tmx", "xliff", "csv", "po", "json"):
        files.write(empty, str(tmp_path / f"empty.{suffix}"))
    assert xliff.parse((tmp_path / "empty.xliff").read_bytes()) == []


def test_own_json_refuses_unknown_values():
    text = unit_json.dump([unit(unit_id="a", source="x", status="approved", targets={"fr": {"text": "y"}})])
    assert unit_json.parse(text)[0]["targets"]["fr"]["text"] == "y"
    with pytest.raises(ValueError, match="unknown status"):
        unit_json.parse(text.replace("approved", "odd"))
    assert regen.regen_tmx(TMX.encode(), {"a": "neu", "auto_1": "x"}, "fr-FR").decode().count("<seg>neu</seg>") == 1
    again = tmx.parse(regen.regen_tmx(TMX.encode(), {"a": "neu", "auto_1": "x"}, "fr-FR"), "fr-FR")
    assert [u["target"] for u in again] == ["neu", "Un", "x"]


def test_files_do_not_go_through_the_driver(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame as Frame

    def refuse(*_, **__):
        raise AssertionError("rows go to the driver")

    monkeypatch.setattr(Frame, "toLocalIterator", refuse)
    made = [unit(unit_id=f"k{i}", source=f"a, \"b\"\n{i}", target=f"c {i}", target_locale="fr", source_locale="en", ordinal=i, extensions={"resource": f"r{i // 2}"}) for i in range(5)]
    units = units_frame(spark, made)
    for suffix in ("tmx", "xliff", "csv", "xlsx", "po", "json", "html"):
        path = str(tmp_path / f"a.{suffix}")
        assert files.write(units.repartition(3), path) == (tmp_path / f"a.{suffix}").stat().st_size
        assert detect.read(spark, path).count() == 5, suffix
    assert (tmp_path / "a.xliff").read_text().count("<file ") == 3  # one for each resource, over all parts


def test_parsers_stream():
    """The first unit is there before the file has been read to its end."""
    many = [unit(unit_id=f"k{i}", source="word " * 20, target="mots " * 20, target_locale="fr", ordinal=i) for i in range(30_000)]
    rows = "\n".join(files.tmx_record(u) for u in many)
    made = {"tmx": f"<tmx version='1.4'><header srclang='en'/><body>{rows}</body></tmx>", "po": files.po_text(many, "fr"), "html": files.html_page(many, "fr"), "json": unit_json.dump(many)}
    for name, text in made.items():
        f = io.BytesIO(text.encode())
        units = detect.parse_file(f, f"a.{name}")
        first = next(iter(units))
        assert f.tell() < len(text) - 1_000_000, name
        assert [first, *units] == detect.parse_bytes(text.encode(), f"a.{name}")


def test_repeated_ids_of_own_json():
    text = '{"format_version": 1, "data": {"a": {"source": "x"}, "b": {"source": "y"}, "a": {"source": "z"}}}'
    assert [(u["unit_id"], u["source"], u["ordinal"]) for u in unit_json.parse(text)] == [("a", "z", 0), ("b", "y", 1)]


def test_xliff_merged_by_shuffle(spark, tmp_path):
    text = '<xliff version="1.2">' + "".join(f'<file source-language="en" target-language="{loc}" original="o"><body><trans-unit id="b"><source/><target>{loc} b</target></trans-unit><trans-unit id="a"><source>A</source><target>{loc} a</target><note>{loc}</note></trans-unit></body></file>' for loc in ("fr", "de")) + "</xliff>"
    (tmp_path / "a.xlf").write_text(text)
    found = {r.unit_id: r for r in xliff.read(spark, str(tmp_path / "a.xlf")).collect()}
    for u in xliff.parse(text.encode()):
        r = found.pop(u["unit_id"])
        assert (r.ordinal, r.source, r.target, r.target_locales, [c.context for c in r.comments]) == (u["ordinal"], u["source"], u["target"], u["target_locales"], [c["context"] for c in u["comments"]])
        assert {k: v.text for k, v in r.targets.items()} == {k: v["text"] for k, v in u["targets"].items()}
    assert not found


def test_rewrite_is_what_regeneration_of_bytes_gives(spark, tmp_path, monkeypatch):
    """Originals rewritten by executors, in many splits; no file is read whole."""
    from segmenta.sources import common

    def refuse(*_, **__):
        raise AssertionError("a whole file is read")

    monkeypatch.setattr(common, "read_files", refuse)
    two = '<xliff version="2.1" srcLang="en" trgLang="de"><file id="f"><unit id="u"><segment id="s"><source>x</source></segment><segment><source>y</source><target>z</target></segment></unit></file></xliff>\n'
    table = 'id,en,fr\na,"Hi, ""you""\nthere",Salut\nb,Yo,\n,No,\n'
    entries = PO.replace("\n\n", "\n \t\n\n", 1)
    cases = [
        ("a.tmx", TMX, regen.tmx_file("fr-FR"), {"a": "n<eu", "auto_1": "x"}, lambda c, t: regen.regen_tmx(c, t, "fr-FR")),
        ("a.xlf", XLIFF.replace("{loc}", "de"), regen.xliff_file(), {"u2": "Tschüs", "u1": "Ça"}, regen.regen_xliff),
        ("b.xlf", two, regen.xliff_file("2.1"), {"u:s": "neu & x", "u:0": "p"}, regen.regen_xliff),
        ("a.csv", table, regen.csv_file("fr"), {"b": "Oh, la", "csv:2": "x"}, lambda c, t: regen.regen_csv(c, t, "fr")),
        ("a.po", entries, regen.po_file(), {"one\tfile": "neu", "menu\x04file[2]": "fajlov"}, regen.regen_po),
    ]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        for name, text, kind, new, whole in cases:
            (tmp_path / name).write_bytes(text.encode())
            given = spark.createDataFrame(list(new.items()), "unit_id string, target string")
            regen.rewrite(spark, str(tmp_path / name), str(tmp_path / f"new-{name}"), given, kind)
            made = (tmp_path / f"new-{name}").read_bytes()
            assert made == whole(text.encode(), new) != text.encode(), name
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_workbook_rewritten_by_executors(spark, tmp_path):
    book = files.xlsx_bytes([["id", "en", "fr", "note"], ["a", "x & y", "z", "n"], [], ["b", "two\nlines", "", ""], ["", "no id", "", ""]])
    (tmp_path / "a.xlsx").write_bytes(book)
    new = {"a": "neu <1>", "xlsx:3": "o"}
    targets_ = spark.createDataFrame(list(new.items()), "unit_id string, target string")
    assert regen.rewrite_xlsx(spark, str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx"), targets_, "fr") > 0
    rows = tabular.xlsx_rows((tmp_path / "b.xlsx").read_bytes())
    assert rows == tabular.xlsx_rows(regen.regen_xlsx(book, new, "fr"))
    assert [r[2] for r in rows if r] == ["fr", "neu <1>", "", "o"] and rows[3][1] == "two\nlines"


def _rewritten_page(page: str, new: dict[str, str], size: int = 1 << 13) -> str:
    kind = regen.html_file()
    out = []
    for text, units in html.cut_units(io.BytesIO(page.encode()), size):
        own = {u[0]: new[u[0]] for u in units if u[0] in new}
        packed = json.dumps([units, text])
        out.append(kind.put(packed, own) if own else kind.plain(packed))
    return ">".join(out)


ODD_PAGE = (
    '<html lang="en"><head><title>Same</title><meta name="description" content="Same"></head><body data-x="a>b"><!-- > --><p>a > b<p>caf&eacute; <p>Same</p>'
    '<ul><li>x<p>x</p><li> own <ul><li>in</ul></ul><img src="x" data-alt="x" alt="x"><p><a href="x">x</a></p><p>a <b>c</b></p><script>1 > 0</script><p>last'
)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 13])
def test_pages_are_cut_and_rewritten_in_their_own_blocks(size):
    units = {u["unit_id"]: u["source"] for u in html.page_units(ODD_PAGE)}
    cut = [u for _, some in html.cut_units(io.BytesIO(ODD_PAGE.encode()), size) for u in some]
    assert {k: s.strip() for k, s, _, _ in cut} == {k: s.strip() for k, s in units.items()} and len(cut) == len(units)
    assert _rewritten_page(ODD_PAGE, {}, size) == ODD_PAGE
    new = {k: f"<{k}>" for k in units}
    got = {u["unit_id"]: u["source"] for u in html.page_units(_rewritten_page(ODD_PAGE, new, size))}
    split = next(k for k, s in units.items() if s == "a c")  # by an inline element: it stays
    assert got == new | {split: "a c"}
    assert _rewritten_page(ODD_PAGE, {"html:title:1": "New"}, size) == ODD_PAGE.replace("<title>Same", "<title>New")


def test_pages_are_rewritten_by_executors(spark, tmp_path):
    (tmp_path / "a.html").write_text("<body>" + "".join(f"<p>text {i % 7}</p>\n" for i in range(3000)))
    new = spark.range(3000).selectExpr("concat('html:p:', id) AS unit_id", "concat('new ', id) AS target").where("id % 2 = 0")
    regen.rewrite(spark, str(tmp_path / "a.html"), str(tmp_path / "b.html"), new, regen.html_file())
    assert (tmp_path / "b.html").read_text() == "<body>" + "".join(f"<p>{f'new {i}' if i % 2 == 0 else f'text {i % 7}'}</p>\n" for i in range(3000))
    assert max(len(text) for text, _ in html.cut_units((tmp_path / "a.html").open("rb"))) < 1 << 15
