from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from orelode.operators.facts import normal_facts
from orelode.operators.graph import edges, nodes
from orelode.plans.pipeline import build
from orelode.sources import sinks
from orelode.sources.documents import manifest, scan_documents
from orelode.sources.extraction import extract
from orelode.sources.records import conclusions_of, facts_of, read_records, read_synonyms, record_stats
from orelode.streaming import submissions


def fact(**x):
    base = {"record_type": "fact", "source_file": "a__b.txt", "chunk_id": 1, "material": {"name": "Медный шлак"}, "process": {"name": "Обжиг"}, "conditions": [], "result": {"property": "Извлечение", "value": 95, "unit": "%"}, "context": {"lab_or_author": "Иванов; Петров", "equipment": "печь", "year": 2001}, "confidence": "High", "source_quote": "q"}
    return base | x


def test_records_and_graph(spark, tmp_path):
    lines = [json.dumps(fact(), ensure_ascii=False), "", "{broken", "[1]", json.dumps(fact(material={"name": "нет"}, result={"property": None})), json.dumps({"record_type": "conclusion", "text": "Вывод", "source_file": "a", "chunk_id": 2}), json.dumps({"record_type": "other"}), json.dumps(fact(material={"name": "шлак медь"}, source_file=None))]
    (tmp_path / "facts.jsonl").write_text("\n".join(lines), encoding="utf-8")
    (tmp_path / "syn.json").write_text(json.dumps({"медный шлак": ["шлак медь"], "x": []}), encoding="utf-8")
    records = read_records(spark, str(tmp_path / "facts.jsonl"))
    assert {r["kind"]: r["n"] for r in record_stats(records).collect()} == {"fact": 3, "conclusion": 1, "other": 1, "broken": 1, "value": 1}
    assert [r["text"] for r in conclusions_of(records).collect()] == ["Вывод"]
    facts = facts_of(records)
    assert facts.where("result_value = '95'").count() == 2
    normal = normal_facts(facts, read_synonyms(spark, str(tmp_path / "syn.json")))
    n = {r["node_id"]: r for r in nodes(normal).collect()}
    assert n["Material:медный шлак"]["mention_count"] == 2 and n["Material:медный шлак"]["aliases"] == ["Медный шлак", "шлак медь"]
    assert n["Material:медный шлак"]["base"] == "шлак" and n["Process:обжиг"]["mention_count"] == 3
    kinds = {r["edge_type"]: r["count"] for r in edges(normal).groupBy("edge_type").count().collect()}
    assert kinds == {"from_document": 2 + 3 + 6, "studied_in": 2, "yields": 2, "uses_equipment": 3, "expert_in": 6, "worked_on": 4}
    sinks.write_graph(nodes(normal), edges(normal), str(tmp_path / "graph"))
    a, b = sinks.read_graph(spark, str(tmp_path / "graph"))
    assert a.count() == len(n) and b.count() == sum(kinds.values())
    (tmp_path / "graph.json").write_text(sinks.node_link(nodes(normal), edges(normal), "2024-01-01T00:00:00Z"), encoding="utf-8")
    a, b = sinks.read_node_link(spark, str(tmp_path / "graph.json"))
    assert a.count() == len(n) and b.count() == sum(kinds.values())


def test_files(spark, tmp_path):
    root = tmp_path / "in"
    (root / "Отчёты").mkdir(parents=True)
    (root / "Отчёты" / "a.txt").write_text("Извлечение меди - 95,1 %.\r\n\n\n\nТекст", encoding="utf-8")
    (root / "b.bin").write_bytes(b"x")
    (root / "bad.docx").write_bytes(b"no archive")
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(root / "c.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Абзац</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>1</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>2</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    found = {r["file"]: r for r in scan_documents(spark, str(root)).collect()}
    assert found["Отчёты/a.txt"]["source_file"] == "Отчёты__a.txt.txt" and found["Отчёты/a.txt"]["status"] == "ok"
    assert found["c.docx"]["text"] == "Абзац\n1 | 2" and found["b.bin"]["reason"] == "unsupported type" and found["bad.docx"]["status"] == "error"
    assert manifest(scan_documents(spark, str(root), ("Отчёты",))).count() == 1
    synonyms = spark.createDataFrame([], "canonical_id int, canonical string, aliases array<string>")
    n, _ = build(spark, str(root), str(tmp_path / "work"), synonyms)
    assert n.where("node_type = 'Property'").count() == 1


def test_extractor_retries_and_keeps_failures(spark):
    chunks = spark.createDataFrame([("a", 1, "good"), ("b", 1, "bad"), ("c", 1, "raise")], "source_file string, chunk_id long, chunk string")

    def model(chunk):
        if chunk == "raise":
            raise OSError
        return '```json\n{"facts": [{"x": 1}, 2], "conclusions": 5}\n```' if chunk == "good" else "nothing"

    rows = extract(chunks, model).collect()
    assert [(r["source_file"], r["record_type"], r["failed"]) for r in rows] == [("a", "fact", None), ("b", None, "nothing")]


def test_markdown_and_jsonld(spark):
    df = spark.createDataFrame([(1, "a|b", None)], "id long, x string, y string")
    assert "a\\|b" in sinks.markdown_answer("t", {"p": df, "none": df.where("id > 1")})
    fields = "fact_id long, studied_id long, material string, process string, property string, result_value string, result_unit string, conditions array<struct<parameter:string,value:string,unit:string>>, source_file string, source_quote string, year string, confidence string, direction string, location_geo string, geo_scope string, lab_or_author string, equipment string, chunk_id int"
    rows = spark.createDataFrame([(1, 1, "шлак", "обжиг", "p", "1", None, [], "f", None, None, "high", None, "Чили", "foreign", "Иванов", "печь", 1)], fields)
    item = json.loads(sinks.jsonld_document([r["item"] for r in sinks.jsonld_facts(rows).collect()]))["@graph"][0]
    assert item["@id"].startswith("urn:ore:fact:") and len(item["@id"]) == 29 and "unit" not in item and "conditions" not in item
    assert (item["expert"], item["equipment"], item["locationGeo"], item["derivedFrom"]) == ("Иванов", "печь", "Чили", "urn:ore:Document%3Af")
    plain = json.loads(sinks.jsonld_facts(rows, links=False).first()["item"])
    assert plain["material"] == "шлак" and "derivedFrom" not in plain


def test_report_and_upload(spark, tmp_path):
    from orelode.operators.facts import normal_facts
    from orelode.sources.documents import read_upload
    from tests.test_engine import ROWS, SCHEMA

    synonyms = spark.createDataFrame([(1, "медный кек", ["кек меди"])], "canonical_id int, canonical string, aliases array<string>")
    normal = normal_facts(spark.createDataFrame(ROWS, SCHEMA), synonyms)
    rows = {(r["section"], r["name"]): r["n"] for r in sinks.report_rows(normal).collect()}
    assert rows["material mentions", None] == 6 and rows["material canonical", None] == 3 and rows["base group", "обжиг"] == 6 and rows["nodes", "Process"] == 1
    sinks.write_report(normal, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == len(rows)
    assert read_upload("..\\a b.TXT", "текст".encode())[3:5] == ("a_b.txt.txt", "текст") and read_upload("x.exe", b"")[6] == "skipped"


def test_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    row = lambda i, s, t, st: json.dumps({"row_id": i, "submission_id": s, "submitted_at": t, "status": st})
    (log / "1.json").write_text("\n".join([row(1, "a", "2024-01-02T00:00:00Z", "submitted"), row(2, "b", "2024-01-02T00:00:00Z", "submitted"), row(2, "b", "2024-01-02T00:00:00Z", "submitted")]))
    query = submissions.keep_status(submissions.read_log(spark, str(log)), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    query.processAllAvailable()
    (log / "2.json").write_text("\n".join([row(4, "a", "2024-01-03T00:00:00Z", "approved"), row(3, "a", "2024-01-01T00:00:00Z", "needs_review")]))
    query.processAllAvailable()
    query.stop()
    assert {r["submission_id"]: r["status"] for r in submissions.read_status(spark, str(tmp_path / "out")).collect()} == {"a": "approved", "b": "submitted"}
    submissions.set_status(spark, str(log), 9, "b", "rejected", "2024-02-01 00:00:00")
    now = submissions.current_status(submissions.read_log(spark, str(log), False))
    assert {r["submission_id"]: r["status"] for r in now.collect()} == {"a": "approved", "b": "rejected"}
    with pytest.raises(ValueError):
        submissions.set_status(spark, str(log), 10, "b", "unheard of", "2024-02-01 00:00:00")
    assert submissions.status_counts(submissions.read_log(spark, str(log), False)).where(F.col("status") == "submitted").first()["n"] == 3
