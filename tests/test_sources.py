"""Sources and sinks."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.sources import benchmark, config, files, rules
from lectern.streaming import leaderboard

RECORD = {"record_index": 1, "example_count": 2, "file_name": "a.pdf", "file_stem": "a", "parse_token_usage": {"requests": 1, "prompt_tokens": 2, "completion_tokens": 3, "total_tokens": 5}, "source_text": "[1] 范围\n甲", "examples": [
    {"dimension": "C2.1", "error_type": "E-S-01", "original": {"section_number": "1", "title": "范围", "content": "甲"}, "corrupted": None, "error_description": "缺"},
    {"dimension": "C3.1", "error_type": "E-T-01", "original": {"section_number": "2", "title": "乙", "content": "应"}, "corrupted": {"section_number": None, "title": "乙", "content": "宜"}, "error_description": "错"},
]}


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "in.json").write_text(json.dumps({"total_files": 2, "documents": [RECORD, RECORD | {"source_text": "  "}]}, ensure_ascii=False).replace("范围\\n", "范围\t"))
    docs = benchmark.read_benchmark(spark, str(tmp_path / "in.json"))
    assert docs.count() == 2 and benchmark.read_benchmark(spark, str(tmp_path / "in.json"), 1).count() == 1
    items = benchmark.ground_truth(docs).where("doc_id like '%#0'").orderBy("gt_index").collect()
    assert [(r["section_number"], r["content"]) for r in items] == [("1", "甲"), (None, "宜")]
    status = docs.select("doc_id", F.lit(True).alias("reviewed"))
    assert benchmark.scored_documents(docs, status).count() == 1
    benchmark.write_construction(docs, docs.select("doc_id"), docs.select("doc_id", "source_text"), str(tmp_path / "out"))
    totals = spark.read.json(str(tmp_path / "out/benchmark_totals")).first()
    assert (totals["total_files"], totals["total_examples"], totals["error_type_counts"]["E-S-01"]) == (2, 4, 2)
    assert spark.read.json(str(tmp_path / "out/benchmark")).where("example_count = 2 and record_index in (1, 2)").count() == 2


def test_annotations(spark):
    a = spark.createDataFrame([("d", 0, "C2.1", "E-S-01", ("1", "范围", "甲"), None, "缺")], "doc_id string, ord int, dimension string, error_type string, original struct<section_number:string,title:string,content:string>, corrupted struct<section_number:string,title:string,content:string>, error_description string")
    assert benchmark.annotation_text(a).first()["annotation"] == "# 反例标注清单\n\n## [1] 维度: C2.1  错误类型: E-S-01\n位置: [1] 范围\n说明: 缺\n"
    s = spark.createDataFrame([("d", 0, "1", "范围", "甲")], "doc_id string, ord int, section_number string, title string, content string")
    assert json.loads(benchmark.example_json(a, s).first()["json"])["total_errors"] == 1
    assert benchmark.source_records(s, s.select("doc_id", F.lit("t").alias("source_text"))).first()["section_count"] == 1


def test_rules(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id":"a","text":" x ","metadata":{"dimension":"C3.1"}}\n\n{"text":"y"}\n')
    found = {r["id"]: (r["text"], r["metadata"]) for r in rules.read_rules(spark, str(tmp_path / "r.jsonl")).collect()}
    assert found == {"a": ("x", {"dimension": "C3.1"}), "rule_3": ("y", {})}
    for text in ("one", "two"):
        rules.seed(spark.createDataFrame([(text,)], "text string"), str(tmp_path / "store"))
    assert [r["text"] for r in spark.read.parquet(str(tmp_path / "store")).collect()] == ["one"]


def test_settings(tmp_path, monkeypatch):
    assert config.parse_env("# c\nexport A = 'x y'\nB=\"z\nnone\n =q\nC= 1 \n") == {"A": "x y", "B": '"z', "C": "1"}
    (tmp_path / ".env").write_text("LECTERN_T= yes \n")
    monkeypatch.delenv("LECTERN_T", raising=False)
    config.load_env(str(tmp_path / ".env"))
    assert config.env_flag("LECTERN_T") and config.env_text("LECTERN_T") == "yes" and config.env_text("LECTERN_NONE", "d") == "d"
    monkeypatch.delenv("LECTERN_T")


def test_models(spark):
    m = spark.createDataFrame([("b", "y", {"chat": True}), ("a", "x", {"chat": True}), ("a", "z", {"chat": False})], "backend string, model_id string, capabilities map<string,boolean>")
    assert [r["model_id"] for r in config.capable_models(m, "chat").collect()] == ["x", "y"]


def _docx() -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, bold="": f"<w:p><w:r><w:rPr>{bold}</w:rPr><w:t>{t}</w:t></w:r></w:p>"
    body = p("封面") + p("1 范围", "<w:b/>") + p("甲") + "<w:tbl><w:tr><w:tc>" + p("格") + "</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(_docx())
    found = files.scan(spark, str(tmp_path), "*.docx")
    rows = files.docx_paragraphs(found).orderBy("index").collect()
    assert [(r["text"], r["section"], r["section_title"], r["is_bold"]) for r in rows] == [("封面", "", "", False), ("1 范围", "1", "范围", True), ("甲", "1", "范围", False)]
    assert files.docx_cells(found).first()["text"] == "格"
    assert found.select(files.file_format(F.col("path"))).first()[0] == "docx"
    with pytest.raises(Exception, match="unsupported"):
        spark.range(1).select(files.file_format(F.lit("a.txt"))).collect()


def test_pdf_route(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes("封面\f目次\n1 范围.....1\n1 范围\n甲\n1.1 细则\n乙\n附录A 方法\n丙".encode())
    pages = files.page_texts(files.scan(spark, str(tmp_path)), lambda b: b.decode().split("\f"))
    assert [(r["section_number"], r["title"], r["content"]) for r in files.sections_of_pages(pages).orderBy("ord").collect()] == [("1", "范围", "甲"), ("1.1", "细则", "乙"), (None, "附录A 方法", "丙")]
    assert files.page_chunks(pages, 1).count() == 2
    assert spark.range(1).select(files.strategy(F.lit("本标准"), True), files.strategy(F.lit("????"), True), files.strategy(F.lit("x"), False)).first()[:] == ("text", "vision", "regex")


def test_markdown(spark):
    d = spark.createDataFrame([("d", "前文\n# 1 范围\n甲\n## 附录A 方法\n乙")], "doc_id string, markdown string")
    assert [(r["section_number"], r["title"], r["content"]) for r in files.sections_of_markdown(d).orderBy("ord").collect()] == [("1", "范围", "甲"), ("附录A", "方法", "乙")]


def test_running_metrics(spark, tmp_path):
    schema = "doc_id string, team string, gt_count bigint, pred_count bigint, location_hits bigint, dimension_hits bigint, diagnosis_hits bigint"
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "x", 2, 2, 2, 2, 1), ("b", "x", 2, 0, 0, 0, 0)], schema).write.json(src)
    stream = spark.readStream.schema(schema).json(src)
    q = leaderboard.running_metrics(stream, "team").writeStream.outputMode("complete").format("memory").queryName("board").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("board").first()["diagnosis_recall"] == 0.25
    w = leaderboard.append_totals(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    w.processAllAvailable()
    w.stop()
    assert spark.read.parquet(str(tmp_path / "out")).first()["gt_count"] == 4


def test_windowed_counts_drop_late_findings(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "at timestamp, error_type string"
    put = lambda *rows: spark.createDataFrame([(t, "E") for t in rows], "at string, error_type string").selectExpr("cast(at as timestamp) as at", "error_type").write.mode("append").json(src)
    put("2024-01-01 00:01:00", "2024-01-01 00:02:00")
    counts = leaderboard.windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).json(src), "at", "10 minutes", "5 minutes", "error_type")
    q = counts.writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    put("2024-01-01 01:00:00")
    q.processAllAvailable()
    put("2024-01-01 00:03:00", "2024-01-01 02:00:00")  # the first comes after its window's end and lateness
    q.processAllAvailable()
    q.stop()
    assert [(str(r["start"]), r["n"]) for r in spark.table("windows").orderBy("start").collect()] == [("2024-01-01 00:00:00", 2), ("2024-01-01 01:00:00", 1)]


def test_http_client(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lectern.sources import clients

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            said = json.dumps({"choices": [{"message": {"content": body["messages"][-1]["content"] + self.headers["Authorization"]}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        assert clients.chat(f"http://127.0.0.1:{server.server_port}", "m", "k")("甲") == "甲Bearer k"
    finally:
        server.shutdown()
