import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from galley.api import plan_folder, polish, rewrite_folder
from galley.operators.endpoints import choose_server, host_kind, http_rewriter


def test_polish(spark):
    rows = [(1, "He could not help but smile at the old red lamp."), (2, "A calm day in town."), (3, None), (4, ""), (5, "12")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id bigint, body string, text string")
    got = {r.id: r.new_text for r in polish(df, "id", "body").collect()}
    assert got == {1: "He smiled at the old red lamp.", 2: rows[1][1], 3: None, 4: "", 5: "12"}
    assert polish(df.limit(0), "id", "body").count() == 0


def test_folder(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nHe could not help but smile at the old red lamp.\n")
    (tmp_path / "b.txt").write_text("A calm day.\n\nShe suddenly discovered that the key was gone again.")
    assert plan_folder(spark, str(tmp_path)).filter("is_total = 1").first().dirty == 2
    assert {r.new_text for r in rewrite_folder(spark, str(tmp_path)).collect()} == {"T", "He smiled at the old red lamp.", "A calm day.", "She found that the key was gone again."}


def test_http_rewriter(spark):
    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            assert body["messages"][1]["content"] and body["max_tokens"] > 0
            data = json.dumps({"choices": [{"message": {"content": "[1]\nHe smiled at the old red lamp."}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = spark.createDataFrame([(1, "He could not help but smile at the old red lamp.")], "id bigint, text string")
    url = f"http://127.0.0.1:{server.server_port}/v1/chat/completions"
    assert polish(df, "id", "text", http_rewriter(url, "m", slots=1), retries=0).first().new_text == "He smiled at the old red lamp."
    server.shutdown()


def test_servers(spark):
    p = spark.createDataFrame([("r", 0, "a", True, False, None), ("r", 1, "b", False, True, None), ("r", 2, "c", False, False, "x vLLM"), ("s", 0, "d", False, False, "gpt"), ("t", 0, "e", False, False, None)], "run string, ord int, host string, tags boolean, props boolean, models string")
    p = p.withColumn("kind", host_kind(F.col("tags"), F.col("props"), F.col("models")))
    assert sorted((r.run, r.host, r.kind) for r in choose_server(p, "cuda").collect()) == [("r", "c", "vllm"), ("s", "d", "openai")]
    assert [r.host for r in choose_server(p, "cpu").filter("run = 'r'").collect()] == ["b"]


def test_modes_are_told_by_document(spark, tmp_path):
    (tmp_path / "a.txt").write_text("He could not help but smile at the old red lamp.")
    (tmp_path / "b.txt").write_text("Он улыбнулся и ушёл домой по тёмной дороге.")

    def upper(packs):
        key = "items" if "items" in packs.columns else "jobs"
        blocks = F.transform(key, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]\n"), F.replace(F.upper(x["text"]), F.lit("COULD NOT HELP BUT SMILE"), F.lit("SMILED"))))
        return packs.select("chunk_id", "attempt", F.array_join(blocks, "\n").alias("raw"))

    got = {r.new_text for r in rewrite_folder(spark, str(tmp_path), upper, retries=0, mode="auto").collect()}
    assert got == {"HE SMILED AT THE OLD RED LAMP.", "ОН УЛЫБНУЛСЯ И УШЁЛ ДОМОЙ ПО ТЁМНОЙ ДОРОГЕ."}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from galley import __main__ as cli

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\nHe could not help but smile at the old red lamp.\n")
    (tmp_path / "g.json").write_text('{"terms": [{"source": "lamp", "target": "lantern"}]}')
    cli.main(["plan", str(tmp_path / "in")])
    cli.main(["apply", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--glossary", str(tmp_path / "g.json")])
    assert (tmp_path / "out" / "a.polished.md").read_text() == "# T\n\nHe smiled at the old red lantern.\n"
    cli.main(["devices", "12000"])
    out = capsys.readouterr().out
    assert "all\t2 paragraphs\t1 to rewrite" in out and "1 files" in out and "max_params_b 14.0" in out
    monkeypatch.setattr(cli, "listed_models", lambda url: ["big-70b", "mid:14b", "qwq:14b"])
    cli.main(["models", "--url", "http://x/v1/chat/completions"])
    assert "* mid:14b" in capsys.readouterr().out
    monkeypatch.setattr(cli, "listed_models", lambda url: [])
    with pytest.raises(cli.EngineError):
        cli.chosen_model(spark, "u", None, 14.0)
