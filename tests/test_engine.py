"""The facade, the registry of strategies and the reader of PDF files."""

import json
import time
import urllib.error
import urllib.request
import zlib

import pytest

from quotemill import engine as en
from quotemill.registry import Registry
from quotemill.sources import pdf


def test_runs_go_through_the_stages_and_retry():
    heard, tries = [], []

    def analyse(_, request):
        tries.append(request)
        if request.get("fail", 0) >= tries.count(request):
            raise en.Fault("again", request.get("category", "temporary"))
        return request["n"]

    e = en.Engine(None, analyse)
    e.observe(lambda event, run: heard.append((event, run.process_id)))
    assert e.submit({"n": 1}, process_id="a")["position"] == 1
    assert e.submit({"n": 1}, process_id="a")["message"] == "already_queued"
    assert e.submit({"n": 1}, source="web")["message"] == "rejected_source"
    e.submit({"n": 2, "fail": 2}, process_id="b")
    e.submit({"n": 3, "fail": 9}, process_id="c")
    e.submit({"n": 4, "fail": 1, "category": "validation"}, process_id="d")
    assert e.process_pending() == 4
    states = {p: (r.state, r.attempts) for p, r in e.runs.items()}
    assert states == {"a": ("completed", 1), "b": ("completed", 3), "c": ("cancelled", 4), "d": ("failed", 1)}
    assert e.status("a")["completed"] == list(en.STAGES) and e.result("b")["result"] == 2
    assert e.result("c")["message"] == "no_result" and e.status("x")["message"] == "process_not_found"
    assert heard.count(("retry", "b")) == 2 and ("completed", "a") in heard
    assert e.submit({"n": 5}, process_id="a")["success"]
    e.stop("a")
    assert e.process_pending() == 0 and e.status("a")["state"] == "stopped"
    assert en.Engine(None, analyse, depth=0).submit({"n": 1})["message"] == "queue_full"


def test_http_routes(spark):
    e = en.Engine(spark, lambda s, r: s.range(r["n"]))
    server = en.serve(e)
    at = f"http://127.0.0.1:{server.server_address[1]}"
    get = lambda path: json.load(urllib.request.urlopen(at + path))
    made = json.load(urllib.request.urlopen(urllib.request.Request(at + "/analyses", json.dumps({"n": 3, "process_id": "p"}).encode())))
    assert made["success"]
    for _ in range(100):
        if get("/analyses/p/status")["state"] == "completed":
            break
        time.sleep(0.1)
    assert get("/analyses/p/result")["result"] == [{"id": 0}, {"id": 1}, {"id": 2}] == get("/analyses/p")["result"]
    assert get("/health/motor")["status"] == "available" and get("/health/coordinator")["success"] and get("/")["service"]
    assert get("/info/version")["version"] and get("/info/modules")["count"] == 7 and get("/info/service")["runs"] == {"completed": 1}
    for path in ("/analyses/none", "/other"):
        with pytest.raises(urllib.error.HTTPError):
            get(path)
    server.shutdown()


def test_registry_extends_and_switches():
    r = Registry("s", {"a": len, "b": len})
    r.extend("c", sum, on=False)
    r.enable("a", False)
    assert list(r.enabled()) == ["b"] and [x["enabled"] for x in r.snapshot()] == [False, True, False]
    with pytest.raises(ValueError):
        r.extend("a", len)
    with pytest.raises(KeyError):
        r.enable("z")


def test_pdf_streams_and_errors():
    content = zlib.compress(b"BT /F1 12 Tf 72 700 Td (Caf\\351 \\(x\\)) Tj 0 -14 Td <FEFF00F1> Tj ET")
    made = lambda body: b"%PDF-1.4\n2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] >> endobj\n3 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 0 10 20] /Contents 5 0 R >> endobj\n4 0 obj << /Type /Page /Parent 2 0 R /Contents 6 0 R >> endobj\n5 0 obj << /Filter /FlateDecode >> stream\n" + content + b"\nendstream endobj\n6 0 obj << /Filter /FlateDecode >> stream\n" + body + b"\nendstream endobj"
    one, two = pdf.read_pdf(made(b"broken"))
    assert one[:5] == (1, 2, 10.0, 20.0, "Café (x)\nñ") and one[5] == ["Café", "(x)", "ñ"] and not one[9]
    assert two[0] == 2 and two[8] and two[9][0].startswith("page 2")
    assert pdf.read_pdf(None)[0][9] == ["not a PDF"] and pdf.read_pdf(b"%PDF-1.4")[0][9] == ["no pages"]


def test_pdf_files_of_a_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4\n3 0 obj << /Type /Page /Contents 5 0 R >> endobj\n5 0 obj << >> stream\nBT (hola) Tj ET\nendstream endobj")
    (tmp_path / "b.pdf").write_bytes(b"x")
    got = {r.document_id.rsplit("/", 1)[1]: r.text for r in pdf.pdf_files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": "hola", "b.pdf": ""}
