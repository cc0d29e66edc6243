"""Document, graph, operations and model operators on small tables, against brute force."""

import base64
import random

import pytest
from pyspark.sql import functions as F

from quotemill.functions import text as tx
from quotemill.operators import documents as dc
from quotemill.operators import graph, models as md
from quotemill.operators import opslog as ops

EVIDENCE = "pos int, document_id string, document_label string, content_type string, file_name string, content_data_url string"


def test_evidence_is_decoded_or_falls_back(spark):
    b64 = lambda raw: "data:text/plain;base64," + base64.b64encode(raw).decode()
    rows = [
        (0, None, "Label", "text/plain", "a.txt", b64("Año 1\n\n\n\n2".encode())),
        (1, "x", "Label", None, "b.docx", "data:text/plain;base64,***"),
        (2, "y", "Label", "text/plain", "c.txt", "data:,1+1%20=%202"),
        (3, " ", "Label", None, None, None),
        (4, "z", None, None, "d.pdf", b64("Ñandú".encode("latin-1"))),
        (5, "w", None, "", "e.txt", "not base64!"),
    ]
    got = {r.pos: (r.document_id, r.format, r.status, r.text) for r in dc.resolve_evidence(spark.createDataFrame(rows, EVIDENCE)).collect()}
    assert got == {
        0: ("doc-1", "text", "decoded", "Año 1\n\n2"),
        1: ("x", "docx", "decode_error", "Label\nb.docx"),
        2: ("y", "text", "decoded", "1+1 = 2"),
        3: ("doc-4", "pdf", "empty", "Label"),
        4: ("z", "pdf", "decoded", "Ñandú"),
        5: ("w", "text", "decoded", "not base64!"),
    }
    assert dc.resolve_evidence(spark.createDataFrame([], EVIDENCE)).count() == 0


def test_pdf_literals(spark):
    raw = [(b"BT [(one) 3 (t\\(w\\)o)] TJ (first) Tj (a\\\\)Tj",), (b"\x00\x01plain run\x02ab\x03",), (b"",)]
    got = [r[0] for r in spark.createDataFrame(raw, "c binary").select(dc.pdf_literals(F.col("c"))).collect()]
    assert got == ["first\na\\\none\nt(w)o", "plain run", ""]


def test_rows_of_texts_become_items(spark):
    text = "Descripcion | Cantidad | Precio\nTubo | 3 | 1.50\n|only|\nMontaje  1  250.00  und  extra\nno digits  here  at all"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "a  b  9")], "k int, text string").select("k", dc.text_rows(F.col("text")).alias("rows"))
    got = [tuple(r) for r in dc.table_items(docs, "rows").orderBy("k", "item_id").collect()]
    assert got == [(1, "table-text-1-row-0", "Tubo", "3", "1.50", ""), (1, "table-text-1-row-1", "Montaje", "1", "250.00", "und"), (3, "table-text-1-row-0", "a", "b", "9", "")]
    assert [r[0] for r in docs.orderBy("k").select(F.size(dc.with_header(F.col("rows")))).collect()] == [3, 0, 2]


def test_latin_text_is_told_from_utf8(spark):
    got = spark.createDataFrame([("é".encode(),), ("é".encode("latin-1"),), (b"",), (None,)], "c binary").select(tx.decode_text(F.col("c"))).collect()
    assert [r[0] for r in got] == ["é", "é", "", None]


def test_store_takes_a_key_once(spark):
    stored = spark.createDataFrame([(1,), (1,)], "k int")
    new = spark.createDataFrame([(1, 1), (2, 2), (2, 1), (3, 5)], "k int, at int")
    assert {(r.k, r["at"], r.accepted) for r in dc.insert_unique(stored, new, "k", ["at"]).collect()} == {(1, 1, False), (2, 2, False), (2, 1, True), (3, 5, True)}
    assert {tuple(r) for r in dc.last_write(new, "k", ["at"]).collect()} == {(1, 1), (2, 2), (3, 5)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7)]
    up = list(range(200))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in nodes}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_positions_of_a_hot_lane(spark):
    rows = [(i, "hot" if i % 3 else f"l{i % 7}", i * 37 % 101) for i in range(500)]
    got = {r.event_id: r.position for r in ops.fifo_positions(spark.createDataFrame(rows, "event_id int, lane string, ts int").repartition(5), "lane", ["ts", "event_id"]).collect()}
    for lane in {r[1] for r in rows}:
        for place, r in enumerate(sorted((r for r in rows if r[1] == lane), key=lambda r: (r[2], r[0])), 1):
            assert got[r[0]] == place


def test_failures_and_phases(spark):
    rows = [("temporary", 3, "retry"), ("temporary", 4, "cancel"), ("permanent", 1, "terminal_failure"), (None, 1, "terminal_failure")]
    df = spark.createDataFrame(rows, "category string, attempt int, want string")
    assert df.where(~ops.recovery(F.col("category"), F.col("attempt")).eqNullSafe(F.col("want"))).count() == 0
    steps = [("cancel_analysis", None, "solicitud_recibida", True), ("cancel_analysis", "solicitud_recibida", "proceso_finalizado", False), ("query_status", "x", "error_controlado", True), ("no", None, "solicitud_recibida", False)]
    df = spark.createDataFrame(steps, "op string, a string, b string, want boolean")
    assert df.where(ops.valid_phase(F.col("op"), F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_audit_of_requests(spark):
    rows = [(1, "p", "start", None, None, None), (2, "p", "start", "d", None, None), (3, "p", "query_analysis_status", "d", "c", None), (4, "p", "query_analysis_status", "d", "c", None)]
    df = spark.createDataFrame(rows, "id int, process_id string, operation string, document string, content string, traceability string")
    got = {r.id: r.issues for r in ops.audit(df, ["document", "content", "traceability"], ["id"]).collect()}
    assert got == {1: ["incomplete_message"], 2: ["duplicate_message", "invalid_structure:content"], 3: [], 4: []}


def test_providers_and_scores(spark):
    docs = spark.createDataFrame([("p", "d1", "A"), ("p", "d2", "A"), ("q", "d1", None), ("q", "d2", " ")], "process_id string, document_id string, provider_id string")
    assert {tuple(r) for r in md.document_providers(docs).collect()} == {("p", 1, "A"), ("p", 2, "A"), ("q", 1, "PROVEEDOR-1")}
    rows = [("p", "A", 9, 5.0, 0), ("p", "B", 9, 4.5, 0), ("q", "A", 9, 5.0, 0), ("q", "B", 9, 1.0, 0)]
    scores = spark.createDataFrame(rows, "process_id string, provider_id string, evidence long, score double, missing long")
    assert {tuple(r) for r in md.recommendation(scores).collect()} == {("p", "equivalent_alternatives", None, 2), ("q", "clear_winner", "A", 0)}


def test_streamed_counts_equal_the_batch(spark):
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    got = entry.queries()["stream_event_counts"](spark, sf).agg(F.sum("n")).first()[0]
    assert got == spark.read.parquet(f"{sf}/events.parquet").count()
