"""Core operators: fixtures of the domain, and every registered query against its SQL."""

import base64
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quotemill.functions import text as tx
from quotemill.operators import analysis as an
from quotemill.operators import concepts as co
from quotemill.operators import tables as tb
from quotemill.plans import registry
from quotemill.streaming import queue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return tuple(v) if isinstance(v, list) else v

    return sorted((tuple(one(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = registry.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == cols
    assert plain(got.select(*cols).collect()) == plain(want.select(*(f'"{c}"' for c in cols)).fetchall())


def test_quotation_text_fields(spark):
    text = "COTIZACION\nProveedor: ALFA S.A.C.\nMoneda: USD\nTotal: 1500.00\nCondiciones de pago: 30 dias\nTubo de acero 304    100 kg    12.50\nMontaje en obra    1 und    250.00\nDescripcion  Cantidad"
    df = spark.createDataFrame([(text,)], "t string")
    t = F.col("t")
    row = df.select(tx.provider(t, F.lit("x"), F.lit("y")).alias("p"), tx.currency(t).alias("c"), tx.total(t).alias("n"), tx.payment_terms(t).alias("w")).first()
    assert tuple(row) == ("ALFA S.A.C", "USD", "1500.00", "30 dias")
    lines = df.select(F.posexplode(F.split("t", "\n")).alias("i", "l")).select("i", tx.item_fields(F.col("l")).alias("x")).where("x is not null")
    assert [(r.i, *r.x) for r in lines.orderBy("i").collect()] == [(5, "Tubo de acero 304", "100", "kg", "12.50"), (6, "Montaje en obra", "1", "und", "250.00")]


def test_currency_needs_a_word_character_after_a_sign(spark):
    rows = [("S/100", "PEN"), ("S/ 100", ""), ("precio $ 5", ""), ("5$9", "USD"), ("pen", "PEN"), (None, "")]
    got = spark.createDataFrame(rows, "t string, w string").select(tx.currency(F.col("t")).alias("c"), "w").collect()
    assert all(r.c == r.w for r in got)


def test_normalize_has_both_paths(spark):
    rows = [("  Ácero … (½\" x 6m) Ñandú ",), ("Arena FINA, lavada",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(tx.normalize(F.col("t"))).collect()]
    assert got == [tx.normalize_text(r[0]) for r in rows]


def test_decode(spark):
    rows = [("data:text/plain;base64," + base64.b64encode(b"hola").decode(), b"hola"), ("data:,a%20b", b"a b"), ("data:text/plain;base64,@@", None)]
    got = spark.createDataFrame(rows, "t string, w binary").select(tx.decode_data_url(F.col("t")).alias("b"), "w").collect()
    assert all(r.b == r.w for r in got)


def concepts(spark):
    rows = [("A", 1, "material", "arena fina"), ("B", 2, "material", "arena fina"), ("B", 3, "service", "arena fina"), ("A", 4, "material", "arena fina"), ("C", 5, "material", "")]
    return spark.createDataFrame([("p", d, i, t, v, i) for d, i, t, v in rows], "process_id string, document_id string, pos long, concept_type string, normalized_value string, origin long")


def test_pairs_and_groups(spark):
    c = concepts(spark)
    pairs = lambda k: sorted((r.a, r.b) for r in co.equivalence_pairs(c, k).collect())
    assert pairs("exact") == [(1, 2), (2, 4)]
    assert pairs("cross_type") == [(1, 3), (3, 4)]
    assert pairs("shared_origin") == []
    got = co.comparable_groups(c).collect()
    assert [(r.group_id, r.members_count, r.document_count) for r in got] == [("GC-000001", 3, 2)]


def test_source_map_and_cells(spark):
    docs = spark.createDataFrame([("p", "d1", "P1"), ("p", "d2", "P2"), ("p", "d3", "P2"), ("p", "d4", None), ("p", "d1", "P1")], "process_id string, document_id string, provider_id string")
    got = {r.provider_id: (r.document_count, r.duplicate_document_source) for r in tb.source_map(docs).collect()}
    assert got == {"P1": (1, False), "P2": (2, True), "d4": (1, False)}


def test_scenarios(spark):
    rows = [("a", "x", 9.0, 9, 0), ("a", "y", 5.0, 5, 0), ("b", "x", 5.0, 5, 0), ("b", "y", 4.0, 4, 0), ("c", "x", 5.0, 5, 0), ("c", "y", 3.5, 4, 0), ("d", "x", 1.0, 1, 9), ("e", "x", 1.0, 1, 0)]
    df = spark.createDataFrame(rows, "process_id string, provider_id string, score double, evidence long, missing long")
    got = {r.process_id: r.scenario for r in an.scenario(df).collect()}
    assert got == {"a": "clear_winner", "b": "equivalent_alternatives", "c": "clear_winner", "d": "insufficient_information", "e": "clear_winner"}


def test_streaming_queue(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    events = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withColumn("ts", F.col("ts").cast("timestamp"))
    q = queue.enqueue(events, "user_id", "1000 days").writeStream.format("memory").queryName("accepted").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    accepted = spark.table("accepted")
    assert accepted.count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()


def test_entry_module_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
