"""Equivalences of concepts that share positions, against the queries' SQL."""

import random

import duckdb
import pytest

from quotemill import store
from quotemill.operators import concepts as co
from quotemill.plans import registry
from quotemill.sources import quotations as src

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """The order tables with each line a second time, of a part whose key differs by 10,000: two concepts at each position."""
    at, con = tmp_path_factory.mktemp("crowded"), duckdb.connect()
    for t in ("orders", "supplier"):
        con.sql(f"copy (select * from '{SF}/{t}.parquet') to '{at}/{t}.parquet'")
    con.sql(f"copy (select * from '{SF}/lineitem.parquet' union all select * replace (l_partkey + 10000 as l_partkey) from '{SF}/lineitem.parquet') to '{at}/lineitem.parquet'")
    n = con.sql(f"select max(p_partkey) from '{SF}/part.parquet'").fetchall()[0][0]
    con.sql(f"copy (select * from '{SF}/part.parquet' union all select * replace ({n} - p_partkey + 10000 as p_partkey) from '{SF}/part.parquet') to '{at}/part.parquet'")
    return str(at)


def held_against_sql(spark, name, at):
    con = duckdb.connect()
    for t in ("orders", "supplier", "lineitem", "part"):
        con.sql(f"create view {t} as select * from '{at}/{t}.parquet'")
    got = registry.queries()[name](spark, at)
    cols = sorted(got.columns)
    want = con.sql(registry.oracle_sql()[name]).select(*(f'"{c}"' for c in cols)).fetchall()
    assert want and sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


def test_clusters_of_concepts_that_share_positions(spark, crowded):
    held_against_sql(spark, "union_find_groups", crowded)


def test_numbered_pairs_of_concepts_that_share_positions(spark, crowded):
    held_against_sql(spark, "equivalence_executor", crowded)


def made_up(spark, n, values, documents, positions, seed):
    rng = random.Random(seed)
    some = lambda xs, none=0.0: None if rng.random() < none else rng.choice(xs)
    rows = [(some(["p", "q", "é"], 0.05), some([f"d{i}" for i in range(documents)], 0.05), some(range(positions), 0.05), some(["material", "partida", "service"], 0.05), some(["", *(f"v{i}" for i in range(values))], 0.05), some(range(6), 0.05)) for _ in range(n)]
    return spark.createDataFrame(rows, "process_id string, document_id string, pos long, concept_type string, normalized_value string, origin long"), rows


def brute_force(rows, detectors):
    """Pairs of each detector by their definition, numbered in each process."""
    found = []
    for o, kind in enumerate(detectors):
        for p, d, x, t, v, g in rows:
            for p2, d2, y, t2, v2, g2 in rows:
                if None in (p, d, x, v, p2, d2, y, v2) or "" in (v, v2) or p != p2 or d == d2 or not x < y:
                    continue
                typed = None not in (t, t2)
                if {"exact": v == v2 and typed and t == t2, "cross_type": v == v2 and typed and t != t2, "shared_origin": None not in (g, g2) and g == g2 and v != v2, "all": x % 7 == y % 7}[kind]:
                    found.append((p, o, x, y, kind))
    at, out = {}, []
    for p, _, x, y, kind in sorted(found):
        at[p] = at.get(p, 0) + 1
        out.append((p, x, y, kind, at[p]))
    return sorted(out)


@pytest.mark.parametrize("positions", [40, 100_000])
def test_numbered_pairs_equal_brute_force(spark, positions):
    concepts, rows = made_up(spark, 260, 4, 5, positions, positions)
    every = lambda c: co.equivalence_pairs(c.withColumn("concept_type", co.F.lit("x")).withColumn("normalized_value", co.F.when(co.F.col("normalized_value") != "", (co.F.col("pos") % 7).cast("string"))), "exact")
    detectors = {"cross_type": co.pair_detector("cross_type"), "all": every, "exact": co.pair_detector("exact"), "shared_origin": co.pair_detector("shared_origin")}
    for names in (list(detectors), ["shared_origin"], ["exact", "all"], ["all"]):
        got = co.equivalences(concepts, {n: detectors[n] for n in names})
        assert sorted((r.process_id, r.a, r.b, r.detector, r.sequence) for r in got.collect()) == brute_force(rows, names)


def test_pairs_are_numbered_without_being_written(spark):
    rows = [("p", f"d{i % 9}", i * 3, "material" if i % 4 else "partida", "v", i % 2) for i in range(600)]
    concepts = spark.createDataFrame(rows, "process_id string, document_id string, pos long, concept_type string, normalized_value string, origin long")
    before = set(store._written)
    got = co.equivalences(concepts, {k: co.pair_detector(k) for k in co.RELATIONS})
    assert got.count() > 100_000
    assert sum(spark.read.parquet(at).count() for at in set(store._written) - before) < 10 * len(rows)


def test_numbered_pairs_do_not_depend_on_batches(spark, monkeypatch):
    for name, n in (("_TOGETHER", 7), ("_LOOKED_AT", 5), ("_MADE", 3)):
        monkeypatch.setattr(co, name, n)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        for positions in (30, 100_000):
            concepts, rows = made_up(spark, 200, 3, 4, positions, positions + 1)
            got = co.equivalences(concepts, {n: co.pair_detector(n) for n in co.RELATIONS})
            assert sorted((r.process_id, r.a, r.b, r.detector, r.sequence) for r in got.collect()) == brute_force(rows, list(co.RELATIONS))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def generated(plan):
    """Rows that the generators of an executed plan made."""
    own = plan.metrics().apply("numOutputRows").value() if plan.nodeName() == "Generate" else 0
    inner = [plan.executedPlan()] if plan.nodeName() == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in plan.nodeName() else [plan.children().apply(i) for i in range(plan.children().size())]
    return own + sum(map(generated, inner))


def test_hardly_more_rows_than_pairs_are_made(spark):
    rows = [("p", f"d{i % 9}", i * 3, "material" if i % 4 else "partida", "v", i % 2) for i in range(600)]
    concepts = spark.createDataFrame(rows, "process_id string, document_id string, pos long, concept_type string, normalized_value string, origin long")
    run = co.equivalences(concepts, {k: co.pair_detector(k) for k in co.RELATIONS})._jdf.queryExecution()
    pairs = run.toRdd().count()
    assert pairs > 100_000
    assert pairs <= generated(run.executedPlan()) < 1.1 * pairs


def test_a_text_is_normalised_once_for_a_part(spark, crowded):
    lines, parts = (spark.read.parquet(f"{crowded}/{t}.parquet").count() for t in ("lineitem", "part"))
    plan = src.item_values(spark, crowded)._jdf.queryExecution()
    assert plan.toRdd().count() == lines > 5 * parts

    def below(node, name):
        """What a Python node under ``node`` was given: the rows of the nodes below it."""
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        found = [node.metrics().apply("pythonNumRowsReceived").value()] if name in node.nodeName() else []
        return found + [x for i in inner for x in below(i, name)]

    python = below(plan.executedPlan(), "EvalPython")
    assert python and all(0 < n <= parts for n in python)
