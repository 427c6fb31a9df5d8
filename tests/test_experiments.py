import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sparkpanel import common
from sparkpanel.operators import graph, panel, retrieval
from sparkpanel.plans import evidence, experiments


def _greedy(groups, k, clean, false):
    counts, out = [[0, 0] for _ in range(k)], []
    for a, b in groups:
        def error(i):
            made = [c[:] for c in counts]
            made[i][0] += a
            made[i][1] += b
            return sum((k * x - clean) ** 2 + (k * y - false) ** 2 for x, y in made), max(map(sum, made)), i

        i = min(range(k), key=error)
        counts[i][0] += a
        counts[i][1] += b
        out.append(i)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_folds_are_dealt_greedily(seed):
    rng = random.Random(seed)
    kinds = {(rng.randint(0, 3), rng.randint(0, 3)): rng.randint(1, 40) for _ in range(6)}
    kinds.pop((0, 0), None)
    ordered = sorted(((a, b, m) for (a, b), m in kinds.items()), key=lambda g: (-max(g[:2]), -g[0] - g[1], -g[0]))
    flat = [(a, b) for a, b, m in ordered for _ in range(m)]
    totals = sum(a for a, _ in flat), sum(b for _, b in flat)
    dealt = []
    for (a, b, first, cycle), (_, _, m) in zip(graph._dealt(ordered, 4, *totals), ordered):
        dealt += [first[i] if i < len(first) else cycle[(i - len(first)) % len(cycle)] for i in range(m)]
    assert dealt == _greedy(flat, 4, *totals)


def test_folds_of_tables(spark):
    groups = spark.createDataFrame([(f"g{i}", 1, 1) for i in range(10)], "root string, n_clean bigint, n_false bigint")
    assert {r.n for r in graph.folds(groups, 5, exact=True).groupBy("fold").agg(F.count("*").alias("n")).collect()} == {2}
    with pytest.raises(ValueError):
        graph.folds(groups.limit(7), 5, exact=True)
    assert graph.folds(groups.limit(0), 5).count() == 0
    chain = spark.createDataFrame([(f"i{k:02}", d) for k in range(40) for d in (k, k + 1)], "item string, doc int")
    with pytest.raises(RuntimeError):
        graph.components(chain, rounds=1)


def test_first_row_of_a_group(spark):
    rows = spark.createDataFrame([("x", 2, "b"), ("x", 1, "c"), ("x", None, "a"), (None, 3, "d"), ("y", None, "e")], "k string, rank int, id string")
    assert {(r.k, r.id) for r in panel.first_rows(rows, ["k"], ["rank", "id"]).collect()} == {("x", "c"), (None, "d"), ("y", "e")}


def test_retrieval_against_gold(spark):
    docs = spark.createDataFrame([(1, "Red foxes run. Blue whales swim.\nGreen frogs jump!"), (2, "Foxes sleep. Whales dive in the blue sea."), (3, None), (4, "")], "doc_id bigint, text string")
    refs = spark.sql("""select * from values (20, 'foxes run', array(named_struct('doc_id', 1L, 'sent_idx', 0))), (40, 'whales', array(named_struct('doc_id', 1L, 'sent_idx', 1), named_struct('doc_id', 1L, 'sent_idx', 2))),
        (60, 'nothing here', array(named_struct('doc_id', 9L, 'sent_idx', 0), named_struct('doc_id', 1L, 'sent_idx', 7))), (80, null, cast(null as array<struct<doc_id: bigint, sent_idx: int>>)) as t(seq, statement, gold_evidence)""")
    pool = retrieval.sentence_pool(docs)
    assert {r.doc_id: r.text for r in pool.collect()} == {1_000_000: "Red foxes run.", 1_000_001: "Blue whales swim.", 1_000_002: "Green frogs jump!", 2_000_000: "Foxes sleep.", 2_000_001: "Whales dive in the blue sea."}
    found = retrieval.bm25(pool, refs.select(F.col("seq").alias("query_id"), F.col("statement").alias("text")))
    got = {r.seq: (r.any1, r.any3, r.complete1, r.complete3) for r in retrieval.hits(found, refs).collect()}
    assert got == {20: (True,) * 4, 40: (True, True, False, False), 60: (False,) * 4, 80: (False,) * 4}
    made = {(r.seq, r.condition): r.reference for r in retrieval.assembled(found, pool, refs, docs).collect()}
    assert made[20, "bm25_1"] == "Red foxes run." and made[20, "bm25_3"] == "Red foxes run. Foxes sleep." and made[40, "oracle_sentence"] == "Blue whales swim. Green frogs jump!"
    assert made[40, "oracle_abstract"] == "Red foxes run. Blue whales swim. Green frogs jump!" and made[60, "oracle_sentence"] == made[80, "oracle_abstract"] == made[60, "bm25_1"] == "" and len(made) == 16


def test_regimes_add_up_to_all_splits(spark):
    folder = "/root/testdata/sf0.001"
    summed = experiments.regime_summary(spark, folder).groupBy("family", "policy").agg(F.sum("n_splits").alias("n"))
    assert {r.n for r in summed.collect()} == {10}
    months = experiments.window_recalibration(spark, folder).orderBy("month").collect()
    assert all(m.routed == (m.accepts if m.last_flag else 0) for m in months) and all(m.last_flag == before.flag for before, m in zip(months, months[1:]))


@pytest.mark.parametrize("name", ["sentence_topk", "reference_assembly", "reference_tokens", "retrieval_recall"])
def test_evidence_queries_write_no_pairs(spark, tmp_path, monkeypatch, name):
    told = [" ".join(f"These sentences share words {'and more ' * ((d + k) % 4)}in place {k} of {d}." for k in range(10)) for d in range(40)]
    docs = pa.table({"doc_id": range(40), "text": told})
    gold = pa.array([[{"doc_id": q % 40, "sent_idx": q % 12}] for q in range(100)], pa.list_(pa.struct([("doc_id", pa.int64()), ("sent_idx", pa.int32())])))
    refs = pa.table({"seq": range(0, 2000, 20), "item_id": [f"i{q}" for q in range(100)], "statement": [f"these words share place {q % 10} of {q % 40}" for q in range(100)], "is_corrupted": [q % 2 == 0 for q in range(100)], "gold_evidence": gold})
    con, sizes = duckdb.connect(), {}
    for table, rows in (("documents", docs), ("retrieval_refs", refs)):
        pq.write_table(rows, tmp_path / f"{table}.parquet")
        con.register(table, rows)

    def written(frame, label):
        out = common.written(frame, label)
        sizes[label] = out.count()
        return out

    for module in (retrieval, evidence):
        monkeypatch.setattr(module, "written", written)
    got = evidence.QUERIES[name](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(evidence.SQL[name]).fetchall())
    assert sizes and max(sizes.values()) <= 400  # 40,000 pairs share words


@pytest.mark.parametrize("name", ["sentence_topk", "reference_assembly"])
def test_evidence_queries_ask_for_every_reference(spark, tmp_path, name):
    told = [f"Fox {d % 11} runs. Hen {d % 7} sleeps {'long ' * (d % 4)}in barn {d}.\nBoth eat!" for d in range(30)]
    docs = pa.table({"doc_id": range(30), "text": told})
    gold = pa.array([[{"doc_id": q % 31, "sent_idx": q % 4}, {"doc_id": q % 5, "sent_idx": 0}] for q in range(46)], pa.list_(pa.struct([("doc_id", pa.int64()), ("sent_idx", pa.int32())])))
    refs = pa.table({"seq": range(1, 47), "item_id": [f"i{q}" for q in range(46)], "statement": [None, "nothing"] + [f"the fox {q % 11} met hen {q % 5} in barn {q % 30}" for q in range(44)], "is_corrupted": [q % 2 == 0 for q in range(46)], "gold_evidence": gold})
    con = duckdb.connect()
    for table, rows in (("documents", docs), ("retrieval_refs", refs)):
        pq.write_table(rows, tmp_path / f"{table}.parquet")
        con.register(table, rows)
    got = sorted(map(tuple, evidence.QUERIES[name](spark, str(tmp_path)).collect()))
    assert {*range(3, 47)} <= {r[0] for r in got}
    assert got == sorted(con.sql(evidence.SQL[name]).fetchall())
