import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkpanel import common
from sparkpanel.functions import text as X
from sparkpanel.operators import graph, judges, retrieval
from sparkpanel.plans import texts
from sparkpanel.sources import files
from sparkpanel.streaming import log as stream


def _one(spark, expr, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("It is TRUE.", "true"), ("untrue", "parse_fail"), (None, "parse_fail"), ("False, not true", "false")])
def test_parse_truth(spark, raw, want):
    assert _one(spark, X.parse_truth(F.col("t")), t=raw) == want


@pytest.mark.parametrize(("number", "kind", "want"), [("1984", "year", "1986"), ("1985", "year", "1983"), ("1,000", "integer", "1,200"), ("11", "integer", "9"), ("0", "integer", "1"), ("1", "integer", "2"), ("2.50", "decimal", "3.00"), ("3.5", "decimal", "2.8"), ("x", "integer", None)])
def test_corrupted_numbers(spark, number, kind, want):
    assert _one(spark, X.corrupted_number(F.col("n"), F.col("k")), n=number, k=kind) == want


def test_text_functions(spark):
    assert _one(spark, X.atomic_reject(F.col("t")), t="One two three four five six.") is None
    assert _one(spark, X.atomic_reject(F.col("t")), t="It has about ten of these things.") == "hedge"
    assert _one(spark, X.atomic_reject(F.col("t")), t="Too short.") == "length"
    assert _one(spark, X.entities(F.col("t")), t="Alone we saw Bank of Norway and the Mt Foo in Paris") == ["Bank of Norway and the Mt Foo", "Paris"]
    assert _one(spark, X.norm(F.col("t")), t="  It’s A--B ") == "it s a b"
    assert _one(spark, X.match_case(F.col("a"), F.col("b")), a="Old", b="new") == "New" and _one(spark, X.match_case(F.col("a"), F.col("b")), a="OLD", b="new") == "NEW"
    assert _one(spark, X.article_matches(F.lit("an"), F.col("w")), w="odd") and not _one(spark, X.article_matches(F.lit("a"), F.col("w")), w="odd")
    assert _one(spark, X.replaced(F.col("t"), F.lit(3), F.lit(5), F.lit("xyz")), t="ab 12 c") == "ab xyz c"
    assert _one(spark, X.changed_numbers(F.col("a"), F.col("b")), a="1 and 2", b="1 and 3") == "accepted" and _one(spark, X.changed_numbers(F.col("a"), F.col("b")), a="1 and 2", b="2 and 3") == "not_exactly_one_number_changed"
    assert _one(spark, X.valid_day(F.lit("February"), F.lit(29))) and not _one(spark, X.valid_day(F.lit("April"), F.lit(31)))
    assert _one(spark, X.obvious_number(F.col("n"), F.lit("integer"), F.col("s")), n="12", s="On March 12 it rained") == "99" and _one(spark, X.obvious_number(F.col("n"), F.lit("year"), F.col("s")), n="1950", s="In 1950") == "3026"
    assert _one(spark, X.strip_json(F.col("t")), t='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}' and _one(spark, X.parse_choice(F.col("t")), t="a tie") == "A"
    values, key = ["a", "b", "c"], "k"
    at = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % 3
    assert _one(spark, X.rotated(F.array(*map(F.lit, values)), F.lit(key))) == values[at:] + values[:at]
    rows = spark.createDataFrame([("It cost 250 pounds in all",), ("Between 10 to 20",), ("windows 95 came out",), (None,), ("7 days",)], "t string")
    assert [r.x.text for r in rows.select(X.single_number("t").alias("x")).collect()] == ["250", None, None, None, None]


def test_bm25_against_brute_force(spark):
    docs = [(1, "the cat sat on the mat"), (2, "a dog and a cat"), (3, ""), (4, None), (5, "the the the dog"), (6, "Été à la plage cat")]
    queries = [(1, "the cat the"), (2, "été"), (3, None), (4, "zebra")]
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    n, avg = len(docs), sum(len(words(t)) for _, t in docs) / len(docs)
    df = {w: sum(w in words(t) for _, t in docs) for _, d in docs for w in words(d)}
    want = {}
    for q, text in queries:
        score = {}
        for d, t in docs:
            ws = words(t)
            s = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avg)) for w in words(text) if w in ws)
            if s:
                score[d] = round(s, 9)
        for rank, (d, s) in enumerate(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:3], 1):
            want[(q, d)] = (s, rank)
    got = retrieval.bm25(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string"))
    assert {(r.query_id, r.doc_id): (pytest.approx(r.score, abs=1e-8), r["rank"]) for r in got.collect()} == want


def _ranked(docs, queries, k=3):
    """{(query, doc): (score, rank)} by the definition: postings are counted by doc_id, length and word, n and the mean length by row."""
    split = [(d, re.findall(r"\w+", (t or "").lower())) for d, t in docs]
    mean, tf, asked = sum(len(ws) for _, ws in split) / len(split), Counter((d, len(ws), w) for d, ws in split for w in ws), {}
    df, want = Counter(w for _, _, w in tf), {}
    for q, t in queries:
        asked.setdefault(q, []).extend(re.findall(r"\w+", (t or "").lower()))
    for q, words in asked.items():
        score = Counter()
        for (d, dl, w), n in tf.items():
            score[d] += words.count(w) * math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5) + 1) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / mean))
        best = sorted(((-round(s, 9), d is not None, d) for d, s in score.items() if s))[:k]
        want |= {(q, d): (pytest.approx(-s, abs=1e-8), rank) for rank, (s, _, d) in enumerate(best, 1)}
    return want


def test_bm25_writes_no_pairs(spark, monkeypatch):
    docs = [(k, "all of these documents share their words " + "and some more " * (k % 7) + f"number {k % 50}") for k in range(300)]
    queries = [(k, f"documents share these words and number {k}") for k in range(100)]
    sizes = {}

    def written(frame, label):
        out = common.written(frame, label)
        sizes[label] = out.count()
        return out

    monkeypatch.setattr(retrieval, "written", written)
    got = retrieval.bm25(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string"))
    assert {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in got.collect()} == _ranked(docs, queries)
    assert sizes and max(sizes.values()) <= 300  # 30,000 pairs share words


def test_bm25_reads_texts_of_one_identifier_together(spark):
    docs = [(1, "red fox"), (1, "red hen"), (1, "a long tale of one red fox"), (2, "red fox fox"), (None, "fox"), (None, "hen and fox"), (3, "tale")]
    queries = [(1, "red fox"), (1, "tale"), (None, "hen"), (2, "")]
    got = retrieval.bm25(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(queries, "query_id bigint, text string"))
    assert {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in got.collect()} == _ranked(docs, queries)


@pytest.mark.parametrize("held", [40, 300, 10**6])
def test_bm25_answers_do_not_depend_on_the_parts(monkeypatch, held):
    monkeypatch.setattr(retrieval, "_POSTINGS", held)
    monkeypatch.setattr(retrieval, "_DENSE", 8 * 40)
    pick = random.Random(held)
    words = pa.array([f"w{k:02}" for k in range(40)])
    text = lambda most: " ".join(f"w{min(int(pick.expovariate(0.15)), 39):02}" for _ in range(pick.randint(0, most)))
    docs, queries = [(d, text(12)) for d in pick.sample(range(1000), 200)] + [(2000 + d, "w01 w02 w09") for d in range(5)], [(q, text(9)) for q in range(60)] + [(99, "w01 w02 w09")]
    split = [t.split() for _, t in docs]
    df = np.array([sum(w in ws for ws in split) for w in words.to_pylist()])
    idf = np.log((len(docs) - df + 0.5) / (df + 0.5) + 1)
    counts = [Counter(t.split()) for _, t in queries]
    asked = retrieval._questions(pa.table({"query_id": [q for q, _ in queries], "terms": pa.array([list(c) for c in counts], pa.list_(pa.string())), "times": pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))}), words, idf)
    batches = [retrieval._encoded(pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in docs[a : a + 20]], "t": pa.array(split[a : a + 20], pa.list_(pa.string()))}), words).select(["doc_id", "ids", "tfs", "dls"]) for a in range(0, len(docs), 20)]
    found = {}
    for out in retrieval._answers(iter(batches), asked, len(words), sum(map(len, split)) / len(split), 3):
        for r in out.to_pylist():
            found.setdefault(r["query_id"], []).append((-r["score"], r["doc_id"]))
    assert {(q, d): (-s, rank) for q, x in found.items() for rank, (s, d) in enumerate(sorted(x)[:3], 1)} == _ranked(docs, queries)


def test_bm25_topk_asks_for_every_reference(spark, tmp_path):
    docs = pa.table({"doc_id": range(30), "text": [f"the tale of fox {d % 11} and hen {d % 7}, told {'again ' * (d % 4)}" for d in range(30)]})
    refs = pa.table({"seq": [*range(1, 46), None], "statement": [None, ""] + [f"the fox {q % 11} met hen {q % 5} {'hen ' * (q % 3)}" for q in range(44)]})
    con = duckdb.connect()
    for name, rows in (("documents", docs), ("retrieval_refs", refs)):
        pq.write_table(rows, tmp_path / f"{name}.parquet")
        con.register(name, rows)
    key = lambda r: (r[0] is None, r)
    got = sorted(map(tuple, texts.QUERIES["bm25_topk"](spark, str(tmp_path)).collect()), key=key)
    assert {r[0] for r in got} == {*range(3, 46), None}
    assert got == sorted(con.sql(texts.SQL["bm25_topk"]).fetchall(), key=key)


def test_components_and_folds(spark):
    links = [("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 9), ("e", 8), ("f", 8), (None, 8), ("g", None)] + [(f"x{k:02}", 100 + k + d) for k in range(20) for d in (0, 1)]
    got = {r.item: r.root for r in graph.components(spark.createDataFrame(links, "item string, doc int")).collect()}
    assert {k: v for k, v in got.items() if len(k) == 1} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e"}
    assert {v for k, v in got.items() if k[0] == "x"} == {"x00"}
    groups = spark.createDataFrame([(f"r{k}", k % 2, (k + 1) % 2) for k in range(23)], "root string, n_clean bigint, n_false bigint")
    sizes = [r["count"] for r in graph.folds(groups, 5).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n{"id": "y"}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])
    assert sorted(r.id for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), schema).collect()) == ["x", "y"]
    (tmp_path / "b.jsonl").write_text('{"id": "x"}\n{broken\n')
    assert [r.id for r in files.read_jsonl(spark, str(tmp_path / "b.jsonl"), schema, strict=False).collect()] == ["x"]
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), schema).collect()
    (tmp_path / "c.tsv").write_text("a\tb\tc\nx\ty\n")
    assert files.read_tsv(spark, str(tmp_path / "c.tsv")).count() == 1
    (tmp_path / "d.md").write_text("# t\n- audit_code: ok\n- audit_code:\n- audit_code: bad\n")
    codes = files.audit_codes(spark, str(tmp_path / "d.md"))
    assert {r.code: r.n for r in codes.collect()} == {"ok": 1, "BLANK": 1, "bad": 1} and files.audit_gate(codes).first().gate == "PENDING"
    packed = files.archive({"x/b": b"2", "a": b"1"})
    assert packed == files.archive({"a": b"1", "x/b": b"2"})
    listed = {k: hashlib.sha256(v).hexdigest() for k, v in {"a": b"1", "x/b": b"2"}.items()}
    assert files.unpacked(packed, listed) == {"a": b"1", "x/b": b"2"}
    for wrong in ({**listed, "a": "0"}, {**listed, "z": "0"}, {"a": listed["a"]}):
        with pytest.raises(ValueError):
            files.unpacked(packed, wrong)
    with pytest.raises(ValueError):
        files.archive({"../escape": b""})
    found = files.manifest(spark, str(tmp_path))
    assert files.mismatches(found, found).count() == 0
    files.write_jsonl(codes, str(tmp_path / "out"))
    files.append_jsonl(codes, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 6
    (tmp_path / "s.txt").write_text("key AKIA" + "A" * 16)
    assert files.secrets(spark, str(tmp_path / "s.txt")).count() == 1
    assert files.to_markdown(spark.createDataFrame([(1.5, None)], "a double, b string")).endswith("| 1.500 | NA |")


def test_judges_retry(spark):
    rows = spark.createDataFrame([(str(k), f"statement {k}") for k in range(300)] + [("n", None)], "id string, statement string")
    got = judges.judged(rows, [judges.HashJudge("j")]).collect()
    assert len(got) == 301 and {r.verdict for r in got} <= {"true", "false"} and max(r.attempt for r in got) == 2


def test_streams(spark, tmp_path):
    schema = "seq bigint, judge string, item_id string, mode string, attempt int, verdict string, logged_at timestamp"
    rows = spark.sql("select 1L seq, 'A' judge, 'x' item_id, cast(null as string) mode, 1 attempt, 'true' verdict, timestamp'2025-01-01 00:00:00' logged_at union all select 2L, 'a ', 'X', 'reference_free', null, 'true', timestamp'2025-01-01 01:00:00' union all select 3L, 'a', 'y', null, 1, 'parse_fail', timestamp'2025-01-09 00:00:00'")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = stream.deduplicated(source).writeStream.format("memory").queryName("deduped").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("deduped").count() == 2
    assert sorted(r.n for r in stream.windowed(rows, "logged_at").collect()) == [1, 2]
    append = stream.append_new(str(tmp_path / "store"), ["seq"])
    for k in range(2):
        append(rows, k)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    append(rows.limit(0), 2)
    more = rows.limit(1).unionByName(rows.limit(1)).withColumn("seq", F.lit(None).cast("bigint"))
    for k in (3, 4):
        append(more, k)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4
    first = stream.append_new(str(tmp_path / "empty"), ["seq"])
    first(rows.limit(0), 0)
    first(rows, 1)
    assert spark.read.parquet(str(tmp_path / "empty")).count() == 3


def test_stream_keeps_late_first_copies_and_rows_without_item(spark, tmp_path):
    schema = "seq bigint, judge string, item_id string, mode string, verdict string, attempt int, logged_at string"
    batches = [[(1, "j", "a", None, "true", 1, "2026-03-01 10:00:00"), (2, "j", None, None, "true", 1, "2026-03-01 10:00:00"), (3, "j", None, None, "true", 1, "2026-03-01 10:00:00")], [(4, "J", "b", None, "true", 1, "2025-01-01 10:00:00"), (5, " j", "A", None, "true", 1, "2025-01-01 10:00:00")], [(6, "j", "c", None, "true", 1, "2025-01-02 10:00:00")]]
    (tmp_path / "log").mkdir()
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "log"))
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        q = stream.deduplicated(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
        q.stop()
    assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 4, 6]
