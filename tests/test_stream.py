"""U4: each distinct tuple is asked once over the whole stream."""

import uuid

from pyspark.sql import functions as F

from tokensieve.operators.semantic import EchoPredictor
from tokensieve.streaming.semantic_stream import answer_stream, run_available_now, stream_sem_map

SCHEMA = "id long, word string, n long"


def unique_answers():
    """A predictor with a new answer at each call, so that a tuple asked twice shows two."""
    return lambda records, prompt, choices=None: [f"{r['word']}|{r['n']}|{uuid.uuid4().hex}" for r in records]


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def source(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_each_tuple_is_asked_once(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i, "hot" if i % 3 else f"w{i % 7}", i % 2) for i in range(300)] + [(1000, None, 1), (1001, "x", None), (1001, "x", None), (1002, "", 0)]
    for part in range(3):
        put(spark, src, rows[part::3])
    got = answer_stream(spark, source(spark, src), "{word} {n}", unique_answers(), ["id"], out)
    assert got.count() == len(rows)
    put(spark, src, [(2000, "hot", 0), (2001, "new", 5), (2001, "new", 5)])
    got = answer_stream(spark, source(spark, src), "{word} {n}", unique_answers(), ["id"], out).collect()
    assert len(got) == len(rows) + 3
    answers = {}
    for r in got:
        if r.word is None or r.n is None:
            assert r.answer is None and r.status == f"missing field: {'word' if r.word is None else 'n'}"
        else:
            assert r.status == "ok" and r.answer.startswith(f"{r.word}|{r.n}|")
            answers.setdefault((r.word, r.n), set()).add(r.answer)
    assert all(len(a) == 1 for a in answers.values()) and ("new", 5) in answers


def test_empty_stream_and_form_without_state(spark, tmp_path):
    src = str(tmp_path / "none")
    spark.createDataFrame([], SCHEMA).write.parquet(src)
    assert answer_stream(spark, source(spark, src), "{word}", EchoPredictor(), ["id"], str(tmp_path / "o")).count() == 0
    src = str(tmp_path / "some")
    put(spark, src, [(1, "a", 1), (1, "a", 1), (2, None, 3)])
    plain = run_available_now(spark, stream_sem_map(source(spark, src), "{word}", EchoPredictor(), ["id"]), "plain")
    kept = answer_stream(spark, source(spark, src), "{word}", EchoPredictor(), ["id"], str(tmp_path / "p"))
    rows = lambda d: sorted((r.id, r.status, r.answer or "") for r in d.where(F.col("id") > 0).collect())
    assert rows(plain) == rows(kept) == [(1, "ok", "a"), (1, "ok", "a"), (2, "missing field: word", "")]
