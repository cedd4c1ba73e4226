"""Tokens that pass through as they are made, and what a failure leaves."""

import os
import time

from quern.operators import answering
from quern.operators.store import written
from quern.streaming import tokens
from quern.streaming.serving import serve


def questions(spark):
    rows = [(1, "good", "c", "en"), (2, "breaks", "c", "en"), (3, "none", None, "en"), (4, "empty", "c", None)]
    return spark.createDataFrame(rows, "question_id long, question string, context string, lang string")


def test_tokens_come_before_the_answer_is_whole(spark, tmp_path):
    folder = str(tmp_path / "events")

    def load():
        def model(question, context, lang):
            if question == "empty":
                return
            for i in range(5):
                # what was said so far is there for a reader before the next token is made
                with open(f"{folder}/7-{str(1 if question == 'good' else 2).encode().hex()}.sse", encoding="utf-8") as f:
                    assert f.read().count("token\":") == i
                if question == "breaks" and i == 3:
                    raise ValueError("the model is down")
                yield f"t{i} "

        return model

    answers = written(tokens.answer_by_tokens(questions(spark), 7, load, lambda: tokens.FileSink(folder)))
    got = {r["question_id"]: (r["answer"], r["failed"]) for r in answers.collect()}
    assert got == {1: ("t0 t1 t2 t3 t4 ", None), 2: (None, "generation"), 3: (None, None), 4: ("", None)}
    said = {}
    for name in os.listdir(folder):
        events = open(f"{folder}/{name}", encoding="utf-8").read().split("\n\n")[:-1]
        said[int(bytes.fromhex(name[2:-4]).decode())] = events
    assert len(said[1]) == 6 and said[1][-1] == 'data: {"type":"done"}' and said[2][-1] == 'data: {"type":"error","message":"the model is down"}' and len(said[2]) == 4 and said[4] == ['data: {"type":"done"}']
    # the events are those that a client puts together
    frame = spark.createDataFrame([(q, i, e + "\n\n") for q, es in said.items() for i, e in enumerate(es)], "question_id long, seq int, event string")
    back = {r["question_id"]: (r["answer"], r["complete"], r["error"]) for r in answering.reassemble(frame, "question_id").collect()}
    assert back == {1: ("t0 t1 t2 t3 t4 ", True, None), 2: ("t0 t1 t2 ", False, "the model is down"), 4: ("", True, None)}


def test_a_repeated_attempt_says_it_once(spark, tmp_path):
    folder = str(tmp_path / "events")
    for _ in range(2):
        tokens.answer_by_tokens(questions(spark).where("question_id = 1"), 0, lambda: lambda *a: iter(["a", "b"]), lambda: tokens.FileSink(folder)).collect()
    (name,) = os.listdir(folder)
    assert open(f"{folder}/{name}", encoding="utf-8").read().count("token\":") == 2


def test_a_stream_remembers_what_succeeded(spark, tmp_path):
    spark.createDataFrame([(1, "tell me of the long first question"), (2, "tell me of the broken second question")], "question_id long, question string").write.parquet(str(tmp_path / "in"))

    def load():
        def model(question, context, lang):
            yield "one "
            if "broken" in question:
                raise ValueError
            yield "two"

        return model

    from pyspark.sql import functions as F

    kept = str(tmp_path / "kept")

    def sink(answers, number):
        answers.where("failed is null").write.mode("overwrite").parquet(f"{kept}/batch={number}")

    calls = []

    def respond(routed):
        calls.append(time.monotonic())
        return written(tokens.answer_by_tokens(routed.withColumn("context", F.lit("c")), len(calls) - 1, load, lambda: tokens.FileSink(str(tmp_path / "events"))))

    query = serve(spark.readStream.schema("question_id long, question string").parquet(str(tmp_path / "in")), respond, sink, str(tmp_path / "c"))
    assert query.awaitTermination(120)
    assert [(r["question_id"], r["answer"]) for r in spark.read.parquet(kept).collect()] == [(1, "one two")]
    assert len(os.listdir(tmp_path / "events")) == 2
