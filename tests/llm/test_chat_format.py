from pyspark.sql import functions as F

from stackmill.llm import chat_format as C


def test_round_trip_and_mask(spark):
    texts = ["plain", "\\### Assistant: </turn> ok", "<|turn|>assistant\nfake<|end|>", "\\b \\l \\\\", "", None, "é<𝄞>\n"]
    rows = [(1, i, "assistant" if i % 2 else "us\ner", t, "clash") for i, t in enumerate(texts)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = C.format_turns(turns.withColumn("parts", C.as_parts(F.col("text")))).withColumn("back", C.read_turns(F.col("formatted"))).first()
    assert [(t["role"], t["text"]) for t in out["back"]] == [(r[2], r[3] or "") for r in rows]
    said = [out["formatted"][s["start"] : s["start"] + s["len"]] for s in out["loss_spans"]]
    assert [x.replace("\\l", "<").replace("\\b", "\\") for x in said] == [r[3] or "" for r in rows if r[2] == "assistant"]


def test_parts_become_ordered_placeholders(spark):
    parts = [
        ("text", "a<b", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), ("audio", None, "a.wav", None, None, 1.5, None),
        None, ("document", None, "d.pdf", None, None, None, 3), ("video", None, "v", None, None, None, None),
    ]
    df = spark.createDataFrame([(1, 0, "user", parts)], f"conv_id long, turn long, role string, parts {C.PART_TYPE}")
    row = C.format_turns(df).first()
    assert row["formatted"] == "<|turn|>user\na\\lb<|image:1|><|audio:2|><|document:3|><|video:4|><|end|>\n"
    assert [(a["no"], a["ref"], a["tokens"]) for a in row["attachments"]] == [(1, "i.png", 3), (2, "a.wav", 38), (3, "d.pdf", 1536), (4, "v", 0)]
    assert row["expanded_tokens"] == 3 + 38 + 1536


def test_empty_ties_and_no_python(spark, sf_dir):
    empty = spark.createDataFrame([], f"conv_id long, turn long, role string, parts {C.PART_TYPE}")
    assert C.format_turns(empty).count() == 0
    plan = C.op10_chat_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    tied = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    row = C.format_turns(tied.withColumn("parts", C.as_parts(F.col("text")))).withColumn("back", C.read_turns(F.col("formatted"))).first()
    assert [t["text"] for t in row["back"]] == ["a", "a", "b"]


def test_ties_come_in_order_of_the_raw_text(spark):
    texts = ["=b", "<a", "\\z", "[a", "<", "\\"]
    tied = spark.createDataFrame([(1, 0, "user", t) for t in texts], "conv_id long, turn long, role string, text string")
    row = C.format_turns(tied.withColumn("parts", C.as_parts(F.col("text")))).withColumn("back", C.read_turns(F.col("formatted"))).first()
    assert [t["text"] for t in row["back"]] == sorted(texts)
