import json

from pyspark.sql import functions as F

from catalog_engine.llm import chat


def turns(spark, *records):
    table = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id bigint, record string")
    rows = chat.canonical_turns(table).orderBy("id").collect()
    return [r.turns and [(t.role, t.text) for t in r.turns] for r in rows], [r.layout for r in rows]


def test_layouts_by_fingerprint(spark):
    got, names = turns(
        spark,
        json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}),
        json.dumps({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}),
        json.dumps({"instruction": "i", "input": "x", "output": "o"}),
        json.dumps({"response": "[{\"a\": 1}]", "prompt": "{}"}),
        json.dumps({"prompt": "p", "other": 1}),
        "not json",
        None,
        json.dumps({"question": 5, "answer": True}),
    )
    assert names == ["messages", "sharegpt", "instruction-input", "prompt-response", None, None, None, "question-answer"]
    assert got[0] == [("user", "a"), ("assistant", "")]
    assert got[1] == [("user", "a"), ("assistant", "b")]
    assert got[2] == [("user", "i\n\nx"), ("assistant", "o")]
    assert got[3] == [("user", "{}"), ("assistant", '[{"a": 1}]')]
    assert got[4] is got[5] is got[6] is None
    assert got[7] == [("user", "5"), ("assistant", "true")]


def test_round_trip_and_mask(spark):
    nasty = ["</turn>\n<turn>", "\\", "\\\\l<", "\\b\\n", "", "a\nb", "é\U0001f600", "### <", "\\l\\b", "x" * 50_000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "assis<tant\n\\", "a"), (2, 1, None, None), (None, 0, "user", "no id"), (3, 5, "b", "x"), (3, 5, "a", "y")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = chat.render(chat.canonical_turns(chat.by_conversation(table)))
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert [(t.role, t.text) for t in back[1].read_turns] == [(r, t) for _, _, r, t in rows[:10]]
    assert back[1].loss_text == "".join(nasty[1::2])
    assert [(t.role, t.text) for t in back[2].read_turns] == [("assis<tant\n\\", "a"), ("", "")]
    assert [(t.role, t.text) for t in back[3].read_turns] == [("a", "y"), ("b", "x")]
    assert back[None].loss_text == ""
    for row in back.values():
        runs = [(m.before + m.under + m.after) for m in row.loss_mask]
        assert sum(runs) == len(row.formatted)
    plan = made._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.by_conversation(table.where(F.lit(False))).count() == 0


def test_long_texts_and_many_turns_have_a_shape(spark):
    one = spark.range(1)
    long = F.to_json(F.struct(F.lit("p").alias("prompt"), F.repeat(F.lit("x"), 21_000_000).alias("response")))
    made = one.select(long.alias("record"))
    row = chat.canonical_turns(made).select("layout", F.length(F.col("turns")[1]["text"]).alias("n")).first()
    assert (row.layout, row.n) == ("prompt-response", 21_000_000)
    turn = '{"role":"user","text":"' + "y" * 999_970 + '"},'
    many = F.concat(F.lit('{"turns":['), F.repeat(F.lit(turn), 144), F.lit('{"role":"a","text":"b"}]}'))
    row = chat.canonical_turns(one.select(many.alias("record"))).select("layout", F.size("turns").alias("n")).first()
    assert (row.layout, row.n) == ("turns", 145)


def test_outline_keeps_shapes(spark):
    records = [
        r'{"a":",","b\"c":["x",{"d":"\\"}],"e\\":"\"", "f" : {"g":"A\n"}}',
        r'{"prompt":"\\\\\"","response":"{\"a\":1}"}',
        '{"turns":[{"role":"a","text":"x"}, {"role":"b","text":null},{"role":"b","text":1},{"n":[{},{}]}]}',
        '{"a":"\\q"}', '{"a":"x\ny"}', '{"a":"x\x01y"}', '{"a" "b"}', '"a":1', '{"a":"b"', '["a":"b"]', "", '"t"',
    ]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "id int, record string")
    whole = F.regexp_replace(
        F.schema_of_variant(F.try_parse_json("record")), r": (?!OBJECT|ARRAY)[A-Z_]+(\([0-9,]*\))?", ""
    )
    for r in frame.select("record", chat.shape(F.col("record")).alias("got"), whole.alias("want")).collect():
        assert r.got == r.want, r.record
