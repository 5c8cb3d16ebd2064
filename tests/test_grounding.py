from cuentaclara.operators import grounding

ROWS = "conv_id int, pos int, expense_id string, vendor string, amount string, currency string, date string, category string, link string, _source string, error string"


def tool_rows(spark, *rows):
    return spark.createDataFrame([(1, i, e, "v", a, "COP", None, None, link, src, err) for i, (e, a, link, src, err) in enumerate(rows)], ROWS)


def test_normalize(spark):
    rows = tool_rows(spark, ("e1", "12.5", None, "sql", None), (None, "1", None, "sql", None), ("e2", "n/a", "/x", None, None), ("e3", "1", None, "sql", "boom"))
    got = [(r.expense_id, r.amount, r.link, r.source) for r in grounding.normalize(rows).orderBy("pos").collect()]
    assert got == [("e1", 12.5, "/expenses/e1", "sql"), ("e2", None, "/x", "unknown")]


def test_first_source_wins_and_cap(spark):
    rows = tool_rows(spark, ("e1", "1", None, "sql", None), ("e1", "1", None, "semantic", None), ("e2", "1", None, "semantic", None))
    got = [(r.expense_id, r.source) for r in grounding.citations(rows).orderBy("citation_no").collect()]
    assert got == [("e1", "sql"), ("e2", "semantic")]
    many = tool_rows(spark, *[(f"e{i:02}", "1", None, "sql", None) for i in range(25)])
    assert [r.expense_id for r in grounding.citations(many).orderBy("citation_no").collect()] == [f"e{i:02}" for i in range(10)]


def answers(spark, text):
    return spark.createDataFrame([(1, 1, text)], "conv_id int, turn int, text string")


def test_cited_in_text_order(spark):
    rows = tool_rows(spark, ("A", "1", None, "sql", None), ("B", "1", None, "sql", None), ("C", "1", None, "sql", None))
    text = "see [b](/expenses/B), [a]( /expenses/A ), [b](/expenses/B) and [z](/expenses/Z)"
    assert [r.expense_id for r in grounding.cited_expenses(answers(spark, text), rows).orderBy("citation_no").collect()] == ["B", "A"]
    assert grounding.cited_expenses(answers(spark, "no links"), rows).count() == 0


def test_failed_calls_ground_nothing(spark):
    rows = tool_rows(spark, ("A", "1", None, "sql", "timeout"), ("B", "1", None, "sql", None))
    row = grounding.strip_ungrounded(answers(spark, "[a](/expenses/A) and [b](/expenses/B)"), rows).first()
    assert row.text == "and [b](/expenses/B)" and row.removed_ids == ["A"]


def test_tool_rows_of_all_shapes(spark):
    def message(role, *payloads):
        blocks = ",".join('{"toolResult":{"content":[{"json":%s}]}}' % p for p in payloads)
        return role, f'[{{"text":"hi"}},{blocks}]'

    said = [
        message("user", '[{"expense_id":"A","amount":5},{"expense_id":"B","_source":"semantic"}]', '{"rows":[{"expense_id":"C"}]}'),
        message("user", '{"error":"boom","rows":[{"expense_id":"D"}]}', '{"total":12}', '[]'),
        message("assistant", '[{"expense_id":"E"}]'), ("user", "plain text"), ("user", None),
    ]
    df = spark.createDataFrame([(1, i, r, c) for i, (r, c) in enumerate(said)], "conv_id int, turn int, role string, content string")
    got = grounding.citations(grounding.tool_rows_from_messages(df)).orderBy("citation_no").collect()
    assert [(r.expense_id, r.amount, r.source) for r in got] == [("A", 5.0, "unknown"), ("B", None, "semantic"), ("C", None, "unknown")]


def test_strip(spark):
    rows = tool_rows(spark, ("A", "1", None, "sql", None))
    text = "  [bad](/expenses/Z) start [a](/expenses/A)\n\n\n\nmid [bad2]( /expenses/Y-1 ) end [x](/other/A) \n"
    row = grounding.strip_ungrounded(answers(spark, text), rows).first()
    assert row.text == "start [a](/expenses/A)\n\nmid  end [x](/other/A)"
    assert row.removed_ids == ["Y-1", "Z"]
    assert grounding.strip_ungrounded(answers(spark, "plain"), rows).first().text == "plain"
