from textmill.llm import lines

A = "The first line is long enough to be hashed by itself, surely."
B = "Another sentence that is long enough to be a unit of its own here."
C = "short one."


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return {(r.doc_id, r.version): [tuple(s) for s in r.spans] for r in lines.repeated_units(df, **options).collect()}


def spans_of(found, doc_id):
    return sorted(s for (i, _), s in found.items() if i == doc_id)


def test_earliest_occurrence_stays_and_offsets_are_original(spark):
    rows = [
        (4, f"é{C}\n{A}\n{C}"),  # line known from 1
        (1, f"{A}\n{C}\n{A}"),  # second time in one document
        (2, f"x {C} {B} {A.upper()}"),  # a sentence that is a line elsewhere
        (3, f"{C}\n  {B}  \n{C}"),
        (9, None), (8, ""), (7, C), (6, C),
    ]
    found = run(spark, rows)
    assert len(found) == len(rows)
    assert spans_of(found, 1) == [[(len(A) + len(C) + 2, 2 * len(A) + len(C) + 2)]]
    begin = len(f"x {C} {B} ")
    assert spans_of(found, 2) == [[(begin, begin + len(A))]]
    assert spans_of(found, 4) == [[(len(C) + 2, len(C) + 2 + len(A))]]
    assert spans_of(found, 3) == [[(len(C) + 1, len(C) + 5 + len(B))]]
    assert all(spans_of(found, i) == [[]] for i in (6, 7, 8, 9))


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(1, A), (1, A), (1, B), (None, A), (None, A), (2, A), (2, f"{B}\n{A}")]
    found = run(spark, rows)
    assert spans_of(found, 1) == [[], []] and spans_of(found, None) == [[]]
    assert spans_of(found, 2) == [[(0, len(A))], [(0, len(B)), (len(B) + 1, len(A) + len(B) + 1)]]
    assert run(spark, rows[:0] or [(None, None)]) != {}
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.repeated_units(df).collect() == []


def test_texts_without_repeats_keep_other_columns(spark):
    df = spark.createDataFrame([(2, f"{C}\n{A}", 7, "s"), (1, A, 8, "s"), (3, None, 9, "s"), (None, A, 1, "s")], "doc_id long, text string, version int, spans string")
    rows = lines.without_repeats(df)
    assert rows.columns == ["doc_id", "text", "version", "spans", "removed"]
    assert {(r.doc_id, r.text, r.version, r.spans, len(r.removed)) for r in rows.collect()} == {
        (2, f"{C}\n", 7, "s", 1), (1, A, 8, "s", 0), (3, None, 9, "s", 0), (None, A, 1, "s", 0),
    }


def test_long_text_of_many_units(spark):
    text = "\n".join(f"line number {i} of a long text that goes on and on for a while" for i in range(3000))
    found = run(spark, [(1, text), (2, text)])
    assert spans_of(found, 1) == [[]] and sum(e - b for b, e in spans_of(found, 2)[0]) == len(text) - 2999


def test_short_lines_are_units_with_a_bound_of_their_own(spark):
    rows = [(1, f"{C}\nb\n\n \n{A}"), (2, f"  {C.upper()} \n\n \nx"), (3, f"b\n{C} {A}\n{C}")]
    found = run(spark, rows, least_line=1)
    assert spans_of(found, 1) == [[]] and spans_of(found, 2) == [[(0, len(C) + 3)]]
    # blank lines stay, and so do short sentences inside a line
    assert spans_of(found, 3) == [[(0, 1), (len(C) + 3, len(C) + 3 + len(A)), (len(C) + len(A) + 4, 2 * len(C) + len(A) + 4)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.without_repeats(df, least_line=1).collect()}[2] == "\n\n \nx"
