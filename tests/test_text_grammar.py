from weftmat.operators import grammar


def test_texts_that_repeat_a_key_stay_apart(spark):
    rows = [(1, "abababab"), (1, "xyxyxyxy z\u00e9\U0001f600"), (2, ""), (None, "aaaaaaa"), (3, "q")]
    grammars = grammar.text_grammars(spark.createDataFrame(rows, "id bigint, t string"), "id", "t")
    assert grammars.count() == len(rows)  # a row a text, not a symbol
    got = [tuple(r) for r in grammar.expand_text_grammars(grammars, "id", "t").collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)
