"""Problem 1: the end that the corpus decides on is judged whatever other rule fired."""

from foliograph.llm import pairs


def test_cut_list_item_beside_another_defect(spark):
    whole = [(i, "Which part fits the pump?", f"Work in this order:\n1. Use part {i} with a new gasket\n2. Take {i} kPa from the long table", None) for i in range(5)]
    rows = spark.createDataFrame(whole + [(9, "Какая деталь подходит к этому насосу?", "Work in this order:\n1. Stop it\n2. Take 7 kPa from the long", None)], "result_id long, question string, answer string, may_refuse boolean")
    got = {g.result_id: (g.defects, g.defect) for g in pairs.defects(rows).collect()}
    assert got == {i: ([], None) for i in range(5)} | {9: (["wrong_language", "truncated"], "wrong_language")}
