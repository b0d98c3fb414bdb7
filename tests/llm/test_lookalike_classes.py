"""The class's canonical member decides the consistent form."""

from glossmill.llm.lookalike import consistent_values
from glossmill.llm.queries import p4_consistent, p4_found


def forms(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "k int, f string")
    return {values[r.k]: (r.consistent, r.changed) for r in consistent_values(df, ["f"], ["k"]).collect()}


def test_stacked_marks_share_one_form(spark):
    got = forms(spark, ["e\u0302\u0304", "\u00ea\u0304", "a\u0302\u0301\u0304", "\u1ea5\u0304"])
    assert got["e\u0302\u0304"] == ("\u00ea\u0304", True) and got["\u00ea\u0304"] == ("\u00ea\u0304", False)
    assert got["a\u0302\u0301\u0304"] == ("\u1ea5\u0304", True) and got["\u1ea5\u0304"] == ("\u1ea5\u0304", False)
    assert forms(spark, ["e\u0302\u0304"]) == {"e\u0302\u0304": ("\u00ea\u0304", True)}


def test_the_member_decides_where_compose_has_no_letter(spark):
    got = forms(spark, ["\u304b\u3099", "\u304c", "\u0627\u0653", "\u0622"])
    assert got == {"\u304b\u3099": ("\u304c", True), "\u0627\u0653": ("\u0622", True)}


def test_collation_alone_decides_nothing(spark):
    # other digits, a control character and a tatweel, each equal to the plain value under the collation
    got = forms(spark, ["\u00e9 5", "e\u0301 \u0665", "\u00e9", "e\u0301\u0001", "e\u0301\u0640"])
    assert {k: v[0] for k, v in got.items()} == {"e\u0301 \u0665": "\u00e9 \u0665", "e\u0301\u0001": "\u00e9\u0001", "e\u0301\u0640": "\u00e9\u0640"}


def test_every_field_comes_out(spark, tmp_path):
    rows = [(1, "rec\u03bfrd", "record", None), (2, "\u212bngstr\u00f6m", "", "\uf914"), (3, "plain", "\u6a02", "\u00dcbung")]
    spark.createDataFrame(rows, "row_id bigint, L1_context string, L1_source_word string, en_target_word string").write.parquet(f"{tmp_path}/items.parquet")
    got = {(r.row_id, r.field_name): (r.consistent, r.changed) for r in p4_consistent(spark, str(tmp_path)).collect()}
    assert got == {
        (1, "L1_context"): ("record", True), (1, "L1_source_word"): ("record", False),
        (2, "L1_context"): ("\u00c5ngstr\u00f6m", True), (2, "L1_source_word"): ("", False), (2, "en_target_word"): ("\u6a02", True),
        (3, "L1_context"): ("plain", False), (3, "L1_source_word"): ("\u6a02", False), (3, "en_target_word"): ("\u00dcbung", False),
    }
    assert {tuple(r) for r in p4_found(spark, str(tmp_path)).collect()} == {k for k, v in got.items() if v[1]}
