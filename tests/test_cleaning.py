import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import cleaning as C


def run(spark, f, text):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "f, text, want",
    [
        (C.drop_page_numbers, "a\n\n- 7 -\n\nb", "a\n\nb"),
        (C.join_wrapped_lines, "word\n\nfoo", "word\n foo"),
        (C.join_wrapped_lines, "A.\nbar", "A. bar"),
        (C.join_wrapped_lines, "bar. \nbaz", "bar. \nbaz"),
        (C.flatten_tables, "| a | b |\n|---|---|\n| 1 |  |", "a | b\n1"),
        (C.flatten_tables, "+----+----+\n= = = = =\n-----\n----", "----"),
        (C.keep_code_blocks, "```py\nx=1\n```", "\nCODE_BLOCK py\nx=1\nEND_CODE_BLOCK\n"),
        (C.keep_code_blocks, "~~~\n\ny\n~~~", "\nTILDE_BLOCK\ny\nEND_TILDE_BLOCK\n"),
        (C.clean, "```py\nx=1\n```", "CODE_BLOCK py x=1\nEND_CODE_BLOCK"),
        (C.clean, "Ｆｕｌｌ！ <!-- gone\n --> `code`  x", "Full! code x"),
        (C.clean, None, ""),
        (C.clean, " \t\n ", ""),
        (C.drop_control_chars, "a\x00b\tc\x7f", "ab\tc"),
        (C.trim_lines, "a  \r\nb\x85c \n", "a\nb\nc"),
    ],
)
def test_steps(spark, f, text, want):
    assert run(spark, f, text) == want


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB. |-#\n\t`1é　", max_size=40), min_size=1, max_size=20))
def test_clean_leaves_no_noise(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(C.clean(F.col("t")).alias("c")).collect()
    for row in got:
        assert "\n\n\n" not in row.c and "\x00" not in row.c and row.c == row.c.strip()


def test_tables_by_line_equal_the_line_operators(spark):
    """flatten_tables works line by line in one pass; the operators for single lines are expressions."""
    import random

    r = random.Random(8)
    lines = ["".join(r.choice(" |-=*_#~+/\\<>:^[](){}ab1é\t") for _ in range(r.randint(0, 14))) for _ in range(3000)] + ["|---|:--:|", "a|b", "||", "= = = = =", "----", "word | x |", "   ", "| a | | b |"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    bare = C.rstrip(F.col("t"))
    row = C.table_row(bare)
    want = F.when(C.strip(bare) == "", "").when(C.is_table_divider(bare), None).when(C.is_ascii_art(row) | C.is_separator(row), None).otherwise(row)
    # A line of its own that goes and one that becomes empty look alike in a text; so each is held between two words.
    got = df.select(want.alias("want"), C.flatten_tables(F.concat(F.lit("aaaa\n"), "t", F.lit("\nbbbb"))).alias("got")).collect()
    for x, g in zip(lines, got):
        assert g.got == "\n".join(["aaaa", *([] if g.want is None else [g.want]), "bbbb"]), x
