"""Literal cases of the extraction, normalisation and number rules."""

import pytest
from pyspark.sql import functions as F

from hopweave.functions import numeric as N
from hopweave.functions import predicates as P
from hopweave.functions import text as T


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "letter", "answer"),
    [
        ("x <answer>A</answer> y <answer> b </answer>", "B", "b"),
        ("<answer>(c) or [D]</answer>", "D", "(c) or [D]"),
        ("<answer>none</answer> (A)", None, "none"),
        (r"\boxed{xyz} answer is (C)", "C", r"\boxed{xyz} answer is (C)"),
        (r"\boxed{band} (C)", None, r"\boxed{band} (C)"),
        ("<think>(A)</think> Answer: (b)", "B", "Answer: (b)"),
        ("**(B)** then (C)", "B", "**(B)** then (C)"),
        ("A cat sat", "A", "A cat sat"),
        ("", None, ""),
        (None, None, ""),
        ("first<|im_start|>assistant second (C)<|im_end|> (D)", "D", "second (C)"),
    ],
)
def test_transcripts(spark, text, letter, answer):
    column = F.lit(text).cast("string")
    assert value(spark, T.mcq_letter(column)) == letter
    assert value(spark, T.free_answer(column)) == answer


@pytest.mark.parametrize(("text", "normal"), [("The  U.S.A.!", "usa"), ("a", "a"), ("An apple, a day", "apple day"), ("", "")])
def test_normaliser(spark, text, normal):
    assert value(spark, T.normalize_answer(F.lit(text))) == normal


@pytest.mark.parametrize(
    ("values", "rule", "result"),
    [([8.0, 2.0, 0.0, 2.0], "DIVIDE", 2.0), ([8.0, 0.0], "DIVIDE", 0.0), ([5.0, 3.0, 1.0], "SUBTRACT", 1.0), ([7.0], "MAX", 7.0), ([], "ADD", 0.0), ([1.0, 2.0], "CONDITIONAL", 0.0), ([1.0, 2.0, 4.0], "AVG", 7 / 3)],
)
def test_fusion(spark, values, rule, result):
    array = F.array(*map(F.lit, values)).cast("array<double>")
    assert value(spark, N.fuse(array, F.lit(rule))) == pytest.approx(result)


def test_fusion_text(spark):
    array = F.array(F.lit(7.0), F.lit(2.0))
    assert value(spark, N.fusion_text(array, F.lit("DIVIDE"))) == "7 ÷ 2 = 3.5"
    assert value(spark, N.fusion_text(array, F.lit("MAX"))) == "max(7, 2) = 7"


def test_numbers(spark):
    assert tuple(value(spark, N.smart_resize(F.lit(100), F.lit(100)))) == (256, 256)
    assert value(spark, N.diversity(F.array(*map(F.lit, "xyz")), F.array(F.lit("a"), F.lit("a")))) == pytest.approx(0.38)
    assert value(spark, N.answer_value(F.lit("est. 1885, moved 1974"), F.lit("founding_year"), F.lit(0.0))) == 1885
    assert value(spark, N.round_to(F.lit(80), 32)) == 64  # a half goes to the even multiple
    assert [value(spark, P.valid_edge(F.lit(c), F.lit(r))) for c, r in ((0.9, "spatial"), (0.89, "spatial"), (0.95, "none"))] == [True, False, False]


def test_names(spark):
    assert [value(spark, T.clean_entity(F.lit(x))) for x in ("Nike Logo", "Logo", "LOGO x")] == ["Nike", "Logo", "LOGO x"]
    assert [value(spark, P.noisy_link(F.lit(x))) for x in ("List of towers", "1999", "5th century", "Paris", "")] == [True, True, True, False, True]
    assert [value(spark, P.valid_entity(F.lit(x))) for x in ("1999", "a theory", "Bell theory test", "x", "éé", "Paris")] == [False, False, True, False, False, True]
    assert value(spark, T.refer_visually(F.lit("Where is paris?"), F.lit("Paris"), F.lit("the city $1"))) == "Where is the city $1?"
    assert value(spark, T.json_field(F.lit('{"method": "digit_sum", "val'), "method")) == "digit_sum"
