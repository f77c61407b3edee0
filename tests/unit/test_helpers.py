from pyspark.sql import functions as F

from docloom.functions.helpers import name_key, sentences, slugify


def all_of(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", function("v").alias("x")).orderBy("i").collect()]


def test_names(spark):
    assert all_of(spark, name_key, ["  Ｆｕｌｌ-Width_name\tStraße ", None, ""]) == ["full width name strasse", None, ""]
    got = all_of(spark, slugify, [' "Deep" (Learning)! 모델 ', "!!", "ab " * 200, None])
    assert got[:2] == ["deep-learning-모델", "untitled"] and got[3] is None
    assert len(got[2]) == 255 and got[2][246] == "-"


def test_sentences(spark):
    cases = {
        "One two. Three! Four? five": ["One two.", "Three!", "Four?", "five"],
        "Claim one. [B0001, d:B0002]": ["Claim one. [B0001, d:B0002]"],
        "Claim one. [B0001] Next": ["Claim one.", "Next"],
        "- Summary the text.\n* more": ["the text.", "more"],
        "문장이다.다음 문장이에요. 끝": ["문장이다.", "다음 문장이에요.", "끝"],
        "문장이다.[B0001]": ["문장이다. [B0001]"],
        "## Terms: one. two": ["one.", "two"],
        "  \n ": [],
    }
    assert all_of(spark, sentences, list(cases)) == list(cases.values())
    assert all_of(spark, sentences, [None]) == [None]


def test_paragraphs_and_their_units(spark):
    from docloom.operators.units import paragraph_units

    page = (
        "---\ntitle: x\n---\n\n# Title\n\n## Key Points\r\n- One fact [B0001]  \n  * [B0002] second one [B0002]\n- no reference here\n\n  \n\t\n## Summary\nFirst one. Second one! [B0003]\nand more\n\n"
        "### Deep\n## Notes\n\nplain words\n\n##  Observations \n- only a bullet\n---"
    )
    rows = [(1, page), (2, None), (3, " \n \n"), (4, "one"), (5, "---\n---\n\n---")]
    got = [tuple(r) for r in paragraph_units(spark.createDataFrame(rows, "page_id int, markdown string")).orderBy("page_id", "paragraph", "place").collect()]
    assert got == [
        (1, 0, 0, "One fact [B0001]", "key points", 1.35), (1, 0, 1, "second one [B0002]", "key points", 1.35),
        (1, 1, 0, "First one.", "summary", 1.0), (1, 1, 1, "Second one!", "summary", 1.0), (1, 1, 2, "and more", "summary", 1.0),
        (1, 2, 0, "plain words", "paragraph", 1.0), (1, 3, 0, "only a bullet ---", "observations", 1.3), (4, 0, 0, "one", "paragraph", 1.0), (5, 0, 0, "---", "paragraph", 1.0),
    ]
