from veristrata.llm import sentences as S


def test_copies_of_a_text_take_no_places_of_others(spark):
    texts = [(f"Text number {i} stands alone.",) for i in range(60)]
    want = S.training_texts(spark.createDataFrame(texts, "text string"), bound=20)
    assert len(want) == len(set(want)) == 20
    copied = spark.createDataFrame(texts + [(want[0],)] * 40, "text string")
    assert S.training_texts(copied, bound=20) == want
