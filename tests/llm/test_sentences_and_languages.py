import numpy as np
import pytest

from veristrata.llm import languages as L
from veristrata.llm import sentences as S


@pytest.fixture(scope="module")
def model(spark):
    return S.fit_on(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.fixture(scope="module")
def labeller(spark, model):
    return L.labeller_on(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


CASES = [
    ["Dr. Kelmar measured 4.5 percent in run No. 5, i.e. far below the abstract.", "Who signed C-12, and when?"],
    ["The second archive for S-3244 is kept in the U.S.", "Do not merge the abstract with the first reading yet!"],
    ['Orskatt asked: "Is the licence file independent?" and got no reply about the abstract.', "The note says: \"The search log failed.\""],
    ["„Hier endet die Spur. Niemand hat S80.pdf geöffnet“, schrieb Hetrex an den Rand.", "Der 2. Lauf übertraf den 63. Lauf um 74,13 Punkte."],
    ["« La piste s'arrête ici. Personne n'a ouvert S314.pdf », note Morro en marge.", "Qui a signé C-1, et quand ?"],
    ["「手がかりはここで終わる。誰もtable96.csvを開いていない。」とBredraliは余白に書いた。", "なぜ要約は反例と食い違うのか？", "誰がC-20に署名したのか？"],
    ["“线索到此为止。没有人打开过S1.pdf。”Kelmar在页边写道。", "为什么引文图与旧版本不一致？"],
    ["메모에는 ‘요약문 확인 필요.’라고만 되어 있다.", "누가 C-5192 기록에 서명했는가?"],
]


@pytest.mark.parametrize("sentences", CASES)
def test_hard_sentences(model, sentences):
    glue = "" if sentences[0][0] in "「“" and "。" in sentences[0] else " "
    text = glue.join(sentences)
    assert [text[a:b] for a, b in model.units(text)] == sentences


def test_blank_lines_and_breaks(model):
    text = "Limits of the abstract\n \nThe last import of the abstract ended at\n11 p.m.\n\n"
    assert [text[a:b] for a, b in model.units(text)] == ["Limits of the abstract", "The last import of the abstract ended at\n11 p.m."]
    assert model.units(None) == [] and model.units(" \n\n ") == [] and model.units("x") == [(0, 1)]


def test_units_are_ordered_and_stripped(spark, model):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").collect():
        units, at = model.units(r.text), 0
        for a, b in units:
            assert at <= a < b and r.text[a:b] == r.text[a:b].strip() and not r.text[at:a].strip()
            at = b
        assert not r.text[at:].strip()


def test_very_long_text(model):
    text = "Who signed C-1, and when? " * 20_000
    assert len(model.units(text)) == 20_000


def test_model_without_training():
    assert S.fit([]).units("One. Two.") and S.fit(["", None, "  "]).units("") == []


def test_columns_of_sentences(spark, model):
    df = spark.createDataFrame([(1, None, "x"), (2, " ", "x"), (3, "Who signed C-1, and when?", "x"), (3, "Who signed C-1, and when?", "x"), (None, "lost", "x")], "doc_id long, text string, start_pos string")
    assert [tuple(r) for r in S.split_sentences(df, model=model).collect()] == [(3, 0, 25), (3, 0, 25)]
    assert S.split_sentences(df.limit(0), model=model).count() == 0
    assert S.split_sentences(df.limit(0)).count() == 0


def test_languages_of_sentences(labeller):
    texts = {
        "en": "It is unclear whether the abstract ever covered the sample size.",
        "de": "Es bleibt unklar, ob das Gutachten jemals den Anhang enthielt.",
        "fr": "Selon Velmiqua et al., il reste 12 fiches sur 124 à classer.",
        "es": "Todavía quedan 11 fichas de 129 por clasificar.",
        "pt": "Não se deve misturar um endereço bloqueado com a versão 1.0.18!",
        "ru": "Неясно, описывал ли кто-нибудь запечатанный отчёт.",
        "ko": "인용 그래프 자료를 다시 읽어 보죠.",
        "ja": "なぜ要約は反例と食い違うのか？",
        "zh": "为什么引文图与旧版本不一致？",
        "th": "เหตุใดบทคัดย่อจึงขัดแย้งกับขนาดตัวอย่าง",
    }
    got = labeller.label(list(texts.values()))
    assert [{x for _, _, x, _ in s} for s in got] == [{k} for k in texts]
    assert all(0 < c <= 1 for s in got for _, _, _, c in s)


def test_segments_names_and_data(labeller):
    ko = "인용 그래프 자료를 다시 읽어 보죠. 누가 C-5192 기록에 서명했는가?"
    en = "Who signed C-5192, and when? Do not merge the abstract with the first reading yet!"
    mixed, name, data, none = labeller.label([en + "\n\n" + ko, "Dr. Orquinborn 쪽에서 보낸 Q-4690 기록은 아직 읽지 못했다.", "4c4917d1b71e89849277c18aff494859dcd41863dca8", None])
    assert [x for _, _, x, _ in L.segments(mixed)] == ["en", "ko"] and set(L.contained(mixed)) == {"en", "ko"}
    assert set(L.contained(name)) == {"ko"} and L.contained(data) == {} and none == []
    one = [(0, 1, "en", 1.0), (1, 2, "de", 1.0), (2, 3, None, 0.0), (3, 4, "en", 1.0)]
    assert L.contained(one) == {} and L.contained([(0, 1, "en", 1.0), (1, 2, None, 0.0), (2, 3, "en", 0.5)]) == {"en": 0.75}


def test_labels(spark):
    rows = ["en", "EN-gb", " de_AT ", "zh-Hant", "und", "", None, "english", "e"]
    df = spark.createDataFrame([(x,) for x in rows], "l string")
    assert [r.x for r in df.select(L.named_language(df.l).alias("x")).collect()] == ["en", "en", "de", "zh", "", "", None, "", ""]


def test_items_and_tables(spark, labeller):
    docs = spark.createDataFrame([(1, None, "Limits of the abstract", "de"), (2, " ", None, "en"), (3, "Who signed C-1, and when?", "누가 서명했는가?", "en-US")], "doc_id long, text string, title string, lang string")
    texts = spark.createDataFrame([("t", "누가 C-5192 기록에 서명했는가?", None), ("t", "누가 C-5192 기록에 서명했는가?", None), ("e", None, None)], "text_id string, text string, lang string")
    items = L.items_of(docs, texts)
    assert {tuple(r) for r in L.unnamed_languages(items, labeller).collect()} == {("document", "1", "en"), ("text", "t", "ko")}
    rows = L.language_segments(items, labeller).collect()
    assert {(r.item_id, r.lang, r.segment_lang) for r in rows} == {("1", "en", "en"), ("3", "en", "en"), ("t", "ko", "ko")}
    assert L.language_segments(items.limit(0), labeller).count() == 0


def test_viterbi_equals_brute_force():
    import itertools

    rng = np.random.default_rng(3)
    lengths = np.array([5, 0, 3, 1])
    scores = rng.normal(0, 6, (9, 3)).astype(np.float32)
    first = rng.random(9) < 0.5
    got, at = L.viterbi(scores, first, lengths), 0
    for n in lengths:
        best = max(itertools.product(range(3), repeat=int(n)), key=lambda p: sum(scores[at + t, s] - (0 if t == 0 or p[t - 1] == s else L.SWITCH_BETWEEN if first[at + t] else L.SWITCH_INSIDE) for t, s in enumerate(p)))
        assert tuple(got[at : at + n]) == best
        at += n


UNKNOWN = {
    "it": "La copertura del documento non è stata verificata. Il revisore ha deciso di rileggere gli allegati prima della pubblicazione.",
    "uk": "Немає жодних доказів, що підтверджують цю тезу. Перевірка архіву ще триває і результати невідомі.",
    "sv": "Det finns inga bevis för att rapporten är fullständig. Granskaren läste igenom hela arkivet igen.",
    "el": "Δεν υπάρχει καμία απόδειξη. Ο έλεγχος συνεχίζεται.",
    "hi": "यह ठीक है। वह घर गया। क्या तुम आओगे?",
    "ar": "لا يوجد دليل على ذلك. هل هذا صحيح؟",
}


@pytest.mark.parametrize("code", UNKNOWN)
def test_other_languages_are_unknown(labeller, code):
    got = labeller.label([UNKNOWN[code]])[0]
    assert len(got) >= 2 and {x for _, _, x, _ in got} == {"und"}


def test_foreign_names_do_not_make_a_language_unknown(labeller):
    text = "The audit by Kelmar Vrondask Quilbaric Orrem was not finished. It is with Tamfett Isnorx for the next run."
    assert {x for _, _, x, _ in labeller.label([text])[0]} == {"en"}


def test_marks_of_other_scripts_and_texts_without_capitals(model):
    split = lambda t: [t[a:b] for a, b in model.units(t)]
    assert split("यह ठीक है। वह घर गया। क्या तुम आओगे?") == ["यह ठीक है।", "वह घर गया।", "क्या तुम आओगे?"]
    assert split("هل هذا صحيح؟ نعم هو كذلك.") == ["هل هذا صحيح؟", "نعم هو كذلك."]
    assert split("i like it. it is good. we go home now.") == ["i like it.", "it is good.", "we go home now."]


def test_counts_do_not_depend_on_partitions(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    needed = S.keys_of(S._places(S.training_texts(df)))
    one, two = (S.counts_on(df.repartition(n))(needed) for n in (1, 5))
    local = S.EdgeCounts(needed)
    local.add([r.text for r in df.collect() if r.text])
    for counts in (one, two):
        assert (counts.edge[:-1] == local.edge[:-1]).all() and (counts.any[:-1] == local.any[:-1]).all()


def test_counts_of_words_and_characters_equal_counting_by_hand():
    counts = S.EdgeCounts(["Sw", "Ew", "SwThe", "SwThe end", "Ewend", "Ewthe end", "Sw~X", "Ew~nd", "Su", "Eu", "Su的结", "Eu的结"])
    counts.add(["The end of the end, The end.\n\nThe start and the end", "甲的结乙丙的结丁戊的结己庚辛"])
    got = {k: (int(counts.edge[i]), int(counts.any[i])) for k, i in counts.index.items()}
    assert got["SwThe"] == (2, 3) and got["SwThe end"] == (1, 1) and got["Ewend"] == (2, 4) and got["Ewthe end"] == (1, 2)
    assert got["Sw"] == got["Ew"] == (2, 12) and got["Sw~X"] == (2, 3) and got["Ew~nd"] == (2, 5)
    assert got["Su"] == got["Eu"] == (1, 12) and got["Su的结"] == (0, 3) and got["Eu的结"][1] in (0, 3, 6)


def test_every_place_of_unspaced_texts_is_counted_once():
    texts = ["甲乙丙丁。戊己庚辛壬癸。子丑寅卯辰巳午未申酉", "犬が走る。 猫が寝る。鳥が飛んで行きます", "ไทยไทย ไทยดี มาก ๆ ไทยไทย", "中文句子在这里。ไทยไทย ไทยดี มาก又是中文"]
    keys = ["Su", "Eu"] + [s + "u" + x[i : i + k] for s in "SE" for x in texts for k in S.WIDTHS for i in range(len(x) - k + 1)]
    counts = S.EdgeCounts(dict.fromkeys(keys))
    counts.add(texts)
    thai = lambda c: bool(S.THAI.match(c))
    want = dict.fromkeys(keys, 0)
    for x in texts:
        n = len(x)
        inner = [p for p in range(1, n - 1) if not (thai(x[p - 1]) or thai(x[p]))]
        starts = inner + [p for p in range(1, n) if x[p - 1] == " " and thai(x[p])]
        ends = inner + [p for p in range(1, n) if x[p] == " " and thai(x[p - 1])]
        for side, places in (("S", starts), ("E", ends)):
            want[side + "u"] += len(places)
            for k in S.WIDTHS:
                for p in places:
                    a, b = (p, p + k) if side == "S" else (p - k, p)
                    if a >= 0 and b <= n:
                        want[side + "u" + x[a:b]] += 1
    assert {k: int(counts.any[i]) for k, i in counts.index.items()} == want


def test_models_are_kept(tmp_path, model, labeller):
    path = str(tmp_path / "m.json")
    model.save(path)
    text = "Dr. Kelmar measured 4.5 percent. Who signed C-12, and when?"
    assert S.SentenceModel.load(path).units(text) == model.units(text)
    labeller.languages.save(path)
    assert L.Labeller(model, L.LanguageModel.load(path)).label([text]) == labeller.label([text])
