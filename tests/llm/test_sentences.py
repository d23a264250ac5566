import pytest

from siteloom.llm import sentences as S

CASES = [
    "Mr. Hale left at 4 p.m. on Friday.|It rained.|Then, at 3.15 a.m., it stopped!",
    "“Run. Now.” was all she said.|He asked, “why?” and sat down.|See Fig. 4, e.g. the blue line.",
    "Das gilt z. B. hier, d. h. überall.|Am 5. Mai kam Dr. Weiß.|Warum?",
    "Est-ce tout ?|M. Roy dit : « Non. Restez. » et sort.|Voir p. 7.",
    "Так, т. е. верно.|В 2020 г. было 5 %.|Готово!",
]
CJK = ["他说：“走吧。快点。”然后笑了。|真的？|好！", "彼は「待て。」と言った。|本当？"]


@pytest.fixture(scope="module")
def weights():
    return S.train()


@pytest.mark.parametrize("case", CASES)
def test_paragraphs(weights, case):
    text = case.replace("|", " ")
    assert [text[a:b].strip() for a, b in zip([0, *S.units(text, weights)], S.units(text, weights))] == case.split("|")


@pytest.mark.parametrize("case", CJK)
def test_scripts_without_blanks(weights, case):
    text = case.replace("|", "")
    ends = S.units(text, weights)
    assert [text[a:b] for a, b in zip([0, *ends], ends)] == case.split("|")


def test_held_out_accuracy():
    """Boundaries between sentences of which none was trained on: every fifth sentence of each language is held out."""
    import random

    kept = {k: [x for i, x in enumerate(v.split("|")) if i % 5] for k, v in {**S.TRAINING, "th": S.TRAINING_THAI}.items()}
    held = {k: v.split("|")[::5] for k, v in S.TRAINING.items()}
    saved, saved_thai = S.TRAINING, S.TRAINING_THAI
    try:
        S.TRAINING, S.TRAINING_THAI = {k: "|".join(v) for k, v in kept.items() if k != "th"}, "|".join(kept["th"])
        weights = S.train.__wrapped__()
    finally:
        S.TRAINING, S.TRAINING_THAI = saved, saved_thai
    rng = random.Random(3)
    right = total = 0
    for language, sentences in held.items():
        for _ in range(30):
            text, ends = "", set()
            for sentence in rng.choices(sentences, k=4):
                text += (" " if text and language not in ("zh", "ja") else "") + sentence
                ends.add(len(text))
            found = S.candidates(text)
            tags = S._viterbi(found, weights)
            right += sum(tag == (end in ends) for (end, _), tag in zip(found, tags))
            total += len(found)
    assert right / total > 0.9, right / total


def test_long_paragraphs_take_time_in_proportion(weights):
    import time

    def seconds(n):
        text = "„Open mark here. A line “with one more. Next, that is it. " * n
        began = time.process_time()
        S.units(text, weights)
        return time.process_time() - began

    seconds(100)
    assert seconds(4_000) < 14 * max(seconds(500), 0.02)


def test_layout(weights):
    cell = "# A head. Not two.\nFirst line\ngoes on. Next one\n\n- item one. still one\n2. item two\n\nno end mark\n"
    ends = S.units(cell, weights)
    parts = [cell[a:b].strip() for a, b in zip([0, *ends], ends)]
    assert parts == ["# A head. Not two.", "First line\ngoes on.", "Next one", "- item one. still one", "2. item two", "no end mark"]
    assert S.units("", weights) == [] and S.units(" \n \n#\n", weights) == []


def test_thai(weights):
    text = "วันนี้ฝนตกหนักครับ เราจะเปิดไฟล์ `x.csv` กันนะคะ"
    ends = S.units(text, weights)
    assert len(ends) == 2 and ends[-1] == len(text)


def test_documents(spark):
    cell = "struct<cell_idx:int,cell_type:string,exec_count:int,mime:string,start_char:int,len_chars:int>"
    md = lambda a, n, kind="markdown": (0, kind, None, None, a, n)
    rows = [(1, "ü One. Two.\nx = 1", [md(0, 11), md(12, 5, "code"), None, md(None, 3), md(5, None), md(90, 5)], 1), (2, None, [md(0, 4)], 1), (3, "abc", None, 1), (4, "", [md(0, 0)], 1), (5, "y" * 200_000, [md(0, 200_000)], 1)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, cells array<{cell}>, end_char int")
    got = sorted(map(tuple, S.sentence_units(df).collect()))
    assert got == [(1, 6), (1, 11), (5, 200_000)]
    assert S.sentence_units(df.limit(0)).count() == 0
