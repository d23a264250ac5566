import pytest

from siteloom.llm import encoding

SOUND = [
    "L’équipe prépare « un œuf à la coque » pour 23 €.", "Größe über Straße – „schön“", "¡Mañana! ¿Qué?", "A CONFECÇÃO DÁ MAÇÃS NO PAVILHÃO", "Пекарня готовит хлеб. САЛОН", "当店は平日に21種類のお茶を準備しています。Torinholm支店", "🍞 price £5 × 2", "SÃO", "“IRMÃ”",
]


@pytest.mark.parametrize("text", [*SOUND, None, "", "plain ascii", "caf&#233; &amp; bar"])
def test_sound_text_is_left_alone(text):
    assert encoding.repair(text)[0] is False


@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251", "gb18030"])
@pytest.mark.parametrize("text", ["Die Bäckerei öffnet für Größen", "L’équipe préfère l’été près de Noël", "la peluquería cuida piñas y melón"])
def test_utf8_read_wrongly_is_restored(text, read_as):
    garbled = text.encode().decode(read_as, "replace") if read_as != "cp1252" else "".join(bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())
    case, restored, _ = encoding.repair(garbled)
    assert case
    if "�" not in garbled:
        assert restored == text


def test_layers_and_places():
    twice = "délai".encode().decode("latin-1").encode().decode("latin-1")
    assert encoding.repair(f"sans {twice} ici, mañana") == (True, "sans délai ici, mañana", True)


@pytest.mark.parametrize(("written", "read"), [("cp1251", "latin-1"), ("koi8-r", "cp1251"), ("cp1252", "mac_roman"), ("cp932", "cp1252"), ("euc_jp", "latin-1")])
def test_legacy_round_trips(written, read):
    text = {"cp1251": "Пекарня готовит свежий хлеб", "koi8-r": "Пекарня готовит свежий хлеб", "cp1252": "L’école prépare la crème près", "cp932": "木製の額縁を修理します", "euc_jp": "木製の額縁を修理します"}[written]
    try:
        garbled = text.encode(written).decode(read)
    except UnicodeDecodeError:
        garbled = "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(read) for b in text.encode(written))
    assert encoding.repair(garbled)[:2] == (True, text)


def test_lost_bytes_and_references():
    assert encoding.repair("el jard�n") == (True, None, False)
    assert encoding.repair("caf&#195;&#169;") == (True, "café", True)


def test_table(spark):
    pages = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "<p>cafÃ©</p>", "x"), (3, "<p>cafÃ©</p>", "x"), (4, "café", "x"), (5, "a" * 300_000 + " fÃ¼r", "x")], "page_id long, html string, table_name string")
    answers = spark.createDataFrame([(7, "naÃ¯ve", 1)], "answer_id long, excerpt string, row_id int")
    got = encoding.repair_encoding(pages, answers).select("table_name", "row_id").collect()
    assert sorted(map(tuple, got)) == [("answer", 7), ("crawl_archive", 3), ("crawl_archive", 3), ("crawl_archive", 5)]
    assert encoding.repair_encoding(pages.limit(0), answers.limit(0)).count() == 0
