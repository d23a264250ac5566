"""Problem 9: sentence units of prose across languages and scripts.

Characters are tagged as boundary or inside by a linear-chain sequence model with
Viterbi decoding. Only the last character of a group of end marks (or, in scripts
without end marks, the character before a blank) can be a boundary; all other
characters are inside whatever stands around them, so the chain is decoded over
these places with the step from one tag to the next weighed as well. The weights come
from an
averaged structured perceptron trained on the labelled sentences below, strung
together at random; for Thai the model is trained on text without punctuation.

Layout decides first: a heading line and a list item are units of their own, a
paragraph ends at a blank line, a list, a heading or the end of its cell, and line
breaks within it are blanks. What stands in paired quotation marks is never cut.

Defined results: null texts, null cell lists, null or empty cells and cells out of
the text's range give no units; blank units are none; a place is one unit's end
once in each row; repeated notebooks are each reported.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import spread

ROUNDS, PARAGRAPHS, SEED = 6, 900, 9

#: Abbreviations that something follows, and those that may also end a sentence (fixed values, lower case, without the last mark).
NEVER_LAST = frozenset(
    """dr prof mr mrs ms st sr sra srta dra fig figs no nos sec secs eq vol ch pp p cf vs viz approx ca e.g i.e al ed eds gen col sgt capt lt hon rev ref refs
    bzw vgl nr abb abschn kap bd z d s o u b hr fr frau med ing dipl evtl ggf inkl zzgl gl tab aufl str geb
    m mm mme mlle me env chap sect art c.-à-d p.ex ex sq
    pág págs fig aprox núm ee ej p.ej n.º n.o art cap ud uds
    см стр гл рис табл проф акад доц ок т тов ул им напр св г-н г-жа пер ср
    د أ م م.د ص डॉ श्री पं प्रो कु रु""".split()
)
MAY_END = frozenset("etc usw u.s u.k u.s.a e.u a.m p.m inc corp ltd co jr sr bros min h uu std sek uhr km kg cm ff uu г гг в вв д др п пр руб коп мин сек тыс млн".split())
_MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner jahrhundert".split())
#: Labelled sentences by language (training data; a bar divides the sentences of one line that stand together).
TRAINING = {
    "en": """The rows are sorted by date.|It works.|Is that right?|No!|Dr. Amber Lane wrote the first draft.|We met Mr. Reed at 5 p.m. on Monday.|The office opens at 9 a.m. and closes late.|She moved to the U.S. in 2011.|The U.S. data were clean.|See Fig. 3 for the curve.|Cf. sec. 4.2 of the guide.|They sell pens, paper, etc.|Use e.g. a short list, i.e. three items.|The firm Oak Corp. and Pine Ltd. merged.|He works for Oak Inc.|The mean is 4.5 and the median is 4.|“Stop. Think first. Then write.” was the rule on the wall.|She said, “Do not move!” and left.|The sign reads “No entry.” in red.|It broke… again, of course.|Wait…|pandas keeps the order.|x is small.|y grows with time.|numpy was faster.|Call `run()` first.|The path is `data.csv`.|What?!|(This takes five minutes.)|J. R. Stone measured it twice.|The vote was 5 vs. 3 in the end.|We keep values (approx. 20 %) of it.|St. Mary was the last stop.|Nobody knows!|We used No. 12 of the series.|Set a = .5 and run.|"Never again," wrote Prof. Lund.|The job ends at 6 p.m.|Read p. 12 and pp. 14 to 20.|Why does it fall after row 8?|He asked, “is it random?” and went on.|The list has 12 rows.|It ends at 14.|Version 2.0 is out.|iloc counts rows.|Then came Lake St. Clair, a calm place.|We met Prof. Dr. Hale, cf. Fig. 2.|Ask the firm, e.g. Oak Ltd. in Leeds.|We tried Jazzo! Max, the new kit.|She sells Bingo! Plus, a board game.|Finally, it stopped.|Next, we rest.|Well, that is all.|12 rows are gone.|See Vol. 3 and Ch. 4.""",
    "de": """Wir lesen die Datei.|Das ist z. B. eine Zahl.|Das gilt, d. h. es stimmt.|Dr. Kern kam spät.|Prof. Dr. Lang sah zu, vgl. Abb. 4 auf S. 12.|Am 3. Oktober war es kalt.|Der 2. Versuch gelang.|Es kostet ca. 5 Euro.|Es dauert 10 Min. auf dem Gerät.|Wir nehmen Mehl, Zucker usw.|Siehe Kap. 3 bzw. Abschn. 4.1 im Buch.|Nr. 7 fehlt.|Warum?|Halt!|„Geh nicht!“, rief er laut.|„Warte. Denk nach.“ stand an der Tafel.|Der Wert … sinkt weiter.|Der Zug fährt um 12.30 Uhr.|Frau Dr. med. Huber half.|Der Anteil beträgt 4,5 %.|Die Version 2.1 ist neu.|Vgl. hierzu Tab. 3.|Es sind rund 3.000 Zeilen.|Sie wohnt in der Hauptstr. 5.|Danach folgt Tab. 12.|Das steht auf S. 31.|Laut Prof. Dr. Weber reicht das, vgl. Tab. 2.|Siehe Bd. 2 bzw. Kap. 9.|12 Zeilen fehlen.|Er kam am 1. Mai.""",
    "fr": """On lit le fichier.|Est-ce vrai ?|Attention !|M. Duval est venu.|Mme Petit dit : « Oui. Partez. » puis sort.|« Ne bougez pas ! » crie le garde.|La valeur est 4,5, c.-à-d. peu.|Cf. chap. 2, sect. 3.1.|Voir p. 4 pour la suite.|On garde le nom, l’âge, etc.|Cela dure env. 5 s.|Le Dr Roux propose 3 jours, cf. fig. 2.|Le résultat est 7,8…|Il y a env. 20 000 lignes.|Il hésite… puis repart.|Du 1er mars au 3 juin.|La figure est la fig. 12.|Pourquoi ?""",
    "es": """Leemos el archivo.|¿Es cierto?|¡Cuidado!|El Dr. Ruiz llegó tarde.|La Sra. Gil dijo: «Espere. Luego salga.» y se fue.|En EE. UU. llueve más.|Cuesta aprox. 5 euros.|Tarda 10 min. en total.|Es así, p. ej. hoy.|Véanse las págs. 2 y 3.|El tren n.º 4 sale a las 8.30 h.|Guardamos todo, etc.|La cifra es 4,5 %.|¿Y si no?|Véase la fig. 12.|Vive en EE. UU.|Son las 9.15 h.""",
    "ru": """Читаем файл.|Так ли это?|Готово!|Это верно, т. е. всё хорошо.|Так как, т. к. сеть мала.|По словам проф. А. Б. Орлова, хватит, см. рис. 3.|В 2019 г. и 2020 г. было тепло.|На стр. 4 и в гл. 5 есть ответ.|Это длится ок. 5 мин.|Берём имя, дату и т. д.|«Не спеши!» — сказал он.|Ответ «Да. Идите.» всех удивил.|Ошибка исправлена…|Он думал… и молчал.|Это было в 2021 г.|Есть мел, доска и т. п.|Среднее равно 4,5 %.|Смотри рис. 12.""",
    "zh": """我们读文件。|真的吗？|注意！|他说：“别走。等一下。”然后走了。|“快来！”妈妈说。|（大约五分钟。）|平均为3.5，较低。|误差为2%……还行。|大约5……不多。|然后保存结果……|见图2.3。|模型收敛；误差上升。|我们继续……|“好的。”她笑着说。""",
    "ja": """ファイルを読みます。|本当ですか？|注意！|彼は「行くな。待て。」と言いました。|「なぜ？」と聞きました。|（約五分です。）|平均は3.5です。|差は2.1……悪くない。|続けます……|表2.3の通りです。|母は「早く！」と呼んだ。|約3……少ない。""",
    "hi": """हम फ़ाइल पढ़ते हैं।|क्या यह सही है?|ध्यान दें!|डॉ. Mehta आए।|“रुको। पहले सोचो।” उसने कहा।|औसत 3.5 है।|श्री Rao ने पूछा।|“यह क्या है?” माँ ने पूछा।|इसमें पाँच मिनट लगे।|संस्करण 2.0 नया है।|3 लोग आए।|12 पेड़ कटे।""",
    "ar": """نقرأ الملف.|هل هذا صحيح؟|انتبه!|جاء د. سالم اليوم.|قال المعلم: «انتظر. فكر أولا.» ثم خرج.|المتوسط هو 3.5 فقط.|يستغرق ذلك خمس دقائق؛ لا بأس.|«تعال!» قالت الأم.|الإصدار 2.0 جديد.""",
}
#: Thai sentences; blanks inside stand only around words of other scripts and after lead-in phrases.
TRAINING_THAI = """วันนี้อากาศดีมาก|เขาไปโรงเรียนแล้วครับ|เราจะเริ่มกันเลยนะคะ|ข้อมูลนี้มาจากไฟล์ `a.csv` ที่แนบไว้|ใช้คำสั่ง `run` เพื่อเริ่มงาน|ค่า mean สูงกว่าเดิม|คอลัมน์ x_1 มีค่าว่าง|ทำไมกราฟไม่ขึ้น|ผลออกมาดีขึ้น|จากนั้นลบข้อมูลที่ซ้ำ|ขั้นตอนนี้ใช้เวลา5นาทีครับ|รุ่น2.0เร็วกว่าเดิม|ต่อไปเราจะแบ่งตารางค่ะ|แมวนอนอยู่บนโต๊ะ|ฝนตกหนักเมื่อคืน|พวกเขาเดินทางไปเชียงใหม่แล้ว|เราวาดกราฟของ age กันนะคะ|ลองเปิดไฟล์ `b.txt` ก่อน|ฉันชอบกินข้าวผัด|มันคือค่าเฉลี่ยของทั้งหมด|ตารางมี10แถว|จากนั้นเรียก `fit()` อีกครั้ง|เพื่อนของฉันทำงานที่ธนาคาร|หนังสือเล่มนี้สนุกมาก|อ่าน `doc` เพิ่มเติมได้ที่นี่|ขอบคุณค่ะ|ลองดูตัวอย่าง เช่น ตารางแรก|ค่ากลางต่ำกว่าเดิม"""

_MARKS = ".!?…。！？।॥؟۔｡"
_CLOSERS = "\"'”’»)\\]」』）】›“*_"
_END = re.compile(rf"[{re.escape(_MARKS)}]+(?:[{_CLOSERS}]|[   ](?=»))*")
_THAI = re.compile(r"[฀-๿]")
_THAI_BLANK = re.compile(r"\s+(?=\S)")
_TOKEN_BEFORE = re.compile(r"[^\s\"“”„«»‹›「」『』()（）\[\]`*—–]+$")
_BEGIN = re.compile(r"(?:^|[.!?…]\S?\s)\s*$")
_LIST = re.compile(r"\s*(?:[-*+•‣]|\d{1,4}[.)])\s+\S")
_NUMBERED = re.compile(r"\s*\d")
_HEADING = re.compile(r"\s{0,3}#{1,6}(?:\s|$)")
_PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "‹": "›", "„": "“”", '"': '"'}
_QUOTE = re.compile("|".join(_PAIRS))
_BLANKS, _LETTERS = re.compile(r"\s*"), re.compile(r"[^\W\d_]+")


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Stretches within paired quotation marks; a mark without its partner opens none.

    Marks are visited once from the left, and a closing mark that is not found is not
    looked for again, so long texts with open marks take no more time than others.
    """
    spans, at, ended = [], 0, set()
    for m in _QUOTE.finditer(text):
        if m.start() < at:
            continue
        ends = []
        for closer in _PAIRS[m[0]]:
            if closer not in ended:
                end = text.find(closer, m.end())
                if end < 0:
                    ended.add(closer)
                else:
                    ends.append(end)
        if ends:
            spans.append((m.start(), min(ends)))
            at = min(ends) + 1
    return spans


def _next_kind(text: str, at: int) -> tuple[str, bool, str, bool]:
    """(kind of what follows, whether a blank comes before it, the following word, whether a comma comes after that)."""
    start = _BLANKS.match(text, at).end()
    if start >= len(text):
        return "end", start > at, "", False
    word = _LETTERS.match(text, start)
    comma = word is not None and text[word.end() : word.end() + 1] == ","
    return (*_kind(text[start], start > at, word[0].lower() if word else ""), comma)


def _kind(char: str, blank: bool, word: str) -> tuple[str, bool, str]:
    if char.isdigit():
        return "digit", blank, word
    if char in "¿¡“«„「『(（[\"‹":
        return "open", blank, word
    if char in "—–-―":
        return "dash", blank, word
    if char == "`":
        return "code", blank, word
    if char.isalpha():
        if char.isupper():
            return "upper", blank, word
        if char.islower():
            return "lower", blank, word
        return "letter", blank, word
    return "sign", blank, word


def _features(text: str, start: int, end: int) -> list[str]:
    """Features of the end marks text[start:end] as a boundary."""
    group = text[start:end]
    marks = group.rstrip(_CLOSERS + "   ")
    mark = marks[-1:] if len(set(marks)) == 1 else "mix"
    if len(marks) > 1 and mark == ".":
        mark = "…"
    closed = group[len(marks) :].strip()
    quote = any(c in "\"”’»」』›“" for c in closed)
    paren = any(c in ")）]】" for c in closed)
    following, blank, word, comma = _next_kind(text, end)
    token = _TOKEN_BEFORE.search(text, max(0, start - 24), start)
    token = token[0] if token else ""
    low = token.lower().strip(_MARKS)
    before = text[start - 1 : start]
    if mark == "." and low:
        if low in NEVER_LAST:
            kind = "never"
        elif low in MAY_END:
            kind = "may"
        elif len(low) == 1 and low.isalpha():
            kind = "initial" if token.isupper() else "single"
        elif "." in low and low.replace(".", "").isalpha() and len(low) < 7:
            kind = "dotted"
        elif before.isdigit():
            kind = "number"
        else:
            kind = "word"
    else:
        kind = "digit" if before.isdigit() else "percent" if before in "%％" else "blank" if before.isspace() else "code" if before == "`" else "text"
    closing = "quote" if quote else "paren" if paren else "bare"
    out = [
        "bias",
        f"m={mark}",
        f"k={mark}{kind}",
        f"n={following}",
        f"kn={kind},{following}",
        f"mkn={mark},{kind},{following},{blank}",
        f"c={closing}",
        f"cn={closing},{following}",
        f"cmn={closing},{mark},{following}",
        f"mb={mark},{blank}",
        f"name={mark},{token[:1].isupper()},{_BEGIN.search(text, max(0, start - 26), start - len(token)) is not None},{comma},{following}",
    ]
    if word in _MONTHS:
        out += ["month", f"month={kind}"]
    return out


def _thai_features(text: str, start: int, end: int) -> list[str]:
    """Features of the blank text[start:end] in text without end marks."""
    left, right = text[max(0, start - 4) : start], text[end : end + 4]
    a, b = bool(_THAI.match(left[-1:])), bool(_THAI.match(right[:1]))
    number = left[-1:].isdigit() or right[:1].isdigit()
    return ["thai", f"t={a}{b}", f"t#={a}{b}{number}", f"l2={left[-2:]}", f"l3={left[-3:]}", f"r2={right[:2]}", f"r3={right[:3]}", f"l2r2={left[-2:]}{right[:2]}"]


def candidates(text: str) -> list[tuple[int, list[str] | None]]:
    """(end, features) of the places of one paragraph that may be boundaries; features None: surely inside."""
    out = []
    spans = quoted_spans(text)
    thai = len(_THAI.findall(text)) * 3 > sum(map(str.isalpha, text)) if _THAI.search(text) else False
    k, last, low_quote = 0, len(text.rstrip()), text.find("„")
    for m in _END.finditer(text):
        start, end = m.span()
        opener = text.find("“", start, end)
        if opener >= 0 and not 0 <= low_quote < start:
            end = opener
        if end >= last:
            break
        follows = text[end : end + 1]
        group = m[0].rstrip(_CLOSERS + "   ")
        if not follows.isspace() and (group[-1] in ".؟!?" or group[-1] == "…" and follows.isascii()) and not (group[-1] in "!?" and ord(follows) > 0x2E80):
            continue
        while k < len(spans) and spans[k][1] < start:
            k += 1
        inside = k < len(spans) and spans[k][0] < start and spans[k][1] >= end
        out.append((end, None if inside else _features(text, start, end)))
    if thai:
        for m in _THAI_BLANK.finditer(text):
            if m.start() and text[m.start() - 1] not in _MARKS:
                inside = any(a < m.start() < b for a, b in spans)
                out.append((m.start(), None if inside else _thai_features(text, *m.span())))
        out.sort(key=lambda x: x[0])
    return out


Weights = dict[str, float]


def _viterbi(found: list[tuple[int, list[str] | None]], weights: Weights) -> list[bool]:
    """The best tags of the places of one paragraph."""
    if not found:
        return []
    move = [[weights.get(f"y={a}{b}", 0.0) for b in (0, 1)] for a in (0, 1)]
    best, back = [0.0, weights.get("start", 0.0)], []
    for k, (_, features) in enumerate(found):
        emit = -1e9 if features is None else sum(weights.get(f, 0.0) for f in features)
        if k == 0:
            best = [0.0, emit]
            continue
        step = [max((0, 1), key=lambda a, b=b: best[a] + move[a][b]) for b in (0, 1)]
        best = [best[step[0]] + move[step[0]][0], best[step[1]] + move[step[1]][1] + emit]
        back.append(step)
    tag = int(best[1] > best[0])
    tags = [tag]
    for step in reversed(back):
        tag = step[tag]
        tags.append(tag)
    return [bool(t) for t in reversed(tags)]


def _examples() -> Iterator[tuple[str, set[int]]]:
    """Paragraphs strung together from the labelled sentences, with the true boundaries."""
    rng = random.Random(SEED)
    pools = {k: v.split("|") for k, v in TRAINING.items()} | {"th": TRAINING_THAI.split("|")}
    for _ in range(PARAGRAPHS):
        language = rng.choice([*pools, "en", "th"])
        glue = "" if language in ("zh", "ja") else " "
        text, ends = "", set()
        for sentence in rng.choices(pools[language], k=rng.randint(2, 6)):
            text += (glue if text else "") + sentence
            ends.add(len(text))
        yield text, ends


@lru_cache(maxsize=1)
def train() -> Weights:
    """Weights of the averaged structured perceptron."""
    weights: Weights = defaultdict(float)
    total: Weights = defaultdict(float)
    step = 1
    examples = [(candidates(text), ends) for text, ends in _examples()]
    rng = random.Random(SEED)
    for _ in range(ROUNDS):
        rng.shuffle(examples)
        for found, ends in examples:
            guess = _viterbi(found, weights)
            truth = [end in ends and features is not None for end, features in found]
            if guess != truth:
                for tags, sign in ((truth, 1.0), (guess, -1.0)):
                    for k, (tag, (_, features)) in enumerate(zip(tags, found)):
                        changed = list(features) if tag and features else []
                        if k:
                            changed.append(f"y={int(tags[k - 1])}{int(tag)}")
                        for f in changed:
                            weights[f] += sign
                            total[f] += sign * step
            step += 1
    return {f: w - total[f] / step for f, w in weights.items() if w - total[f] / step}


def units(cell: str, weights: Weights) -> list[int]:
    """Ends of the sentence units of one cell, closing marks included."""
    out: list[int] = []
    start = end = None

    def close() -> None:
        nonlocal start, end
        if start is not None:
            text = cell[start:end]
            found = candidates(text)
            out.extend(start + place for (place, _), tag in zip(found, _viterbi(found, weights)) if tag)
            out.append(start + len(text.rstrip()))
        start = end = None

    at, listed = 0, True
    for line in cell.split("\n"):
        stop = at + len(line)
        if not line.strip():
            close()
            listed = True
        elif _HEADING.match(line):
            close()
            if line.strip("# \t\r"):
                out.append(at + len(line.rstrip()))
            listed = True
        elif _LIST.match(line) and (listed or not _NUMBERED.match(line)):
            close()
            out.append(at + len(line.rstrip()))
            listed = True
        else:
            if start is None:
                start = at
            end = stop
            listed = False
        at = stop + 1
    close()
    return out


def _unit_batches(weights: Weights):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, ends = [], []
            for doc_id, cells in pdf.itertuples(index=False):
                own = sorted({cell["start"] + end for cell in cells for end in units(cell["cell"], weights)})
                ids += [doc_id] * len(own)
                ends += own
            yield pd.DataFrame({"doc_id": ids, "end_char": ends})

    return run


def markdown_cells(documents: DataFrame) -> DataFrame:
    """(doc_id, cells): the texts of the markdown cells with their offsets, cut out before Python sees them."""
    good = lambda c: (c["cell_type"] == "markdown") & (c["start_char"] >= 0) & (c["len_chars"] > 0)
    cells = F.transform(F.filter("cells", good), lambda c: F.struct(c["start_char"].cast("long").alias("start"), F.substring(F.col("text"), c["start_char"] + 1, c["len_chars"]).alias("cell")))
    return documents.filter(F.col("text").isNotNull() & F.exists("cells", good)).select("doc_id", cells.alias("cells"))


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, end_char) of every sentence unit of the markdown cells."""
    cells = markdown_cells(spread(documents.select("doc_id", "text", "cells")))
    return cells.mapInPandas(_unit_batches(train()), "doc_id long, end_char long")
