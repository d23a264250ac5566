"""Problem 5: template residue, filler and messages where the content belongs.

Labelled exemplars are held in an inverted index from token to exemplar. Every
page is parsed once; the lines of its body (see ``main_content``) and its title
are the passages. A passage window retrieves the exemplars that share its tokens,
and the TF-IDF containment of one in the other decides:

* ``placeholder``: all of the exemplar lies in the window (a stretch the size of
  the exemplar is enough, real sentences may stand around it). Template syntax is a
  token of its own; names in brackets or percent signs are one only where they name
  something that a template fills in. Exemplars of talk about templates compete: where
  they hold more of the words around the syntax, it is an example and no residue;
* ``unset``: a window around the unset value lies in the exemplar, as where a price
  or an amount is printed;
* ``filler``: the window lies in the exemplar;
* ``message``: the line lies in the exemplar or, told in other words, almost all of
  it lies in the pool of all messages (words compared by their beginnings). A page is left out only if such
  lines cover (nearly) all the weight of its body, so a notice beside real
  content is none.

Text within quoting elements (pre, code, q, ...) is a sample, not residue. Token
weights come from the document frequencies over the bodies of all pages; words
that no exemplar has count with the mean weight of those that some have.

Defined results: null and empty html and pages without a body are no cases;
repeated pages are each reported; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, spread
from .encoding import repair
from .main_content import body_flags, page_lines

#: Least containment of a window or line, and least part of a body that messages must cover.
CONTAINED, COVERED = 0.6, 0.75
#: Tokens in a window of running text, the least that a filler window has, and tokens on each side of an unset value or of template syntax.
WINDOW, LEAST_FILLER, UNSET_SIDE, TALK_SIDE = 10, 4, 2, 8
#: Least containment in the pool of messages, the words in it that a line must have, and the letters by which they are compared.
POOLED, LEAST_POOLED, STEM = 0.8, 2, 5
#: Least part of the words around template syntax that exemplars of talk about it hold.
TALK = 0.2

#: Template syntax; each pattern becomes one marker token (fixed values).
MARKERS = (
    ("curly", r"\{\{\{?[^{}\n]{0,80}\}\}\}?"),
    ("statement", r"\{%[^%\n]{0,80}%\}"),
    ("erb", r"<%[=\-#]?[^%\n]{0,80}%>"),
    ("dollar", r"\$\{[^{}\n]{1,80}\}"),
    ("hash", r"#\{[^{}\n]{1,80}\}"),
    ("percent", r"%%?[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%%?(?![a-z])"),
    ("money", r"\$\$[A-Z][A-Z0-9_]*\$\$"),
    ("at", r"@@[A-Z][A-Z0-9_]*@@"),
    ("merge", r"\*\|[A-Z][A-Z0-9:_ ]*\|\*"),
    ("dunder", r"__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__"),
    ("bracket", r"\[(?:(?i:insert|your|add|enter|type|replace|placeholder|lorem)\b[^\[\]\n]{0,60}|[A-Z][A-Z]+(?:[ _/-][A-Z]+)*)\]"),
    ("here", r"\[[A-Z][a-z]+(?: [A-Z][a-z]+){0,3} Here\]"),
    ("slot", r"<(?i:your|insert|add|enter)\b[^<>\n]{1,60}>"),
    ("object", r"\[object \w+\]"),
    ("shortcode", r"\[/?[a-z]+_[a-z_]+(?: [^\[\]\n]*)?\]"),
)
#: Marks whose inner words must name something that a template fills in, and such words (fixed values).
_NAMED = frozenset(("percent", "money", "at", "merge", "dunder", "bracket"))
_SLOTS = frozenset(
    """your insert add enter type replace placeholder lorem here name firstname lastname fname lname first last business company shop store restaurant brand owner address street city town state
    region country zip zipcode postcode postal code phone telephone tel number mobile fax email mail url website site link href logo image img photo picture caption icon title headline heading header
    subtitle subheading slogan tagline text body copy content description paragraph summary intro date time day hours opening price amount total quantity product service item category user customer client
    year month button cta label value field variable var tbd todo unsubscribe view currency copyright greeting page section quote author""".split()
)
_INNER = re.compile(r"[A-Za-z]+")
_MARKER = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in MARKERS))

#: Exemplars by label (fixed values; one exemplar per line).
EXEMPLARS = {
    "placeholder": """
your headline goes here
your title here
your text here
your logo here
your company name here
your business name here
add your text here
add a short description here
insert your text here
insert text here
write a short paragraph about your services here
click to edit this text
click here to edit
describe what makes your shop special
placeholder copy replace before launch
placeholder text
this is placeholder copy
this is a sample page
this is dummy text
sample text replace
replace this text
todo heading
todo add
tbd tbd
fixme text
xxxx street city st
street address city st zip
street city state zip
firstname lastname
title goes here
content goes here
text goes here
description goes here
tagline goes here
hello world welcome to wordpress this is your first post edit or delete it
just another wordpress site
new page title
untitled document
platzhalter text
hier steht ihr text
hier kommt ihr text
ihre überschrift hier
votre texte ici
votre titre ici
texte à remplacer
escriba aquí su texto
su título aquí
seu texto aqui
seu título aqui
ваш текст здесь
заголовок здесь
ここにテキストを入力
見出しを入力
""",
    "unset": """
undefined null nan object price name title none nil invalid date per kilo kg total amount from only each hours open until rating stock stars
""",
    "talk": """
template templates templating syntax variable variables print prints printed write writes writing type typed typing called means meaning explains explain example examples snippet tutorial lesson course documentation manual reader readers learn
curly braces brackets double percent dollar sign signs escape tag tags expression expressions render renders engine markup code coder programmer developer developers language function string
environment setting settings folder directory path file command shell windows linux script help
vorlage vorlagen variable variablen schreibt ausgabe beispiel geschweifte klammern modèle variables affiche écrit exemple accolades plantilla variables escribe imprime ejemplo llaves шаблон переменная пишет пример скобки
""",
    "filler": """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum consectetuer nonummy nibh euismod tincidunt laoreet erat volutpat wisi
""",
    "message": """
page not found
not found
error page not found
file not found
nothing here
oops nothing here
oops something went wrong
something went wrong
something went wrong on our side
an error occurred
an unexpected error has occurred please try again later
we are sorry an error occurred while processing your request
sorry that link is broken
this page does not exist
the page you are looking for was moved removed or never existed
the page you requested could not be found
the page you are looking for does not exist
we could not find that address try the search or go back home
we cannot find that page
this page has wandered off
the requested url was not found on this server
the requested resource could not be found
please check the address and try again
return to the home page
go back home
internal server error
the server encountered an internal error
the server could not complete your request
application error a server side exception has occurred digest
application error a client side exception has occurred see the browser console for more information
bad gateway
bad request
gateway timeout
service unavailable
service temporarily unavailable
the server is temporarily unable to service your request
temporarily unavailable while we work on the server
connection timed out
this site can't be reached
error establishing a database connection
could not connect to the database
fatal error uncaught error call to undefined function in
fatal error allowed memory size exhausted
warning include failed to open stream no such file or directory in on line
warning undefined variable in on line
parse error syntax error unexpected in on line
notice undefined index in on line
traceback most recent call last
stack trace
access denied
access denied reference
permission denied
forbidden
gone
you don't have permission to access this resource
you are not authorized to view this page
your request has been blocked
your ip address has been blocked
unauthorized
too many requests slow down and try again
rate limit exceeded
one moment please
just a moment
please wait
please wait while we load the content
please wait while your request is being verified
loading
loading results
checking your browser before you proceed this takes up to seconds
checking your browser before accessing
verify that you are human by completing the step below
confirm that you are human by completing the step below
verifying you are human
please complete the security check to continue
complete the captcha
redirecting you will be redirected shortly
if you are not redirected click here
session expired please log in again
under construction
site under construction
coming soon
we'll be back soon
down for maintenance
closed for maintenance
our site is being updated please check back later
we are performing scheduled maintenance
planned outage reload this page in an hour
this website is offline
please enable javascript to continue using this application
you need to enable javascript to run this app
javascript is required
javascript is disabled in your browser
please turn javascript on and reload the page
this page requires scripts your browser does not support them or they are switched off
your browser is not supported
enable cookies to continue
this account has been suspended contact your hosting provider
account suspended
this domain is parked
this domain is for sale
this domain has expired
domain parked by the registrar
it works this is the default page of the web server
it works
welcome to nginx if you see this page the nginx web server is successfully installed and working further configuration is required
apache default page this is the default welcome page used to test the correct operation of the server
test page if you can read this the server software is installed
welcome if you can read this page the server software is installed
default web site page
web server default page
index of
index of parent directory name last modified size description
congratulations your site has been created
future home of something quite cool
welcome
error
oops
sorry
http error
our servers are busy right now please come back later
the server is overloaded or down try again in a few minutes
we are experiencing technical difficulties
our team has been notified and is working on a fix
this service is currently offline
the site is down please come back soon
we are working to bring it back as soon as possible
the link you followed may be broken or the page may have been removed
we looked everywhere but this page is missing
this content is no longer available
this page has been deleted or has expired
you must be logged in to view this page
you do not have the rights to see this
your connection was reset by the server
your browser sent a request that this server could not understand
unusual traffic from your network was detected
please confirm you are not a robot
the application failed to start see the log for details
the request took too long to process
this feature requires a modern browser with scripts enabled
seite nicht gefunden
die seite wurde nicht gefunden
die angeforderte seite konnte nicht gefunden werden
diese seite existiert nicht
es ist ein fehler aufgetreten
interner serverfehler
zugriff verweigert
wartungsarbeiten
wegen wartungsarbeiten nicht erreichbar
wir sind bald zurück
wird geladen
bitte warten
einen moment bitte
javascript ist deaktiviert bitte aktivieren sie es um die seite zu sehen
bitte aktivieren sie javascript
diese seite befindet sich im aufbau
page introuvable
page non trouvée
la page demandée est introuvable
une erreur est survenue
erreur interne du serveur
accès refusé
site en maintenance
site en construction
en cours de maintenance
chargement en cours
veuillez patienter
veuillez activer javascript pour afficher cette page
javascript est désactivé
página no encontrada
error página no encontrada
la página que busca no existe
se ha producido un error
error interno del servidor
acceso denegado
sitio en construcción
en mantenimiento
cargando
espere un momento
active javascript para ver esta página
página não encontrada
a página que procura não existe
ocorreu um erro
erro interno do servidor
acesso negado
sítio em manutenção
site em construção
em manutenção
a carregar
aguarde um momento
ative o javascript para ver esta página
страница не найдена
запрашиваемая страница не найдена
произошла ошибка
внутренняя ошибка сервера
доступ запрещён
ведутся технические работы
сайт на обслуживании
сайт находится в разработке
загрузка
подождите пожалуйста
включите javascript для просмотра этой страницы
ページが見つかりません
お探しのページは見つかりませんでした
エラーが発生しました
サーバーエラー
アクセスが拒否されました
メンテナンス中です
ただいまメンテナンス中です
準備中です
読み込み中
しばらくお待ちください
javascriptを有効にしてください
""",
}

_TOKEN = re.compile(r"\x01\w+\x02|[぀-ヿ㐀-鿿ー]+|[^\W\d_]+(?:['’][^\W\d_]+)*")
#: The same in plain text: letters of ASCII in lower case, blanks for all else.
_ASCII_TOKEN = re.compile(r"\x01\w+\x02|[a-z]+(?:'[a-z]+)*")
_PLAIN = "".join(c.lower() if c.isalpha() else " " for c in map(chr, range(128)))
_MARKS = re.compile(r"[{}%$@\[<*_]")
#: Paths and calls, which differ from server to server.
_CODE = re.compile(r"\S*/\S*/\S*|\w+\([^()\s]*\)")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")


def _marked(m: re.Match) -> str:
    """The token of a mark, or its inner words where they name nothing that a template fills in."""
    inner = _INNER.findall(m[0])
    if m.lastgroup in _NAMED and not any(w.lower() in _SLOTS for w in inner):
        return " " + " ".join(inner) + " "
    return f" \x01{m.lastgroup}\x02 "


def tokens(text: str) -> list[str]:
    """Words without numbers, pairs of characters where no blanks part words, and marker tokens."""
    if _MARKS.search(text):
        text = _MARKER.sub(_marked, text)
    if "/" in text or "(" in text:
        text = _CODE.sub(" ", text)
    if text.isascii():
        return _ASCII_TOKEN.findall(text.lower()) if "'" in text or "\x01" in text else text.translate(_PLAIN).split()
    words = _TOKEN.findall(text.lower().replace("’", "'"))
    if not _CJK.search(text):
        return words
    out: list[str] = []
    for word in words:
        if _CJK.match(word):
            out += [word[i : i + 2] for i in range(max(1, len(word) - 1))]
        else:
            out.append(word)
    return out


@lru_cache(maxsize=1)
def _index() -> tuple[list[tuple[str, Counter]], dict[str, list[int]]]:
    """The exemplars and the inverted index from token to exemplar."""
    exemplars = [(label, Counter(tokens(line))) for label, lines in EXEMPLARS.items() for line in lines.strip().split("\n")]
    exemplars += [("placeholder", Counter([f"\x01{name}\x02"])) for name, _ in MARKERS]
    index: dict[str, list[int]] = defaultdict(list)
    for k, (_, bag) in enumerate(exemplars):
        for token in bag:
            index[token].append(k)
    return exemplars, dict(index)


#: Words too common to retrieve an exemplar by; they still count in its weight (fixed values).
_COMMON = frozenset("a an the of to in on for is are was and or we you your our this that it its be if at by not no do does can with has have here page un une la le les el los de du des et y a o os as um uma der die das ein eine es ist sie nicht bitte в на не и este esta ce cette site welcome title name address price".split())


@lru_cache(maxsize=1)
def _telling() -> dict[str, list[int]]:
    """The inverted index that retrieves: by the tokens that are not common, all tokens where none is. Unset values and talk are looked up around their marks."""
    exemplars, _ = _index()
    index: dict[str, list[int]] = defaultdict(list)
    for k, (label, bag) in enumerate(exemplars):
        if label not in ("unset", "talk"):
            for token in [t for t in bag if t not in _COMMON] or bag:
                index[token].append(k)
    return dict(index)


@lru_cache(maxsize=1)
def _placeholders() -> dict[str, list[int]]:
    """The part of the retrieving index that leads to placeholders."""
    exemplars, _ = _index()
    slots = {t: [k for k in found if exemplars[k][0] == "placeholder"] for t, found in _telling().items()}
    return {t: found for t, found in slots.items() if found}


@lru_cache(maxsize=1)
def _retrieving() -> tuple[frozenset[str], frozenset[str], dict[str, int]]:
    """All tokens of exemplars, those that retrieve, and the tokens of the smallest exemplar that each of these retrieves."""
    sets, telling = _sets(), _telling()
    return frozenset(_index()[1]), frozenset(telling), {t: min(len(sets[k]) for k in found) for t, found in telling.items()}


@lru_cache(maxsize=1)
def _sets() -> list[frozenset[str]]:
    return [frozenset(bag) for _, bag in _index()[0]]


@lru_cache(maxsize=1)
def _pool() -> tuple[frozenset[str], frozenset[str]]:
    """Beginnings of the words of all messages, and of those that are not common."""
    words = {t for label, bag in _index()[0] if label == "message" for t in bag}
    return frozenset(w[:STEM] for w in words), frozenset(w[:STEM] for w in words - _COMMON if len(w) > 1)


def _in_pool(words: set[str]) -> bool:
    """Whether a line may lie in the pool: enough of its words do, none weighed."""
    every, telling = _pool()
    stems = [w[:STEM] for w in words]
    return sum(map(every.__contains__, stems)) >= 0.6 * len(words) and sum(map(telling.__contains__, stems)) >= LEAST_POOLED


def _retrieved(bag: Counter | set[str]) -> set[int]:
    """Exemplars that share enough tokens with a window to be worth weighing."""
    return set(_shared(_retrieving()[0].intersection(bag), len(bag)))


def _shared(known: set[str] | frozenset[str], size: int) -> Iterator[int]:
    """The same by the exemplar tokens of a window of ``size`` different tokens."""
    _, telling, smallest = _retrieving()
    hits = known & telling
    if not hits:
        return
    least, n = 0.4 * size, len(known)
    if n < least and n < min(smallest[t] for t in hits):
        return
    sets, index = _sets(), _telling()
    for k in {k for t in hits for k in index[t]}:
        shared = len(known & sets[k])
        if shared >= least or shared >= len(sets[k]):
            yield k


def _worth(words: list[str], bag: set[str], known: set[str]) -> bool:
    """Whether a line or one of its windows retrieves an exemplar."""
    telling = _retrieving()[1]
    if known.isdisjoint(telling):
        return False
    if any(True for _ in _shared(known, len(bag))):
        return True
    if len(words) > WINDOW:
        for window in _windows(words):
            near = known.intersection(window)
            if not near.isdisjoint(telling) and any(True for _ in _shared(near, len(set(window)))):
                return True
    return False


def _windows(words: list[str]) -> Iterator[list[str]]:
    for at in range(0, max(1, len(words) - WINDOW + WINDOW // 2), WINDOW // 2):
        yield words[at : at + WINDOW]


#: Values that a template prints where it has none (fixed values).
_UNSET = frozenset({"undefined", "null", "nan"})
_SENTENCE = re.compile(r"(?<=[.!?:。])\s*")

_NOSCRIPT, _TAGS = re.compile(r"(?is)<noscript[^>]*>(.*?)</noscript"), re.compile(r"<[^>]*>")


def passages(html: str) -> list[tuple[str, str]]:
    """(place, text): the title and the lines of the body, quoted samples blanked.

    Where the main place is empty, visitors see what stands for missing scripts, and that is the body.
    """
    lines, regions = page_lines(html)
    out = []
    for line, body in zip(lines, body_flags(lines, regions)):
        if body:
            text = " ".join(line[1])
            for quoted in line[5]:
                text = text.replace(quoted, " ")
            out.append(("quoted" if line[5] and not text.strip() else "body", " ".join(line[1]) if not text.strip() else text))
    if not out:
        out = [("body", text) for text in (" ".join(_TAGS.sub(" ", x).split()) for x in _NOSCRIPT.findall(html)) if text]
    joined = "\n".join(text for _, text in out)
    if not joined.isascii():
        fixed = repair(joined)[1]
        if fixed and fixed.count("\n") == joined.count("\n"):
            out = [(place, text) for (place, _), text in zip(out, fixed.split("\n"))]
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", html)
    return [*([("title", title[1].strip())] if title and title[1].strip() else []), *out]


def _promising(html: str) -> tuple[list[tuple[str, str]], set[str]]:
    """The passages of a page, empty if none retrieves an exemplar, and the exemplar tokens in them."""
    vocabulary = _retrieving()[0]
    found, seen, hit = passages(html), set(), False
    for place, text in found:
        words = tokens(text)
        bag = set(words)
        known = bag & vocabulary
        seen |= known
        if not hit and place != "quoted" and known:
            hit = not _UNSET.isdisjoint(known) or _worth(words, bag, known) or place == "body" and _in_pool(bag)
    return (found if hit else []), seen


def _scan_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts, pages = Counter(), 0
    for pdf in batches:
        rows = []
        for page_id, html in pdf.itertuples(index=False):
            found, seen = _promising(html)
            counts.update(seen)
            pages += 1
            if found:
                rows.append((page_id, [p for p, _ in found], [t for _, t in found], None, None))
        if rows:
            yield pd.DataFrame(rows, columns=["page_id", "places", "texts", "token", "n"])
    rows = [(None, None, None, token, n) for token, n in [*counts.items(), ("", pages)]]
    out = pd.DataFrame(rows, columns=["page_id", "places", "texts", "token", "n"])
    out["page_id"] = out["page_id"].astype("Int64")
    yield out


class Scorer:
    """Decides pages with the weights of all tokens that some exemplar has."""

    def __init__(self, frequencies: dict[str, int]) -> None:
        n = max(1, frequencies.get("", 1))
        _, index = _index()
        self.weights = {t: math.log(1 + n / (1 + frequencies.get(t, 0))) for t in index}
        self.mean = sum(self.weights.values()) / max(1, len(self.weights))
        held = lambda label: {t for name, bag in _index()[0] if name == label for t in bag}
        self.talk, self.unset_words, self.filler_words = held("talk"), held("unset"), held("filler")

    def weight(self, words: list[str]) -> float:
        return sum(self.weights.get(w, self.mean) for w in words)

    def contained(self, words: list[str]) -> float:
        """The best containment of one window in a message."""
        exemplars, _ = _index()
        total, sets, best = self.weight(words), _sets(), 0.0
        if not total:
            return best
        for k in _retrieved(set(words)):
            if exemplars[k][0] == "message":
                best = max(best, sum(self.weights[t] for t in words if t in sets[k]) / total)
        if best < CONTAINED and _in_pool(set(words)):
            every, _ = _pool()
            pooled = sum(self.weights.get(t, self.mean) for t in words if t[:STEM] in every) / total
            best = max(best, pooled if pooled >= POOLED else 0.0)
        return best

    def placeholder(self, words: list[str]) -> bool:
        """Whether a stretch of the size of some placeholder exemplar holds all of it and is not talked about."""
        exemplars, _ = _index()
        slots = _placeholders()
        hits = slots.keys() & words
        if not hits:
            return False
        bag = Counter(words)
        for k in {k for t in hits for k in slots[t]}:
            exemplar = exemplars[k][1]
            own = 0.99 * sum(self.weights[t] * n for t, n in exemplar.items())
            held = lambda b: sum(self.weights[t] * min(n, b[t]) for t, n in exemplar.items())  # noqa: B023, E731
            size = exemplar.total()
            if held(bag) < own:
                continue
            for at in range(max(1, len(words) - size + 1)):
                if held(Counter(words[at : at + size])) >= own and not (size == 1 and self.talked(words, at)):
                    return True
        return False

    def talked(self, words: list[str], at: int) -> bool:
        """Whether the words around template syntax are talk about it, by weight."""
        around = [w for w in words[max(0, at - TALK_SIDE) : at + TALK_SIDE + 1] if w[0] != "\x01"]
        talk = sum(self.weights[w] for w in around if w in self.talk)
        return bool(around) and talk >= TALK * self.weight(around)

    def unset(self, text: str) -> float:
        """The best containment in the unset values of a window around one, within its sentence."""
        best = 0.0
        for words in map(tokens, _SENTENCE.split(text)):
            for at, word in enumerate(words):
                if word in _UNSET:
                    window = words[max(0, at - UNSET_SIDE) : at + UNSET_SIDE + 1]
                    best = max(best, sum(self.weights[w] for w in window if w in self.unset_words) / self.weight(window))
        return best

    def filler(self, window: list[str]) -> float:
        """Containment of a window in the filler text, if it has at least two of its longer words."""
        if sum(len(w) > 3 and w in self.filler_words for w in window) < 2:
            return 0.0
        return sum(self.weights[w] for w in window if w in self.filler_words) / self.weight(window)

    def verdict(self, places: list[str], texts: list[str]) -> tuple[str, float] | None:
        """(kind, coverage) of a page that is residue, else None."""
        total, lines = 0.0, []
        for place, text in zip(places, texts):
            words = tokens(text)
            if not words:
                continue
            if place != "quoted":
                if self.placeholder(words):
                    return "placeholder", 1.0
                if not _UNSET.isdisjoint(words) and (value := self.unset(text)) >= CONTAINED:
                    return "unset", value
                for window in [words] if len(words) <= WINDOW else _windows(words):
                    if len(window) >= LEAST_FILLER and (value := self.filler(window)) >= CONTAINED:
                        return "filler", value
            if place != "title":
                weight = self.weight(words)
                total += weight
                lines.append((weight, "" if place == "quoted" else text))
        covered = self.covered(lines, total)
        if total and covered / total >= COVERED:
            return "message", covered / total
        return None

    def covered(self, lines: list[tuple[float, str]], total: float) -> float:
        """The weight of the lines that are messages; 0 once the heaviest of the others leave too little for a body of messages."""
        spare, messages = (1 - COVERED + 1e-6) * total, set()
        for k in sorted(range(len(lines)), key=lambda k: -lines[k][0]):
            weight, text = lines[k]
            if text and self.message(text) >= CONTAINED:
                messages.add(k)
            else:
                spare -= weight
                if spare < 0:
                    return 0.0
        covered = 0.0
        for k in sorted(messages):
            covered += lines[k][0]
        return covered

    def message(self, text: str) -> float:
        """Containment of a line in messages: of the line as a whole or of its sentences."""
        whole = self.contained(tokens(text))
        if whole >= CONTAINED:
            return whole
        parts = [tokens(p) for p in _SENTENCE.split(text)]
        weights = [self.weight(p) for p in parts]
        if not sum(weights):
            return 0.0
        return sum(w for p, w in zip(parts, weights) if p and self.contained(p) >= CONTAINED) / sum(weights)


def _decide(frequencies: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(frequencies)
        for pdf in batches:
            rows = []
            for page_id, places, texts in pdf.itertuples(index=False):
                found = scorer.verdict(list(places), list(texts))
                if found:
                    rows.append((page_id, *found))
            yield pd.DataFrame(rows, columns=["page_id", "kind", "coverage"])

    return run


def residue(pages: DataFrame) -> DataFrame:
    """(page_id, kind, coverage) of every page that shows residue where the content belongs.

    The frequencies that reach the driver are those of the exemplars' own tokens,
    whose number the exemplars fix.
    """
    rows = spread(pages.filter(F.col("html").isNotNull() & (F.col("html") != "")).select("page_id", "html"))
    scanned = cut(rows.mapInPandas(_scan_batches, "page_id long, places array<string>, texts array<string>, token string, n long"))
    counts = {r.token: r.n for r in scanned.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n")).collect()}
    return scanned.filter(F.col("page_id").isNotNull()).select("page_id", "places", "texts").mapInPandas(_decide(counts), "page_id long, kind string, coverage double")
