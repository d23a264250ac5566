import numpy as np
import pytest

from siteloom.llm import encoding as E
from siteloom.llm import main_content as M
from siteloom.llm import residue as R

NAV = '<div class=q><ul><li><a href="/a">Home</a><li><a href="/b">Menu</a></ul></div>'
FOOT = '<div class=z><ul><li><a href="/c">© 2020 Us</a><li><a href="/d">Terms</a></ul></div>'
PROSE = "The bakery counter keeps rye loaves for regular guests and newcomers on most days."


def body(html):
    lines, regions = M.page_lines(html)
    return [" ".join(line[1]) for line, keep in zip(lines, M.body_flags(lines, regions)) if keep]


@pytest.mark.parametrize(
    "html",
    [
        f"<body>{NAV}<div class=k><h1>Head</h1><p>{PROSE}<p>{PROSE}</div>{FOOT}</body>",
        f"<body>{NAV}<div class=k><h1>Head</h1><p>{PROSE}<p>{PROSE}{FOOT}</body>",
        f"<table><tr><td>{NAV}</td></tr><tr><td><h1>Head</h1><p>{PROSE}</p><p>{PROSE}</p></td></tr><tr><td>We use cookies. Accept<br>Refuse</td></tr></table>",
    ],
)
def test_layouts_without_telling_names(html):
    assert body(html) == ["Head", PROSE, PROSE]


def test_short_messages_and_broken_pages():
    assert body(f"{NAV}<div>This site stores small files on your device, as you may know.<br>OK</div><div><p>Not Found</p></div>") == ["Not Found"]
    for html in (None, "", "<p>", "<p></p>"):
        assert body(html) == []


def test_ratios_decide():
    """Ratios dealt out at random change at least a third of the body lines; without the weight of opening tags few change."""
    rng = np.random.default_rng(5)
    body_lines = changed = plain = 0
    for n in range(120):
        side = "".join(f'<li><a href="/{k}">Story {k} of the week</a>' for k in range(n % 7))
        main = f"<h1>Head {n}</h1>" + f"<p>{PROSE} {n}" * (1 + n % 5)
        lines, regions = M.page_lines(f"<body>{NAV}<div>We use cookies. Details in our policy.<br>Accept</div><div>{main}</div><div><ul>{side}</ul></div>{FOOT}")
        flags, ratios = M.body_flags(lines, regions), M.text_ratios(lines)
        assert [" ".join(line[1]) for line, keep in zip(lines, flags) if keep] == [f"Head {n}", *[f"{PROSE} {n}"] * (1 + n % 5)]
        without = ratios - np.array([M.OPENS_CHARS * line[4] / line[2] for line in lines])
        body_lines += sum(flags)
        changed += sum(a and not b for a, b in zip(flags, M.body_flags(lines, regions, rng.permutation(ratios))))
        plain += sum(a != b for a, b in zip(flags, M.body_flags(lines, regions, without)))
    assert changed >= body_lines / 3
    assert plain <= 0.02 * body_lines


def test_blocks(spark, pages):
    archive = pages({"html": f"{NAV}<div><h1>Menu</h1><p>{PROSE}</div>{FOOT}", "url": "https://www.a.com/x/"}, {"html": None}, {"html": ""})
    rows = [
        (1, "http://a.com/x#top", "Home\n- Menu", 1), (2, "https://a.com/x", PROSE, 1), (3, "https://a.com/x", f"Home\n{PROSE}", 1), (4, "https://a.com/x", None, 1), (5, "https://a.com/x", " \n", 1),
        (6, "https://a.com/x", "© 2020 Us · Terms", 1), (7, None, "unknown page", 1), (8, None, "A sentence that stands on a page which nobody has.", 1), (9, "https://a.com/x", "Menu", 1), (1, "http://a.com/x#top", "Home\n- Menu", 1),
    ]
    blocks = spark.createDataFrame(rows, "passage_id long, url string, text string, line int")
    assert {r.passage_id for r in M.surroundings(archive, blocks).collect()} == {1, 6, 7}
    assert M.surroundings(archive, blocks.limit(0)).count() == 0
    bodies = M.main_bodies(archive).collect()
    assert [(r.page_id, r.body) for r in bodies] == [(0, f"Menu\n{PROSE}")]


CASES = [
    ("<h1>{{ page.title }}</h1><p>{{ body }}</p>", "placeholder"),
    (f"<p>{PROSE} ${{ctaLabel}}</p>", "placeholder"),
    ("<h1>Your headline goes here</h1><p>x</p>", "placeholder"),
    ("<h1>undefined</h1><p>Price: NaN undefined</p>", "unset"),
    (f"<p>{PROSE}</p><p>Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor.</p>", "filler"),
    ("<h1>Oops! Nothing here</h1><p>Sorry, that link is broken.</p>", "message"),
    ("<p>Fatal error: Uncaught Error: Call to undefined function get_header() in /srv/www/index.php:7</p>", "message"),
    ("<p>ページが見つかりません</p>", "message"),
    ("<noscript>You need to enable JavaScript to run this app.</noscript><div></div>", "message"),
    (f"<noscript>You need to enable JavaScript to run this app.</noscript><div><p>{PROSE}</p></div>", None),
    (f"<p>{PROSE}</p><p>Please enable JavaScript to continue using this application.</p>", None),
    ("<p>Printers have set the words lorem ipsum for ages; our course explains why the filler looks like Latin.</p>", None),
    (f"<p>{PROSE}</p><pre>Hello {{{{ guest }}}}, your table is ready.</pre>", None),
    (f"<script type='text/template'>{{{{ x }}}}</script><p>{PROSE}</p>", None),
    ("<p>A null result is a result: the lab explains what undefined means when jars are weighed twice.</p>", None),
]


def test_residue(spark, pages):
    rows = [{"html": f"<title>A shop | Us</title>{html}"} for html, _ in CASES] + [{"html": None}, {"html": ""}, {"html": "<p>" + "word " * 60_000}]
    got = {r.page_id: r.kind for r in R.residue(pages(*rows)).collect()}
    assert got == {k: kind for k, (_, kind) in enumerate(CASES) if kind}
    assert R.residue(pages(*rows).limit(0)).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "Welcome to our shop. Write a short paragraph about your services here.",
        "We bake bread daily in town. Write a short paragraph about your services here. Come and visit us soon.",
        "Our old news follow below. Hello world! Welcome to WordPress. This is your first post. Edit or delete it. More soon.",
        "We bake bread every day of the week in our shop. Price: undefined. Come and visit us in town.",
    ],
)
def test_residue_inside_long_lines(spark, pages, text):
    rest = "<p>The ovens are lit before dawn and the first loaves are on the shelves at six.</p>"
    html = f"<main><p>{text}</p>{rest}</main>"
    real = "<main><p>The value null means that nothing was stored there. Our undefined terms are listed in a table of words.</p>" + rest + "</main>"
    assert [r.page_id for r in R.residue(pages({"html": html}, {"html": real})).collect()] == [0]


def test_what_is_talked_about_and_what_is_printed(spark, pages):
    real = ["Call [MENU] or [PARKING] for hours", "Set %USERPROFILE% in your help text", "Write {{ name }} in a template to print the name of the guest", "Sorry, we are closed on the feast of the town"]
    bad = [f"{PROSE} The price of rye flour in the shop is undefined per kilo at the moment of asking you", "Lorem ipsum dolor sit amet", f"{PROSE} Call [PHONE NUMBER] for hours", f"{PROSE} Dear {{{{ name }}}}, come and see us", "We are experiencing difficulties, our team is working on a fix"]
    fill = f"<p>{PROSE}</p>" * 3
    rows = [{"html": f"<main><p>{t}</p>{fill}</main>"} for t in real[:3]] + [{"html": f"<main><p>{real[3]}</p></main>"}] + [{"html": f"<main><p>{t}</p></main>"} for t in bad]
    got = {r.page_id for r in R.residue(pages(*rows, *[{"html": f"<main>{fill}<p>Sorry, we are closed on the feast of the town. You are not here</p></main>"}] * 40)).collect()}
    assert got == {4, 5, 6, 7, 8}


def test_weights_matter():
    """A line of common words lies in the messages if all words weigh the same, and does not with the weights of the corpus."""
    weighed = R.Scorer({"": 10_000, **dict.fromkeys(R._index()[1], 30), **dict.fromkeys(R._COMMON, 8_000)})
    flat = R.Scorer({})
    flat.weights, flat.mean = dict.fromkeys(flat.weights, 1.0), 1.0
    text = ["Sorry, we are closed on the feast of the town"]
    assert weighed.verdict(["body"], text) is None and flat.verdict(["body"], text)


#: Messages in words that are not those of any exemplar.
HELD_OUT = """We couldn't locate the page you requested.|Sorry, this page doesn't exist anymore.|The website is temporarily down for maintenance. Please try again later.|Something broke on our end. Please try again in a few minutes.
Your access to this page has been denied.|We'll be right back after a short maintenance.|This page needs JavaScript. Please enable it in your browser.|Service is temporarily unavailable, please try again later.
The server encountered an error and could not complete your request.|Too many requests. Please wait a moment and try again.|Checking your browser, please wait.|This domain name has expired.|Our website is under construction. Please check back soon.
Connection to the database failed.|You have been blocked from accessing this site.|The requested page was not found.|Please wait while the page is loading.|Welcome to nginx! Further configuration is required.|Your session has timed out. Please log in again.
Diese Seite konnte nicht gefunden werden.|Die Website ist wegen Wartungsarbeiten vorübergehend nicht erreichbar.|La page que vous cherchez n'existe pas.|Une erreur interne est survenue.|No se ha podido encontrar la página.
Страница, которую вы ищете, не найдена.|ページが存在しません|Our servers are taking a nap, come back after lunch."""


def test_recall_on_held_out_wordings():
    scorer = R.Scorer({"": 10_000, **dict.fromkeys(R._index()[1], 30), **dict.fromkeys(R._COMMON, 8_000)})
    texts = [t for line in HELD_OUT.split("\n") for t in line.split("|")]
    exemplars = set(R.EXEMPLARS["message"].split("\n"))
    assert not any(t.lower().strip(".") in exemplars for t in texts)
    assert sum(bool(scorer.verdict(["body"], [t])) for t in texts) >= 0.75 * len(texts)


BROKEN = ["<", "</", ">", "<!--", "-->", "<!", "<![CDATA[", "<?", "&amp;", "&", "'", '"', "<br/>", "<p/>", "<script>", "</script >", "<style>", "</style>", "<title>", "</title>", "<svg/>", "<a <b>", "</ p>", "</p x>", "<A HREF='x>", "<1>", "<body>", "<x-y>", "<pre>", "<head>", "<textarea>", "<p>", "<div>", "</div>", "\n", "word", "é"]


def test_pieces_as_the_library_reads_them(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(BROKEN, rng.integers(1, 20))) for _ in range(3000)] + [f"<body>{NAV}<div><h1>A &amp; B</h1><p>{PROSE}</div><!-- x --><script>a<b</script>{FOOT}</body>"]
    got = [M.page_lines(t) for t in texts]
    monkeypatch.setattr(M._Lines, "goahead", M.HTMLParser.goahead)
    assert got == [M.page_lines(t) for t in texts]


def test_work_for_a_page_of_prose(monkeypatch):
    """Well-formed tags do not reach the library, and lines of prose are not weighed against messages once they settle the page."""
    calls = []
    monkeypatch.setattr(M.HTMLParser, "parse_endtag", lambda *_: calls.append("tag"))
    html = f"<body>{NAV}<div><p>Page not found</p>" + f"<p>{PROSE}</p>" * 20 + f"</div>{FOOT}</body>"
    places, texts = zip(*R.passages(html))
    scorer, message = R.Scorer({}), R.Scorer.message
    monkeypatch.setattr(R.Scorer, "message", lambda self, text: calls.append(text) or message(self, text))
    assert len(texts) == 21 and scorer.verdict(places, texts) is None
    assert "tag" not in calls and len(calls) <= 7


def test_screen_and_tokens_in_plain_text():
    screened = lambda text: bool(E._SCREEN.search(text))
    assert all(map(screened, ["cafÃ©", "aÖ", "aя", "яa", " Èa", "î,", "漢a", "a漢", "é’x", "жÀ", "ÀÀÀ", "яЯ", "¤"]))
    assert not any(map(screened, ["", "plain", "© 2020 Us", "café – 5 €", "L’été", "Ölfarbe", "«да»", "漢字。", "ça va"]))
    assert R.tokens("It's 2 x_Y o''clock") == ["it's", "x", "y", "o", "clock"] and R.tokens("A\x01b\x02 c") == ["a", "\x01b\x02", "c"]
    assert R.tokens("Dear {{ name }}, see a/b/c") == ["dear", "\x01curly\x02", "see"]
