from siteloom.functions import html as H


def features(html, url="https://a.com/"):
    return dict(zip(H._NAMES, H.page_features(1, url, html)))


def test_null_and_broken_pages():
    for html in ("", "<", "<!", "<p", "<<<>>>", "<![CDATA[x", "plain"):
        f = features(html)
        assert f["title"] == "" and f["n_json_ld"] == 0
    assert features("plain")["text"] == "plain"


def test_open_paragraphs_and_lists_end():
    root = H.parse("<div><p>a<p>b<ul><li>c<li>d</ul>e</div>")
    tags = [(n.tag, n.text()) for n in root.walk()]
    assert tags == [("div", "a b c d e"), ("p", "a"), ("p", "b"), ("ul", "c d"), ("li", "c"), ("li", "d")]


def test_visible_text_leaves_out_what_is_not_seen():
    f = features("<title>T</title><style>s</style><script>var a='</p>'</script><noscript>n</noscript><p>a&nbsp;b<!-- c --><svg>g</svg></p>")
    assert f["text"] == "T a b"


def test_metas_links_images():
    f = features('<html lang=" de "><meta http-equiv="Content-Type" content="text/html; charset=x"><meta charset=""><link rel="Shortcut Icon" href=" /i "><img data-src="d"><img alt src="s">')
    assert f["lang"] == "de" and f["charset"] is None
    assert f["links"] == [("shortcut icon", "/i")]
    assert f["imgs"] == [(False, "d"), (True, "s")]


def test_linked_data():
    f = features(
        '<script type="application/ld+json">{"@graph":[{"@type":["Dentist","X"],"name":"N","telephone":["1","2"],"address":{"streetAddress":"S","addressLocality":"C","addressCountry":{"name":"US"}}}],}</script>'
        '<script type="application/ld+json">broken</script><script type="application/ld+json">[{"@type":"Thing","founder":{"@type":"Place","name":{"@value":"P"}}}]</script>'
    )
    assert f["n_json_ld"] == 2 and f["types"] == ["dentist", "thing", "x"]
    assert f["linked"] == [("business_name", "N"), ("phone", "1"), ("phone", "2"), ("street_address", "S"), ("city", "C"), ("full_address", "S, C, US"), ("business_name", "P")]


def test_microdata_names_need_an_organization():
    f = features('<div itemtype="http://schema.org/Store"><b itemprop="name">N</b><i itemprop="telephone" content="5"></i></div><div itemtype="http://schema.org/Person"><b itemprop="name">M</b></div>')
    assert f["microdata"] == [("business_name", "N"), ("phone", "5")]


def test_content_blocks():
    long = "word " * 12
    f = features(f"<nav><p>{long}</p></nav><main><p>{long}</p><div role=navigation><p>{long}</p></div><div><div></div><div></div><div></div><div>{long}</div></div><p>short</p></main><p>{long}</p>")
    assert [b.split()[0] for b in f["blocks"]] == ["word", "word"] and f["root_text"].endswith("short")
