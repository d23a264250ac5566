"""The SQL of the catalog's queries, for an engine of its own (DuckDB).

Patterns over the raw html say here what the parsed tree says there.
"""

from __future__ import annotations

from ..functions import lexicon as lx


def _words(names: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + ")"


def _norm_url(u: str) -> str:
    part = lambda k: f"regexp_extract(trim({u}), '^(?:([A-Za-z][A-Za-z0-9+.\\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?', {k})"
    scheme = f"lower(CASE WHEN {part(1)} = '' THEN 'https' ELSE {part(1)} END)"
    host = f"CASE WHEN {scheme} = 'http' THEN regexp_replace(lower({part(2)}), ':80$', '') WHEN {scheme} = 'https' THEN regexp_replace(lower({part(2)}), ':443$', '') ELSE lower({part(2)}) END"
    path = f"regexp_replace({part(3)}, ';[^/]*$', '')"
    return f"({scheme} || '://' || ({host}) || (CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/+$', '') END) || (CASE WHEN {part(4)} = '' THEN '' ELSE '?' || {part(4)} END))"


def _host(u: str) -> str:
    return f"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)), '^www\\.', '')"


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\xa0"), ("&copy;", "©"), ("&amp;", "&"))


def _decoded(text: str) -> str:
    for name, char in _ENTITIES:
        text = f"replace({text}, '{name}', '{char}')"
    return text


def _without(text: str, tags: tuple[str, ...]) -> str:
    for tag in tags:
        text = f"regexp_replace({text}, '<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'gis')"
    return text


_PAGES = """
pages AS (
  SELECT page_id, site, crawl_idx, coalesce(status, 0) AS status, html, coalesce(nullif(final_url, ''), url, '') AS page, url, headers, content_type, error, redirect_chain,
         coalesce(from_probe, false) AS from_probe, coalesce(from_sitemap, false) AS from_sitemap, coalesce(from_citation, false) AS from_citation
  FROM crawl_archive)"""


def _numbered(raw: str) -> str:
    """Numeric references in a text, each replaced by its character."""
    return f"list_reduce(list_prepend({raw}, list_distinct(regexp_extract_all({raw}, '&#(\\d+);', 1))), lambda acc, r: replace(acc, '&#' || r || ';', chr(CAST(r AS INT))))"


_VISIBLE = f"""
stripped AS (
  SELECT page_id, page, {_decoded("regexp_replace(regexp_replace(" + _without("html", ("script", "style", "noscript", "svg", "iframe", "canvas", "template")) + ", '<!--.*?-->', ' ', 'gs'), '<[a-zA-Z/!][^>]*>', ' ', 'g')")} AS raw
  FROM pages WHERE html <> ''),
shown AS (SELECT page_id, page, {_numbered('raw')} AS text FROM stripped)"""
_TITLE = f"trim({_decoded("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")})"
_H1 = "regexp_extract_all(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)"
_ADMISSION = f"""CASE
  WHEN error = '{lx.ROBOTS_BLOCK_ERROR}' THEN 'blocked'
  WHEN coalesce(status, 0) >= 400 AND coalesce(from_probe, false) AND NOT coalesce(from_sitemap, false) THEN 'probe'
  WHEN coalesce(status, 0) >= 400 THEN 'failed'
  WHEN coalesce(status, 0) BETWEEN 300 AND 399 THEN 'moved'
  WHEN (coalesce(html, '') = '' OR NOT contains(coalesce(nullif(content_type, ''), 'html'), 'html')) AND coalesce(error, '') <> '' THEN 'unread'
  WHEN coalesce(html, '') = '' OR NOT contains(coalesce(nullif(content_type, ''), 'html'), 'html') THEN 'empty'
  ELSE 'audited' END"""
_LINKS = f"""
hrefs AS (
  SELECT page_id, page, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS i
  FROM pages WHERE html <> ''),
links AS (
  SELECT page_id, page, i, href, {_norm_url("CASE WHEN href LIKE '/%' THEN regexp_extract(page, '^([^:]+://[^/?#]*)', 1) || href ELSE href END")} AS target
  FROM hrefs WHERE href <> '' AND href NOT LIKE '#%'),
firsts AS (SELECT page_id, target, min(i) AS i FROM links GROUP BY page_id, target)"""
_AUDITED = f"""
{_PAGES.strip()},
{_VISIBLE.strip()},
{_LINKS.strip()},
admitted AS (SELECT *, {_ADMISSION} AS admission FROM pages WHERE NOT from_citation),
counts AS (SELECT page_id, count(*) AS n FROM links WHERE {_host("target")} = {_host("page")} GROUP BY page_id),
ok AS (
  SELECT a.*, {_TITLE} AS title, s.text, len(regexp_extract_all(s.text, '[A-Za-z0-9'']+')) AS n_words, {_H1} AS h1, coalesce(c.n, 0) AS n_internal
  FROM admitted a JOIN shown s USING (page_id) LEFT JOIN counts c USING (page_id) WHERE admission = 'audited')"""
_W = "[\\s\\x{1C}-\\x{1F}\\x{85}\\p{Z}]"
_RULES = f"""
rules AS (
  SELECT site, page, page_id, crawl_idx, 'http_error_status' AS metric, CASE WHEN status >= 500 THEN 'high' ELSE 'medium' END AS severity, CAST(status || ' ' || coalesce(url, '') || ' ' || coalesce(error, '') AS VARCHAR) AS sig FROM admitted WHERE admission = 'failed'
  UNION ALL SELECT site, page, page_id, crawl_idx, 'fetch_error', 'medium', CAST(coalesce(error, '') AS VARCHAR) FROM admitted WHERE admission = 'unread'
  UNION ALL SELECT site, page, page_id, crawl_idx, 'not_https', 'high', CAST('' AS VARCHAR) FROM ok WHERE page NOT LIKE 'https:%'
  UNION ALL SELECT site, page, page_id, crawl_idx, 'redirect_chain', 'medium', CAST(len(redirect_chain) AS VARCHAR) FROM ok WHERE len(redirect_chain) >= 3
  UNION ALL SELECT site, page, page_id, crawl_idx, 'missing_title', 'high', CAST('' AS VARCHAR) FROM ok WHERE NOT regexp_matches(html, '(?i)<title')
  UNION ALL SELECT site, page, page_id, crawl_idx, 'empty_title', 'high', CAST('' AS VARCHAR) FROM ok WHERE regexp_matches(html, '(?i)<title') AND title = ''
  UNION ALL SELECT site, page, page_id, crawl_idx, 'title_too_short', 'medium', CAST(title AS VARCHAR) FROM ok WHERE length(title) BETWEEN 1 AND 14
  UNION ALL SELECT site, page, page_id, crawl_idx, 'title_too_long', 'low', CAST(title AS VARCHAR) FROM ok WHERE length(title) > 65
  UNION ALL SELECT site, page, page_id, crawl_idx, 'missing_meta_description', 'medium', CAST('' AS VARCHAR) FROM ok WHERE NOT regexp_matches(html, '(?i)<meta[^>]*"description"')
  UNION ALL SELECT site, page, page_id, crawl_idx, 'noindex_directive', 'high', CAST(lower(coalesce(headers['x-robots-tag'], '')) AS VARCHAR) FROM ok WHERE contains(lower(coalesce(headers['x-robots-tag'], '')), 'noindex')
  UNION ALL SELECT site, page, page_id, crawl_idx, 'missing_viewport', 'high', CAST('' AS VARCHAR) FROM ok WHERE NOT regexp_matches(html, '(?i)<meta name="viewport"')
  UNION ALL SELECT site, page, page_id, crawl_idx, 'missing_html_lang', 'medium', CAST('' AS VARCHAR) FROM ok WHERE NOT regexp_matches(html, '(?i)<html[^>]* lang="[^"]+"')
  UNION ALL SELECT site, page, page_id, crawl_idx, 'missing_charset', 'low', CAST('' AS VARCHAR) FROM ok WHERE NOT regexp_matches(html, '(?i)<meta charset="[^"]+"')
  UNION ALL SELECT site, page, page_id, crawl_idx, 'missing_canonical', 'medium', CAST('' AS VARCHAR) FROM ok WHERE NOT regexp_matches(html, '(?i)<link[^>]*canonical')
  UNION ALL SELECT site, page, page_id, crawl_idx, 'missing_h1', 'high', CAST('' AS VARCHAR) FROM ok WHERE len(h1) = 0
  UNION ALL SELECT site, page, page_id, crawl_idx, 'multiple_h1', 'medium', CAST(len(h1) || array_to_string(h1[:6], ' / ') AS VARCHAR) FROM ok WHERE len(h1) > 1
  UNION ALL SELECT site, page, page_id, crawl_idx, 'thin_content', 'medium', CAST(left(n_words || ' words: ' || left(trim(regexp_replace(text, '{_W}+', ' ', 'g')), 180), 180) AS VARCHAR) FROM ok WHERE n_words < 150 AND status = 200
  UNION ALL SELECT site, page, page_id, crawl_idx, 'images_missing_alt', 'medium', CAST('' AS VARCHAR) FROM ok WHERE regexp_matches(html, '(?i)<img')
  UNION ALL SELECT site, page, page_id, crawl_idx, 'missing_open_graph', 'low', CAST('' AS VARCHAR) FROM ok WHERE NOT regexp_matches(html, '(?i)og:title')
  UNION ALL SELECT site, page, page_id, crawl_idx, 'missing_json_ld', 'medium', CAST('' AS VARCHAR) FROM ok WHERE NOT regexp_matches(html, '(?i)ld\\+json')
  UNION ALL SELECT site, page, page_id, crawl_idx, 'generic_anchor_text', 'low', CAST(array_to_string(list_filter(regexp_extract_all(html, '(?s)<a href="[^"]*">(.*?)</a>', 1), lambda x: lower(trim(x)) IN {_words(lx.GENERIC_ANCHORS)}), ', ') AS VARCHAR) FROM ok WHERE len(list_filter(regexp_extract_all(html, '(?s)<a href="[^"]*">(.*?)</a>', 1), lambda x: lower(trim(x)) IN {_words(lx.GENERIC_ANCHORS)})) > 0
  UNION ALL SELECT site, page, page_id, crawl_idx, 'no_internal_links', 'medium', CAST('' AS VARCHAR) FROM ok WHERE n_internal = 0 AND status = 200
  UNION ALL SELECT site, page, page_id, crawl_idx, 'soft_404', 'high', CAST(title AS VARCHAR) FROM ok WHERE status = 200 AND (contains(lower(title), '404') OR contains(lower(title), 'not found')))"""
_DUPLICATES = """
texts AS (
  SELECT site, page, crawl_idx, page_id, 'duplicate_title' AS metric, 'high' AS severity, lower(trim(title)) AS t FROM ok
  UNION ALL SELECT site, page, crawl_idx, page_id, 'duplicate_h1', 'low', lower(trim(unnest(h1))) FROM ok),
per_page AS (SELECT site, metric, severity, t, page, min((crawl_idx, page_id)) AS f FROM texts WHERE t <> '' GROUP BY site, metric, severity, t, page),
dups AS (
  SELECT site, metric, severity, arg_min(page, f) AS page, count(*) || ' addresses share: ' || t || ' (' || array_to_string(list(page ORDER BY f, page)[1:6], ', ') || ')' AS evidence
  FROM per_page GROUP BY site, metric, severity, t HAVING count(*) > 1)"""
_SCHEMA = f"""
typed AS (
  SELECT site, page_id, lower(regexp_extract(regexp_extract(html, '(?s)<script type="application/ld\\+json">(.*?)</script>', 1), '"@type":"([^"]*)"', 1)) AS t FROM ok),
kinds AS (
  SELECT site, count(*) AS n_pages, bool_or(t IN {_words((*lx.LOCAL_TYPES, 'organization'))}) AS has_local, bool_or(t IN {_words(lx.ANSWER_TYPES)}) AS has_answer FROM typed GROUP BY site)"""
_SITE_RULES = """
home AS (
  SELECT s.site, count(*) AS n FROM sites s JOIN ok ON ok.site = s.site AND regexp_replace(ok.page, '/+$', '') = regexp_replace(s.start_url, '/+$', '') GROUP BY s.site),
site_rules AS (
  SELECT site, coalesce(nullif(robots_url, ''), start_url) AS page, 'missing_robots_txt' AS metric, 'medium' AS severity FROM sites WHERE robots_status >= 400
  UNION ALL SELECT site, start_url, 'missing_xml_sitemap', 'medium' FROM sites WHERE coalesce(len(sitemap_urls), 0) = 0
  UNION ALL SELECT s.site, start_url, 'missing_localbusiness_schema', 'medium' FROM sites s JOIN kinds k USING (site) WHERE NOT has_local
  UNION ALL SELECT s.site, start_url, 'missing_aeo_schema', 'low' FROM sites s JOIN kinds k USING (site) WHERE NOT has_answer
  UNION ALL SELECT s.site, start_url, 'missing_favicon', 'low' FROM sites s JOIN home USING (site))"""
_PHONE = lx.PHONE.replace("\\s", _W).replace("\\d", "\\p{Nd}").replace("[" + _W + ".\\-]", "[\\s\\x{1C}-\\x{1F}\\x{85}\\p{Z}.\\-]")


_EDGE = "(?:^|[^\\p{L}\\p{Nd}_])"
_CITY_STATE, _CITY = _EDGE + lx.CITY_STATE_ZIP[2:], _EDGE + lx.CITY_ZIP[2:]


def _norm_phone(raw: str) -> str:
    digits = f"regexp_replace({raw}, '\\P{{Nd}}', '', 'g')"
    return f"CASE WHEN length({digits}) = 11 AND {digits} LIKE '1%' THEN substr({digits}, 2) ELSE {digits} END"


def _norm_name(raw: str) -> str:
    plain = f"trim(regexp_replace(regexp_replace(regexp_replace(lower({raw}), '[®™©]', '', 'g'), '[^a-z0-9\\s\\x{{1C}}-\\x{{1F}}\\x{{85}}\\p{{Z}}]', ' ', 'g'), '{_W}+', ' ', 'g'))"
    return f"regexp_replace(trim(regexp_replace({plain}, '\\b(?:{'|'.join(lx.LEGAL_SUFFIXES)})\\.?$', '')), '^the ', '')"


def _norm_address(raw: str) -> str:
    short = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in lx.ADDRESS_WORDS.items()) + "}"
    words = f"list_filter(regexp_split_to_array(regexp_replace(replace(lower({raw}), '.', ''), '[,#]', ' ', 'g'), '{_W}+'), lambda w: w <> '')"
    return f"array_to_string(list_transform({words}, lambda w: coalesce({short}[w], w)), ' ')"


def _norm_value(field: str, raw: str) -> str:
    phone = _norm_phone(raw)
    return f"nullif(CASE WHEN {field} = 'phone' THEN CASE WHEN length({phone}) >= 7 THEN {phone} END WHEN {field} = 'business_name' THEN {_norm_name(raw)} ELSE {_norm_address(raw)} END, '')"


def _confidence(p: str, n: str, sources: str, only: str) -> str:
    has = lambda s: f"list_contains({sources}, '{s}')"
    source = f"CASE WHEN {has('json_ld')} THEN 0.18::DOUBLE WHEN {has('microdata')} OR {has('tel_link')} THEN 0.10::DOUBLE WHEN {has('llm')} THEN 0.04::DOUBLE ELSE 0::DOUBLE END"
    agreement = f"CASE WHEN {n} <= 1 THEN 0.15::DOUBLE ELSE -least(0.35::DOUBLE, 0.12::DOUBLE * ({n} - 1)) END"
    whole = f"round(greatest(0.12::DOUBLE, least(0.97::DOUBLE, 0.35::DOUBLE + 0.08::DOUBLE * least({p}, 6) + {source} + {agreement} + CASE WHEN {only} THEN 0.08::DOUBLE ELSE 0::DOUBLE END)), 2)"
    return f"CASE WHEN {p} = 0 THEN 0.12::DOUBLE WHEN {p} = 1 THEN least(0.55::DOUBLE, {whole}) ELSE {whole} END"


def _verdict(p: str, n: str, v: str) -> str:
    return f"CASE WHEN {p} <= 1 THEN 'insufficient_evidence' WHEN {n} <= 1 AND {v} <= 1 THEN 'consistent' WHEN {n} <= 1 THEN 'consistent_formatting_only' WHEN {n} > 1 THEN 'inconsistent' ELSE 'consistent' END"


_SQUEEZED = f"trim(regexp_replace(text, '{_W}+', ' ', 'g'))"
_TIME = lx.TIME.replace("\\s", _W).replace("\\d", "\\p{Nd}")
_HOURS, _PLACES, _STOP = _words(lx.HOUR_TERMS), _words(lx.PLACE_TERMS), _words(lx.STOPWORDS)
_CHROME = f"""(len(words) = 0 OR regexp_matches(text, '(?i){lx.CHROME_PHRASES}')
  OR (len(words) >= 6 AND len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}') AND lower(w) NOT IN ('am', 'pm'))) / len(words) >= 0.7 AND NOT regexp_matches(text, '\\p{{Nd}}'))
  OR (len(string_split(text, ' & ')) >= 3 AND NOT regexp_matches(text, '\\p{{Nd}}')))"""


def _bm25(texts: str, asked: str, k: int) -> str:
    """BM25 with boosts over ``texts`` (site, passage_id, text) for ``asked`` (site, qid, query)."""
    return f"""
texts AS ({texts}),
asked AS ({asked}),
tokens AS (SELECT site, qid, regexp_extract_all(lower(query), '[a-z0-9]+') AS all_t FROM asked),
kept AS (SELECT site, qid, all_t, list_filter(all_t, lambda t: t NOT IN {_STOP} AND length(t) > 1) AS good FROM tokens),
terms AS (SELECT site, qid, CASE WHEN len(good) > 0 THEN good ELSE all_t END AS t FROM kept WHERE len(all_t) > 0),
traits AS (SELECT site, qid, t, len(list_distinct(t)) AS n_terms, len(list_filter(t, lambda x: x IN {_HOURS})) > 0 AS hour, len(list_filter(t, lambda x: x IN {_PLACES})) > 0 AS place FROM terms),
asked_terms AS (SELECT site, qid, term, count(*) AS times FROM (SELECT site, qid, unnest(t) AS term FROM terms) GROUP BY ALL),
sized AS (
  SELECT site, passage_id, text, regexp_extract_all(lower(text), '[a-z0-9]+') AS toks, length(text) AS chars,
         regexp_matches(text, '(?i){_TIME}') AS timed, regexp_matches(text, '\\b\\p{{Nd}}{{1,6}}{_W}+[A-Za-z]') AS placed FROM texts),
whole AS (SELECT site, count(*)::DOUBLE AS n, sum(len(toks))::DOUBLE / count(*) AS avgdl FROM sized GROUP BY site),
tf AS (SELECT site, passage_id, term, count(*) AS tf FROM (SELECT site, passage_id, unnest(toks) AS term FROM sized) GROUP BY ALL),
df AS (SELECT site, term, count(*)::DOUBLE AS df FROM tf GROUP BY ALL),
scores AS (
  SELECT a.site, a.qid, tf.passage_id, sum(times) AS hits,
         sum(times * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1::DOUBLE) * (tf * 2.5::DOUBLE) / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * greatest(len(toks), 1) / avgdl))) AS s
  FROM asked_terms a JOIN tf ON tf.site = a.site AND tf.term = a.term JOIN df ON df.site = tf.site AND df.term = tf.term
  JOIN whole w ON w.site = tf.site JOIN sized z ON z.site = tf.site AND z.passage_id = tf.passage_id GROUP BY ALL),
ranked AS (
  SELECT t.qid, z.passage_id,
         round(coalesce(s, 0) + CASE WHEN hour AND timed THEN 4.0::DOUBLE ELSE 0 END + CASE WHEN place AND placed THEN 2.5::DOUBLE ELSE 0 END, 9) AS score,
         coalesce(hits, 0)::DOUBLE / n_terms AS coverage, chars
  FROM traits t JOIN sized z USING (site) LEFT JOIN scores USING (site, qid, passage_id) WHERE NOT hour OR timed),
lexical AS (
  SELECT qid, passage_id, score, coverage, row_number() OVER (PARTITION BY qid ORDER BY score DESC, coverage DESC, chars DESC, passage_id) AS rank
  FROM ranked QUALIFY rank <= {k})"""


_COSINES = """
cosines AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS cosine,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 9) DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0 QUALIFY rank <= 8)"""

_EVERY = """
every AS (
  SELECT DISTINCT site, page, metric, severity, sig FROM rules
  UNION ALL SELECT site, page, metric, severity, evidence FROM dups
  UNION ALL SELECT DISTINCT site, page, metric, severity, '' FROM site_rules)"""
_HINTED = _PAGES.strip().replace(" html, coalesce(null", """ html || '<a href="/visit-us">v</a>' AS html, coalesce(null""")

SQL: dict[str, str] = {
    "url_normalized": f"SELECT page_id, {_norm_url('url')} AS norm_url, {_host('url')} AS host, regexp_matches(url, '^(?i:https?)://[^/?#]+') AS is_http FROM crawl_archive",
    "site_pages": f"SELECT {_host('final_url')} AS host, count(*) AS n_pages, count(DISTINCT {_norm_url('final_url')}) AS n_urls FROM crawl_archive GROUP BY 1",
    "page_admission": f"SELECT page_id, {_ADMISSION} AS admission FROM crawl_archive",
    "link_edges": f"WITH {_PAGES.strip()}, {_LINKS.strip()} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS link_idx, target FROM firsts",
    "local_hint_links": f"WITH {_HINTED}, {_LINKS.strip()} SELECT page_id, target FROM firsts WHERE regexp_matches(lower(regexp_extract(target, '^[^:]+://[^/]*([^?#]*)', 1)), '{'|'.join(lx.LOCAL_HINTS)}')",
    "internal_links": f"WITH {_PAGES.strip()}, {_LINKS.strip()}, n AS (SELECT page_id, count(*) AS n FROM links WHERE {_host('target')} = {_host('page')} GROUP BY 1) SELECT page_id, coalesce(n, 0) AS n_internal FROM pages LEFT JOIN n USING (page_id) WHERE html <> ''",
    "page_text": f"WITH {_PAGES.strip()}, {_VISIBLE.strip()} SELECT page_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9'']+')) AS BIGINT) AS n_words, md5(regexp_replace(text, '{_W}+', '', 'g')) AS text_md5 FROM shown",
    "page_head": f"WITH {_PAGES.strip()} SELECT page_id, {_TITLE} AS title, nullif(regexp_extract(html, '(?i)<html[^>]* lang=\"([^\"]*)\"', 1), '') AS lang, nullif(regexp_extract(html, '(?i)<meta charset=\"([^\"]*)\"', 1), '') AS charset FROM pages WHERE html <> ''",
    "headings": f"WITH {_PAGES.strip()}, h AS (SELECT page_id, unnest({_H1}) AS t, generate_subscripts({_H1}, 1) AS i FROM pages WHERE html <> '') SELECT page_id, CAST(i - 1 AS BIGINT) AS idx, CAST(1 AS BIGINT) AS level, substr(trim({_numbered(_decoded('t'))}), 1, 200) AS text FROM h",
    "schema_types": f"WITH {_PAGES.strip()} SELECT page_id, CAST(len(regexp_extract_all(html, 'application/ld\\+json')) AS BIGINT) AS n_json_ld, lower(regexp_extract(html, '\"@type\":\"([^\"]*)\"', 1)) AS types FROM pages WHERE html <> ''",
    "audit_page_rules": f"WITH {_AUDITED.strip()}, {_RULES.strip()} SELECT page_id, metric, severity FROM rules",
    "audit_duplicates": f"WITH {_AUDITED.strip()}, {_DUPLICATES.strip()} SELECT site, metric, page, evidence FROM dups",
    "audit_site_rules": f"WITH {_AUDITED.strip()}, {_SCHEMA.strip()}, {_SITE_RULES.strip()} SELECT site, page, metric, severity FROM site_rules",
    "audit_site_schema": f"WITH {_AUDITED.strip()}, {_SCHEMA.strip()} SELECT site, n_pages, has_local, has_answer FROM kinds",
    "audit_finding_keys": f"WITH {_AUDITED.strip()}, {_RULES.strip()}, {_DUPLICATES.strip()}, {_SCHEMA.strip()}, {_SITE_RULES.strip()}, {_EVERY.strip()} SELECT site, page, metric, severity FROM every",
    "audit_summary": f"WITH {_AUDITED.strip()}, {_RULES.strip()}, {_DUPLICATES.strip()}, {_SCHEMA.strip()}, {_SITE_RULES.strip()}, {_EVERY.strip()} SELECT metric, severity, count(*) AS n FROM every GROUP BY metric, severity",
    "robots_hints": """
WITH l AS (SELECT site, list_filter(string_split(replace(coalesce(robots_body, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: starts_with(lower(x), 'sitemap:')) AS h FROM sites)
SELECT site, CAST(i - 1 AS BIGINT) AS idx, trim(substr(hint, 9)) AS hint FROM (SELECT site, unnest(h) AS hint, generate_subscripts(h, 1) AS i FROM l)""",
    "audit_rule_cases": """
SELECT CAST(page_id AS BIGINT) AS page_id, metric, severity FROM (VALUES
  (1, 'title_too_short', 'medium'), (1, 'meta_description_too_short', 'low'), (1, 'missing_viewport', 'high'), (1, 'missing_html_lang', 'medium'), (1, 'missing_charset', 'low'), (1, 'missing_canonical', 'medium'),
  (1, 'heading_hierarchy_skip', 'low'), (1, 'thin_content', 'medium'), (1, 'images_missing_alt', 'medium'), (1, 'missing_open_graph', 'low'), (1, 'missing_json_ld', 'medium'), (1, 'generic_anchor_text', 'low'),
  (2, 'not_https', 'high'), (2, 'missing_title', 'high'), (2, 'missing_meta_description', 'medium'), (2, 'noindex_directive', 'high'), (2, 'missing_charset', 'low'), (2, 'empty_h1', 'medium'),
  (2, 'multiple_h1', 'medium'), (2, 'thin_content', 'medium'), (2, 'missing_open_graph', 'low'), (2, 'missing_json_ld', 'medium'),
  (3, 'empty_title', 'high'), (3, 'missing_meta_description', 'medium'), (3, 'missing_viewport', 'high'), (3, 'missing_charset', 'low'), (3, 'missing_canonical', 'medium'), (3, 'thin_content', 'medium'),
  (3, 'missing_open_graph', 'low'), (3, 'no_internal_links', 'medium')) AS t(page_id, metric, severity)""",
    "citation_links": f"""
WITH {_PAGES.strip()}, {_LINKS.strip()},
every AS (
  SELECT p.site, f.target, (coalesce(p.crawl_idx, 2147483647), p.page_id, f.i) AS o FROM firsts f JOIN pages p USING (page_id) WHERE NOT from_citation
  UNION ALL SELECT 'a.com', 'https://www.yelp.com/biz/a', (1, 1, 2) UNION ALL SELECT 'a.com', 'https://maps.google.com/x', (2, 2, 2)),
found AS (SELECT site, target, min(o) AS o FROM every WHERE regexp_matches(lower(target), '{'|'.join(h.replace('.', chr(92) + '.') for h in lx.CITATION_HOSTS)}') GROUP BY site, target)
SELECT site, row_number() OVER (PARTITION BY site ORDER BY o) - 1 AS idx, target FROM found QUALIFY idx < 8""",
    "sitemap_closure": """
SELECT site, CAST(idx AS BIGINT) AS idx, target FROM (VALUES ('a.com', 0, 'https://a.com/x'), ('a.com', 1, 'https://www.a.com/z'), ('a.com', 2, 'https://a.com/w'), ('c.com', 0, 'https://c.com/bare')) AS t(site, idx, target)""",
    "link_reachability": f"""
WITH RECURSIVE {_PAGES.strip()}, {_LINKS.strip()},
edges AS (SELECT DISTINCT p.site, {_norm_url('p.page')} AS source, f.target FROM firsts f JOIN pages p USING (page_id) WHERE {_host('f.target')} = p.site),
walk AS (SELECT site, {_norm_url('start_url')} AS node FROM sites WHERE start_url IS NOT NULL UNION SELECT w.site, e.target FROM walk w JOIN edges e ON e.site = w.site AND e.source = w.node)
SELECT DISTINCT site, node FROM walk""",
    "phones": f"SELECT passage_id, trim(raw) AS raw, {_norm_phone('raw')} AS norm FROM (SELECT passage_id, unnest(regexp_extract_all(text, '{_PHONE}')) AS raw FROM passages)",
    "nap_normalized": f"SELECT value_id, field, {_norm_value('field', 'v')} AS norm FROM (SELECT field, unnest(\"values\") AS v, unnest(value_ids) AS value_id FROM nap_report)",
    "name_norm": f"SELECT raw, {_norm_name('raw')} AS norm FROM (SELECT c_name AS raw FROM customer UNION SELECT s_name || ', Inc.' FROM supplier)",
    "nap_judged": f"""
WITH r AS (SELECT report_id, coalesce(len(pages_compared), 0) AS p, coalesce(len("values"), 0) AS v, coalesce(len(normalized_values), 0) AS n, coalesce(sources, []) AS s FROM nap_report),
j AS (SELECT *, {_verdict('p', 'n', 'v')} AS verdict FROM r)
SELECT report_id, verdict, {_confidence('p', 'n', 's', "verdict = 'consistent_formatting_only'")} AS confidence FROM j""",
    "nap_phone_report": f"""
WITH f AS (SELECT site, url, trim(unnest(regexp_extract_all(text, '{_PHONE}'))) AS v FROM passages WHERE url IS NOT NULL),
every AS (SELECT DISTINCT site FROM f),
g AS (SELECT site, count(DISTINCT url) AS n_pages, count(DISTINCT v) AS n_values, count(DISTINCT {_norm_value("'phone'", 'v')}) AS n_norm FROM f GROUP BY site),
j AS (SELECT *, {_verdict('n_pages', 'n_norm', 'n_values')} AS verdict FROM g)
SELECT site, n_pages, n_values, n_norm, verdict, {_confidence('n_pages', 'n_norm', "['regex']", "verdict = 'consistent_formatting_only'")} AS confidence FROM j""",
    "nap_places": f"""
WITH e AS (SELECT unnest("values") AS v, unnest(value_ids) AS value_id FROM nap_report WHERE field = 'full_address'),
s AS (SELECT value_id, 'street_address' AS field, trim(regexp_replace(unnest(regexp_extract_all(v, '(?i){lx.STREET.replace("'", "''").replace(chr(92) + "s", chr(92) + "s")}')), '{_W}+', ' ', 'g')) AS value FROM e),
z AS (SELECT value_id, unnest(regexp_extract_all(v, '{_CITY_STATE}', 1)) AS c, unnest(regexp_extract_all(v, '{_CITY_STATE}', 2)) AS r, unnest(regexp_extract_all(v, '{_CITY_STATE}', 3)) AS p FROM e),
y AS (SELECT value_id, unnest(regexp_extract_all(v, '{_CITY}', 1)) AS c, unnest(regexp_extract_all(v, '{_CITY}', 2)) AS p FROM e)
SELECT * FROM s UNION ALL SELECT value_id, 'city', c FROM z UNION ALL SELECT value_id, 'region', r FROM z UNION ALL SELECT value_id, 'postal_code', p FROM z
UNION ALL SELECT value_id, 'city', c FROM y UNION ALL SELECT value_id, 'postal_code', p FROM y""",
    "chrome_flags": f"WITH w AS (SELECT passage_id, text, list_filter(string_split({_SQUEEZED}, ' '), lambda x: x <> '') AS words FROM passages WHERE text IS NOT NULL) SELECT passage_id, {_CHROME} AS is_chrome FROM w",
    "passage_chunks": f"""
WITH RECURSIVE paras AS (
  SELECT passage_id, row_number() OVER (PARTITION BY passage_id ORDER BY k) AS j, p FROM (
    SELECT passage_id, k, trim(regexp_replace(q, '{_W}+', ' ', 'g')) AS p FROM (
      SELECT passage_id, unnest(regexp_split_to_array(text, '\\n{_W}*\\n')) AS q, generate_subscripts(regexp_split_to_array(text, '\\n{_W}*\\n'), 1) AS k FROM passages WHERE text IS NOT NULL)) WHERE p <> ''),
wrapped AS (
  SELECT passage_id, j, string_split(p, ' ') AS w, 1 AS i, '' AS line, CAST(NULL AS VARCHAR) AS done, 0 AS c FROM paras WHERE length(p) > 420
  UNION ALL
  SELECT passage_id, j, w, i + 1,
         CASE WHEN line = '' THEN w[i] WHEN length(line) + 1 + length(w[i]) <= 420 THEN line || ' ' || w[i] ELSE w[i] END,
         CASE WHEN line = '' OR length(line) + 1 + length(w[i]) <= 420 THEN NULL ELSE line END, c + CASE WHEN line = '' OR length(line) + 1 + length(w[i]) <= 420 THEN 0 ELSE 1 END
  FROM wrapped WHERE i <= len(w)),
pieces AS (
  SELECT passage_id, j, 0 AS c, p AS chunk FROM paras WHERE length(p) <= 420
  UNION ALL SELECT passage_id, j, c, done FROM wrapped WHERE done IS NOT NULL
  UNION ALL SELECT passage_id, j, c + 1, line FROM wrapped WHERE i = len(w) + 1)
SELECT passage_id, count(*) AS n, md5(string_agg(chunk, '|' ORDER BY j, c)) AS chunks_md5 FROM pieces GROUP BY passage_id""",
    "term_df": """
WITH n AS (SELECT count(*)::DOUBLE AS n FROM documents),
t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM documents)
SELECT term, count(*) AS df, round(ln(((SELECT n FROM n) - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE) + 1::DOUBLE), 6) AS idf FROM t GROUP BY term""",
    "bm25_topk": f"""
WITH {_bm25("SELECT site, passage_id, coalesce(text, '') AS text FROM passages", "SELECT DISTINCT site, query, site || '|' || query AS qid FROM answer WHERE query IS NOT NULL AND site IS NOT NULL", 12).strip()}
SELECT qid, passage_id, round(score, 5) AS score, round(coverage, 6) AS coverage, rank FROM lexical""",
    "search_top": f"""
WITH {_bm25("SELECT site, passage_id, coalesce(text, '') AS text FROM passages", "SELECT DISTINCT site, query, site || '|' || query AS qid FROM answer WHERE query IS NOT NULL AND site IS NOT NULL", 4).strip()}
SELECT qid, passage_id, rank, url FROM lexical JOIN passages USING (passage_id)""",
    "indexed_urls": "SELECT site, row_number() OVER (PARTITION BY site ORDER BY url) AS n, url FROM (SELECT DISTINCT site, url FROM passages WHERE url IS NOT NULL) QUALIFY n <= 40",
    "vector_topk": f"WITH {_COSINES.strip()} SELECT query_id, vec_id, round(cosine, 4) AS cosine, rank FROM cosines",
    "rank_fusion": f"""
WITH {_bm25("SELECT 'all' AS site, doc_id AS passage_id, coalesce(text, '') AS text FROM documents", "SELECT 'all' AS site, CAST(doc_id AS VARCHAR) AS qid, path AS query FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 50 = 0 AND path IS NOT NULL", 12).strip()},
{_COSINES.strip()},
both_ AS (
  SELECT qid, passage_id AS id, rank, false AS vector FROM lexical
  UNION ALL SELECT CAST(query_id AS VARCHAR), vec_id, rank, true FROM cosines),
merged AS (SELECT qid, id, sum(1::DOUBLE / (60 + rank)) AS fusion, min((vector, rank)) AS f, max(vector) AS vector FROM both_ GROUP BY qid, id)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY fusion DESC, f) AS rank, round(fusion, 9) AS fusion, vector FROM merged QUALIFY rank <= 8""",
    "abstain_cases": """
SELECT CAST(case_id AS BIGINT) AS case_id, abstains FROM (VALUES (1, true), (2, true), (3, false), (4, true), (5, false), (6, true), (7, false), (8, true), (9, false), (10, true)) AS t(case_id, abstains)""",
    "answers_verbatim": f"""
WITH {_PAGES.strip()}, {_VISIBLE.strip()}
SELECT answer_id, bool_or(coalesce(contains(trim(regexp_replace(s.text, '{_W}+', ' ', 'g')), nullif(trim(regexp_replace(excerpt, '{_W}+', ' ', 'g')), '')), false)) AS verbatim
FROM answer a LEFT JOIN shown s ON s.page = a.url WHERE a.url IS NOT NULL GROUP BY answer_id""",
}
