"""Inputs derived from the given tables by SQL that reads the same in both engines.

``{pages}`` and ``{events}`` stand for the stored tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from pagemill.options import BOILERPLATE_SELECTORS, CONTENT_SELECTORS

DOCS = "https://docs.example.com/p/"

LINK_GRAPH = f"""
with p as (select page_id i, (select count(*) from {{pages}}) n from {{pages}}),
e as (select i src, 2*i+1 dst, n from p union all
      select i, 2*i+2, n from p union all
      select i, (7*i+3) % n, n from p)
select distinct concat('{DOCS}', src) src_url, concat('{DOCS}', dst) dst_url
from e where dst < n
"""

# The same graph as anchors; every 11th page carries one malformed link.
GRAPH_PAGES = f"""
select page_id, concat('{DOCS}', page_id) url,
 replace(html, '</nav>', concat(
   '<a href="/p/', 2*page_id+1, '">n</a><a href="/p/', 2*page_id+2,
   '">n</a><a href="/p/', (7*page_id+3) % (select count(*) from {{pages}}), '">n</a>',
   case when page_id % 11 = 10 then '<a href="http://[bad/x">b</a>' else '' end,
   '</nav>')) html
from {{pages}}
"""

# Pages with links that leave the site, by host or by subdomain; every 11th has a malformed one.
OUTWARD_PAGES = """
select page_id, url, url as root_url, replace(html, '</nav>', concat(
   '<a href="https://elsewhere.org/x">e</a><a href="http://deep.example.com/y">d</a>',
   case when page_id % 11 = 10 then '<a href="http://[1:2]/x">b</a>' else '' end, '</nav>')) html
from {pages}
"""



def matching_element(selector: str) -> tuple[str, str]:
    """(tag, start tag) of an element that a simple selector matches."""
    attribute = re.fullmatch(r"\[([\w-]+)='(.*)'\]", selector)
    if attribute:
        return "div", f'<div {attribute[1]}="{attribute[2]}">'
    if selector[0] in ".#":
        kind = {".": 'class="q {} r"', "#": 'id="{}"'}[selector[0]].format(selector[1:])
        return "div", f"<div {kind}>"
    return selector, f"<{selector}>"


def by_page(selectors, text) -> str:
    """SQL: a text for each page, from the selector that its number picks."""
    cases = " ".join(f"when {i} then '{text(*matching_element(s))}'" for i, s in enumerate(selectors))
    return f"case page_id % {len(selectors)} {cases} end"


# Every page with one more boilerplate element at the end of its article, each selector in turn.
BOILERPLATE_PAGES = f"""
select page_id, url, {by_page(BOILERPLATE_SELECTORS, lambda tag, start: tag)} tag,
  replace(html, '</article>', concat({by_page(
    BOILERPLATE_SELECTORS, lambda tag, start: start + ('' if tag == 'input' else f'z</{tag}>'))}, '</article>')) html
from {{pages}}
"""

# Every page with its article in an element of another content selector.
CONTENT_PAGES = f"""
select page_id, url, {by_page(CONTENT_SELECTORS, lambda tag, start: tag)} tag,
  replace(replace(html, '<article>', {by_page(CONTENT_SELECTORS, lambda tag, start: start)}),
    '</article>', {by_page(CONTENT_SELECTORS, lambda tag, start: f'</{tag}>')}) html
from {{pages}}
"""

FETCH_ATTEMPTS = """
select url, attempt,
 case page_id % 8 when 2 then 404 when 3 then case when attempt<2 then 500 else 200 end when 4 then 503
   when 5 then case when attempt=0 then null else 200 end when 6 then 403 when 7 then 500 else 200 end status,
 case page_id % 8 when 1 then 'application/pdf' when 7 then 'application/json'
   when 5 then case when attempt=0 then null else 'Text/HTML; charset=utf-8' end else 'text/html' end content_type,
 case when page_id % 8 = 5 and attempt=0 then 'timeout' end error, html
from {pages} cross join (values (0),(1),(2)) a(attempt)
"""

# One final status per URL: the newest event of the URL.
CRAWL_STATUS = f"""
select concat('site', user_id % 7) site, concat('{DOCS}', user_id) url,
 max_by(case event_type when 'view' then 'crawling' when 'error' then 'failed'
   when 'signup' then 'skipped' else 'success' end, event_id) status,
 max_by(cast(floor(value) as int), event_id) links_found,
 max_by(cast(event_id % 4 as int), event_id) depth
from {{events}} group by user_id
"""

STATUS_EVENTS = """
select event_id, concat('site', user_id % 7) site,
 case event_type when 'view' then 'crawling' when 'error' then 'failed'
   when 'signup' then 'skipped' else 'success' end status,
 cast(floor(value) as int) links_found
from {events}
"""

# A tree with seven children per page, in two sites.
TREE_STATUS = f"""
select concat('site', page_id % 2) site, concat('{DOCS}', page_id) url,
 case when page_id < 2 then null
   else concat('{DOCS}', cast(floor((floor(page_id / 2) - 1) / 7) as bigint) * 2 + page_id % 2) end parent_url,
 case when page_id < 2 then 0 when page_id < 16 then 1 when page_id < 114 then 2 when page_id < 800 then 3
   when page_id < 5602 then 4 else 5 end depth,
 case page_id % 8 when 1 then 'failed' when 2 then 'skipped' else 'success' end status,
 case page_id % 3 when 0 then null when 1 then '' else concat('A title that is longer than forty characters ', page_id) end title
from {{pages}}
"""

ROOTS = """
select regexp_extract(url,'^https?://([^/?#]+)',1) site, min_by(url,page_id) root_url
from {pages} group by 1
"""

SUFFIXES = """
select * from (values ('com','plain'),('net','plain'),('org','plain'),('uk','plain'),
 ('co.uk','plain'),('ck','wildcard'),('www.ck','exception')) s(suffix, kind)
"""

# Page URLs bent so that every gate rule has something to say.
GATE_URLS = """
select page_id, v variant, case v
  when 0 then url when 1 then concat(url, '.pdf') when 2 then concat(url, '.PNG')
  when 3 then concat(split_part(url, '?', 1), '?f=a.zip') when 4 then concat(split_part(url, '?', 1), '.pdf?x=1')
  when 5 then replace(replace(url, 'https:', 'ftp:'), 'http:', 'ftp:')
  when 6 then replace(url, 'example', 'other') when 7 then replace(url, '//', '//x.')
  when 8 then concat(split_part(url, '?', 1), '/api/v1/x') else concat(split_part(url, '?', 1), '/API/v2') end url,
  regexp_extract(url,'^https?://([^/?#]+)',1) site
from {pages} cross join (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) a(v)
"""

# References of every shape against the page's own URL.
REFERENCES = """
select page_id, v variant, split_part(split_part(url, '?', 1), '#', 1) base, case v
  when 0 then 'x.html' when 1 then '../up' when 2 then '/a/./b/../c' when 3 then '//o.net/z'
  when 4 then '?p=2' when 5 then 'https://o.net/Q#f' when 6 then '../../../top' else './' end href
from {pages} cross join (values (0),(1),(2),(3),(4),(5),(6),(7)) a(v)
"""

MESSY_DOCUMENTS = """
select doc_id, concat(replace(text,'. ',concat('.  ',repeat(chr(10),4),'# ')),chr(10),' -',chr(10),'[x]( )') md
from {documents}
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derive(spark: SparkSession, folder: str, text: str) -> DataFrame:
    used = [n for n in ("pages", "events", "documents") if "{" + n + "}" in text]
    return spark.sql(text, **{n: table(spark, folder, n) for n in used})
