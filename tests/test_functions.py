import re
from html import unescape
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigraph.functions import authors, html, text
from lexigraph.sources.html_records import links_of

STEMS = "studies study wellbeing wellbe stress stres organization organize relational relate national national traditional tradition hopefulness hopeful seriousness serious effectiveness effective departments department increasingly increas repeatedly repeat bring bring being being sing sing flies fli based bas glass glas series sery housing hous international internate classes class economics economic covid covid".split()


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_stems(spark):
    assert column(spark, STEMS[::2], text.stem) == STEMS[1::2]


def test_terms_filter_before_stemming_and_count_places_after(spark):
    got = column(spark, ["The cats, the CATS and a dog's toys!", "", None, "is of it", "café 2020s"], text.terms)
    assert got == [["cats", "cats", "dog", "toys"], [], [], [], ["caf", "2020"]]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=8))
def test_terms_are_plain_words(spark, texts):
    for terms in column(spark, texts, text.terms):
        assert all(re.fullmatch("[a-z0-9]+", t) for t in terms)


def test_years_and_types(spark):
    assert column(spark, ["x1850 in 1999, 2001", "12020", "", None, "2099."], text.year_in) == [1999, None, None, None, 2099]
    assert column(spark, ["Research output: Article  Open Access now", "Research output: Book 3 Downloads", "Research output: Chapter", "none"], text.publication_type) == ["Article", "Book", "Chapter", None]


def test_urls(spark):
    urls = ["http://h/a/b/?q=1#f", "https://h/a/;x=1", "https://h/a//", "https://h", "https://h/a;b/c"]
    assert column(spark, urls, text.canonical_url) == ["http://h/a/b", "https://h/a", "https://h/a", "https://h", "https://h/a;b/c"]
    base = F.lit("https://h/x/y?z=1#f")
    assert column(spark, ["/r", "c", "//o/p", "http://q/", "?k", "#t", "", "mailto:a@b"], lambda c: text.absolute_url(base, c)) == ["https://h/r", "https://h/x/c", "https://o/p", "http://q/", "https://h/x/y?k", "https://h/x/y?z=1#t", "https://h/x/y?z=1#f", "mailto:a@b"]
    assert column(spark, ["https://h/en/persons/a", "https://h/en/persons/", "https://h/en/persons", "https://h/x"], lambda c: text.path_below(c, "/en/persons/")) == [True, False, False, False]
    assert column(spark, ["https://a.b.org/x", "ftp://b.org/", "https://b.org:8/", "https://c.org/"], lambda c: text.on_domain(c, "b.org")) == [True, False, False, False]


def test_relative_links_as_the_standard_library_resolves_them(spark):
    base = "https://h/x/y/z?q=1#f"
    refs = ["../a", "./a", "../../../a/", "..", ".", "a/../b/./c", "/a/../b", "/..", "a?x=../y", "/a/b/..?k#../z", "g/..", "../..//c", "a..b/.c", "//o/p", "https://q/a/../b"]
    assert column(spark, refs, lambda c: text.absolute_url(F.lit(base), c)) == [urljoin(base, r) for r in refs]
    assert column(spark, ["a", "../b"], lambda c: text.absolute_url(F.lit("https://h"), c)) == ["https://h/a", "https://h/b"]


def test_search_text_repeats_fields(spark):
    row = spark.createDataFrame([("T", [("A B", None, None)], 2001, None, "", "abs", "full")], "title string, authors array<struct<name:string,profile_url:string,affiliation:string>>, publication_year int, source string, publication_type string, abstract string, full_text string")
    stored = row.withColumn("searchable_text", text.searchable_text())
    assert stored.first()["searchable_text"] == "T A B 2001 abs full"
    assert stored.select(text.indexed_text()).first()[0] == "T A B 2001 abs T A B 2001 abs full"


def test_author_keys(spark):
    df = spark.createDataFrame([(" Jane  Doe", None), ("jane doe", ""), ("x", "u")], "n string, p string")
    a, b, c = [r[0] for r in df.select(text.author_key(F.col("n"), F.col("p"))).collect()]
    assert a == b != c


@pytest.mark.parametrize(("a", "b", "same"), [("Adams, J.", "Jane Adams", True), ("Adams", "adams", True), ("Adams", "J Adams", False), ("van der Berg, A.", "Anna van der Berg", True), ("Berg, A.", "van der Berg, A.", True), ("", "x", False), ("Smith, K", "Smith, L", False)])
def test_names_match(spark, a, b, same):
    assert spark.range(1).select(authors.names_match(F.lit(a), F.lit(b))).first()[0] is same


def test_merge_is_greedy_and_keeps_first_key(spark):
    people = [("Adams, J.", None, None), ("Jane Adams", "u1", None), ("Brown, K", "u2", None), ("Other Name", "u2", "Lab")]
    df = spark.createDataFrame([(people,)], "a array<struct<name:string,profile_url:string,affiliation:string>>")
    got = df.select(authors.merged(F.col("a")).alias("m")).first()["m"]
    assert [(g["name"], g["profile_url"], g["affiliation"]) for g in got] == [("Jane Adams", "u1", None), ("Other Name", "u2", "Lab")]
    assert got[0]["author_key"] == spark.range(1).select(text.author_key(F.lit("Adams, J."), F.lit(None))).first()[0]
    assert df.select(authors.merged(F.array().cast("array<struct<name:string,profile_url:string,affiliation:string>>"))).first()[0] == []


def test_authors_of_other_scripts_merge_by_key(spark):
    people = [("李明", None, None), ("李明", None, "Lab"), ("Иван Петров", None, None), ("иван  петров", None, None), ("李明", "u", None)]
    df = spark.createDataFrame([(people,)], "a array<struct<name:string,profile_url:string,affiliation:string>>")
    got = df.select(authors.merged(F.col("a")).alias("m")).first()["m"]
    assert [(g["name"], g["profile_url"], g["affiliation"]) for g in got] == [("李明", None, "Lab"), ("иван  петров", None, None), ("李明", "u", None)]


def test_character_references_as_the_standard_library_reads_them(spark):
    texts = ["caf&eacute; &#8217;&#x27;&#X2013; &ndash;", "&copy 2020 &copyright &notin; &notit; &unknown; & &; &#; &#x;", "&#0;&#128;&#150;&#55296;&#1114112;&#99999999999;", "&amp;lt; &lt;&gt;&quot;&nbsp;x", "a&b=c&d", "", "no reference", "&NotEqualTilde;&Aacute&aacute;"]
    assert column(spark, texts, html.decoded) == [unescape(t) for t in texts]


def test_links_in_every_form(spark):
    page = """<a href="/1">a</a><A class=x HREF='/2'>b</A><a data-href="/no" href=/3 >c</a><!-- <a href="/no">d</a> --><script>'<a href="/no">'</script><a name="n" title="x > y" href = "/4?a&amp;b">e</a><a>f</a><area href="/no"><a\nhref="/5"
    >g</a><abbr href="/no">h</abbr><a href="">i</a>"""
    assert column(spark, [page], html.links) == [["/1", "/2", "/3", "/4?a&b", "/5", ""]]
    assert links_of(page, "https://h/") == [f"https://h{p}" for p in ("/1", "/2", "/3", "/4?a&b", "/5", "/")]


def test_page_expressions(spark):
    page = "<html><head><title>T &amp; t</title><style>x</style></head><body><!-- c --><nav>n</nav><h1 class='a'>H<b>1</b></h1><script>s</script><p>a&lt;b <a href=\"/x?a=1&amp;b=2\">l</a></p><footer>f</footer></body></html>"
    got = column(spark, [page, None, ""], html.visible_text)
    assert got == ["T & t H 1 a<b l", "", ""]
    assert column(spark, [page], lambda c: html.inside(c, "h1")) == ["H 1"]
    assert column(spark, [page, None], html.links) == [["/x?a=1&b=2"], []]
