"""Damaged pages, near-miss licences, long texts and odd ids."""

import html.parser
import time

from pyspark.sql import functions as F

from chronogaz.llm import html_extraction, language_id, license_scan

DOCS = "doc_id long, text string"


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"http://h{i}.org/x", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_extraction.extract(df).orderBy("page_id").collect()]


def test_damaged_pages_keep_their_article(spark):
    cases = [
        ("<html><head><title>T</title><body><article><p>Hello world", "Hello world"),
        ("<head><title>T<body><article><p>Hello</article>", "Hello"),
        ('<article style="overflow:hidden"><p>kept</p></article>', "kept"),
        ('<article title="a hidden treasure" data-hidden="false" data-id="comments" data-x=\'class="ad"\'><p>kept</p></article>', "kept"),
        ('<article><p title="abc>one</p><p class="x">two</p></article>', "one\ntwo"),
        ("<article><p>see <a title=don't>this</a> and <b data-x = 'a>b' >that</b></p></article>", "see this and that"),
        ('<article><p data-tip="<b>x</b>">tip</p><p>next</p></article>', "tip\nnext"),
        ("<article><p>a <button>press<p>b<select><option>1<option>2</select> c</article>", "a\nb c"),
        ("<article><p>a<svg><title>s</title><text>drawn</text></svg>b</p><video><p>no video</p></video><p>c</p></article>", "ab\nc"),
        ("<article><p>a<script>var x = '<p>';</script>b &amp; c<!-- no --><![CDATA[no]]></p></article>", "ab & c"),
        ("<article><p hidden>no</p><p HIDDEN=''>no</p><p class='not hidden'>yes</p><p aria-hidden=true>no</p></article>", "yes"),
        ("<article>1 < 2 and a<b>c</b> <p>4 > 3</article>", "1 < 2 and ac\n4 > 3"),
        ("<article><p>last <a hre", "last"),
    ]
    got = extracted(spark, [p for p, _ in cases])
    assert list(zip(got, [p for p, _ in cases])) == [(want, p) for p, want in cases]


class Article(html.parser.HTMLParser):
    """Words inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"

    def handle_endtag(self, tag):
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth > 0:
            self.words += data.split()


def test_words_of_articles_equal_another_parser(spark, sf):
    """Over the given pages, whole and minified: every word extracted from an article stands in it, in order."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").collect()]
    small = [p.replace("</p>", "").replace("</li>", "").replace("</head>", "").replace("\n", " ") for p in pages]
    whole, minified = extracted(spark, pages), extracted(spark, small)
    assert whole == minified and all(whole)
    for page, text in zip(pages, whole):
        own = Article()
        own.feed(page)
        rest = iter(own.words)
        assert all(any(w == x for x in rest) for w in text.split())


def test_many_open_elements_take_linear_time():
    one = lambda n: "<article>" + "<b>" * n + "x</i>" * n + "</article>"
    began = time.time()
    assert html_extraction.blocks(one(40_000))[0][0].count("x") == 40_000
    assert time.time() - began < 10


def test_pages_without_an_id_are_pages_of_their_own(spark):
    shared = " ".join(f"word{i}" for i in range(20))
    page = f"<p>{shared}</p><p>own {{}} text of this page alone</p>"
    rows = [(None if i < 4 else i, "http://a/x", page.format(i)) for i in range(8)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 8 and all(shared not in r.text and r.text.startswith("own") for r in got)


def test_near_misses_are_not_licences(spark):
    rows = ["it was released under the new license law", "Released under the BSD License", "Licensed under CC BY 4.0", "GNU General Public License, version 2", "Attribution ShareAlike 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "This work is licensed under the GNU General Public License, version 3", "Released under the MIT License", "Licensed under CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0"]
    df = spark.createDataFrame(list(enumerate(rows)), DOCS)
    got = {r.doc_id: r["labels"] for r in license_scan.license_scan(df).collect()}
    assert [got[i] for i in range(6)] == ["", "", "cc-by", "gpl", "", ""]
    assert [got[i] for i in range(6, 10)] == ["gpl,gpl-3.0", "mit,mit-line", "cc-by,cc-by-nc-4.0", "apache,apache-2.0"]
    assert not set(license_scan.TEMPLATES) & set(license_scan.PHRASES.values())


def test_many_places_in_one_text_take_linear_time(spark):
    n = 800_000
    began = time.time()
    r = license_scan.license_scan(spark.createDataFrame([(1, "cc by " * n)], DOCS)).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word) == (2 * n, n, 0, 2 * n - 2) and time.time() - began < 60


def test_languages_of_rows_with_equal_or_no_ids(spark):
    texts = [("en", "the cat and the hat of the house {}"), ("de", "der Hund und die Katze im Haus {}"), ("fr", "le chat et le chien de la maison {}")]
    rows = lambda key: [(key(i), t.format(i), lang) for i in range(60) for lang, t in texts]
    ask = spark.createDataFrame([(i, t.format("x"), True) for i, (_, t) in enumerate(texts)], DOCS + ", held_out boolean")
    for key in (lambda i: None, lambda i: 7, lambda i: i):
        df = spark.createDataFrame(rows(key), DOCS + ", lang string")
        model = language_id.fit(df)
        assert [r.lang_pred for r in language_id.predict(ask, model).orderBy("doc_id").collect()] == ["en", "de", "fr"]
        assert language_id.training_sample(df.unionByName(df).repartition(5), 10).groupBy("lang").count().where("count = 10").count() == 3
    again = [[(r.lang, bytes(r.bits)) for r in language_id.training_sample(spark.createDataFrame(rows(lambda i: None), DOCS + ", lang string").repartition(p), 10).collect()] for p in (1, 7)]
    assert sorted(again[0]) == sorted(again[1])
    assert language_id.training_sample(spark.createDataFrame([(1, "a b c", "en")] * 500, DOCS + ", lang string").withColumn("x", F.lit(1))).count() == 1
