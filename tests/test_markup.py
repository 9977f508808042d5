"""One test per rule."""
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import markup as Mk

got = None


@pytest.fixture(autouse=True)
def session(spark):
    global got

    def got(c, value, kind):
        return spark.createDataFrame([(value,)], f"x {kind}").select(c(F.col("x"))).first()[0]


def extract_paragraphs(html):
    from pyspark.sql import SparkSession
    pages = SparkSession.active().createDataFrame([(1, html)], "page_id long, html string")
    return [r["paragraph"] for r in Mk.page_paragraphs(pages).orderBy("para_no").collect()]


def as_sentence(x):
    return got(Mk.as_sentence, x, "string")


def drawings_text(x):
    return got(Mk.drawings_text, x, "array<struct<tag: string, text: string>>")


def sentence_count(x):
    return got(Mk.sentence_count, x, "string")


def join_single_sentences(x):
    return got(Mk.join_single_sentences, x, "array<string>")


LONG = "This sentence is long enough to stand as a node of its own here."
TWO = LONG + " " + LONG


def test_all_text_is_kept():
    html = f"<html><head><title>t</title><style>x</style></head><body>Bare {TWO}<div>{TWO}</div><pre>{TWO}</pre>" \
           f"<article><p>{TWO}</p>tail {TWO}</article><footer>{TWO}</footer><script>var</script></body></html>"
    got = extract_paragraphs(html)
    assert got == ["Bare " + TWO, TWO, TWO, TWO, "tail " + TWO, TWO]


def test_heading_joins_only_a_following_paragraph():
    title = "A heading that is longer than fifty characters, to be sure of that"
    assert extract_paragraphs(f"<h1>{title}</h1><p>{TWO}</p>") == [f"{title} {TWO}"]
    got = extract_paragraphs(f"<p>{TWO}</p><h1>{title}</h1><div>{TWO}</div>")
    assert got == [TWO.strip(".") + ". " + title, TWO]         # a lone sentence joins the one before


def test_short_node_takes_the_next_one_alone():
    # the length that counts is that of the node before, not of what it joined
    assert extract_paragraphs(f"<div>short</div><div>{TWO}</div><div>{TWO}</div>") == [f"short {TWO}", TWO]


def test_list_items_end_as_sentences():
    assert as_sentence(" item; ") == "item. " and as_sentence(" ") == " "
    assert extract_paragraphs(f"<ul><li>one;</li><li>two</li></ul><p>{TWO}</p>") == [f"one. two. {TWO}"]


def test_drawings_are_one_paragraph():
    assert drawings_text([("heading", "Figures"), ("p", "first"), ("p", "second;"), ("div", "x")]) == \
        "Figures first second.  x"
    html = f"<p>{TWO}</p><description-of-drawings><p>fig one;</p><p>fig two</p></description-of-drawings><p>{TWO}</p>"
    assert len(extract_paragraphs(html)) >= 2


def test_sentence_count_follows_the_sentence_rules():
    assert sentence_count(TWO) == 2
    assert sentence_count(LONG + " Short one.") == 1          # a short sentence joins the one before
    assert sentence_count("Short. " + LONG) == 1               # and a short lead the next
    assert sentence_count("") == 0


def test_single_sentences_join():
    two = [TWO]
    assert join_single_sentences([LONG, LONG, TWO]) == [LONG.strip(".") + ". " + LONG, TWO]
    assert join_single_sentences([TWO, LONG, TWO]) == [TWO.strip(".") + ". " + LONG, TWO]
    assert join_single_sentences([LONG, TWO]) == [LONG.strip(".") + ". " + TWO]
    assert join_single_sentences(two) == two and join_single_sentences([]) == []


def test_unclosed_and_empty():
    assert extract_paragraphs(f"<p>{TWO}<p>{TWO}") == [TWO, TWO]
    assert extract_paragraphs(None) == extract_paragraphs("") == []
