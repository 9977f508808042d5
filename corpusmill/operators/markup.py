"""Paragraphs from marked-up bodies.

The standard-library HTML parser turns a page into an outline inside ``mapInPandas`` (one page
at a time): its nodes in order, each with its parts and their pieces of text.  All rules are
array expressions on that outline:

* Page frames (``html``, ``body``, ``article``, ...) are looked through; every
  other element in them is one node with all the text inside it, and text that
  stands in a frame itself is a node too.  Scripts, styles and the head are no
  text.
* A list is one node; each of its items ends as a sentence.
* A ``p`` belongs to the heading before it, and any node to the node before it
  when that one's own text is shorter than 50 characters.
* A drawings block is one paragraph; each ``p`` in it ends as a sentence, unless a heading stands before it.
* Of the paragraphs, those of one sentence (X16 and X17) do not stand alone: neighbours among them become one
  paragraph; one without such a neighbour belongs to the paragraph before it, the first one to the next.

Malformed markup is read as the parser reads it; a null or empty page has no
paragraphs.  Text is trimmed of ASCII white space.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.parts import merge_short, sentences
from corpusmill.session import ship_package

# The length under which a node takes the next one in, and the tags.
MIN_NODE = 50
FRAMES = {"html", "body", "article", "main", "section"}
HEADINGS = ["heading", "h1", "h2", "h3", "h4", "h5", "h6"]
DRAWINGS = "description-of-drawings"
SILENT = {"script", "style", "head", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SPACE = " \t\n\r\x0b\x0c"

PIECE = "struct<item: boolean, text: string>"
OUTLINE = f"array<struct<tag: string, parts: array<struct<tag: string, pieces: array<{PIECE}>>>>>"


class _Outline(HTMLParser):
    """``nodes``: [{"tag", "parts": [{"tag", "pieces": [{"item", "text"}]}]}].  A drawings block has a part for each
    of its children and for text between them (without tag), any other node has one part."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.path: list[str] = []       # open tags from the node down
        self.open = False               # whether the last part takes more text
        self.muted = 0
        self.item = False               # right behind the start of a list item

    def _part(self, tag: str):
        self.nodes[-1]["parts"].append({"tag": tag, "pieces": []})
        self.open = True

    def _node(self, tag: str):
        self.nodes.append({"tag": tag, "parts": []})
        self._part(tag)

    def _leave(self, tag: str):
        while self.path and self.path.pop() != tag:
            pass
        self.open = bool(self.path) and (len(self.path) > 1 or self.path[0] != DRAWINGS)

    def handle_starttag(self, tag, attrs):
        self.muted += tag in SILENT
        if self.muted:
            return
        if tag in VOID:
            return self.handle_data(" ")
        if self.path[-1:] == [tag] and tag in ("p", "li"):
            self._leave(tag)            # such a tag closes the one before it
        if not self.path and tag in FRAMES:
            self.open = False
            return
        if not self.path:
            self._node(tag)
        elif self.path == [DRAWINGS]:
            self._part(tag)
        self.path.append(tag)
        self.item = tag == "li"

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.muted = max(0, self.muted - 1)
        elif not self.muted and tag in self.path:
            self.item = False
            self._leave(tag)
        elif not self.path and tag in FRAMES:
            self.open = False

    def handle_data(self, data):
        if self.muted:
            return
        if not self.open:
            self._part("") if self.path else self._node("")
        self.nodes[-1]["parts"][-1]["pieces"].append({"item": self.item, "text": data})
        self.item = False


def outline(html: str | None) -> list[dict]:
    parser = _Outline()
    parser.feed(html or "")
    parser.close()
    return parser.nodes


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def as_sentence(text: Column) -> Column:
    """The text with one dot at its end; blank text as it is."""
    return F.when(trimmed(text) == "", text).otherwise(F.concat(F.btrim(trimmed(text), F.lit(";.")), F.lit(". ")))


def part_text(part: Column) -> Column:
    return trimmed(F.array_join(F.transform(part["pieces"], lambda p: F.when(
        p["item"], as_sentence(p["text"])).otherwise(F.translate(p["text"], "\n", " "))), ""))


def _before(items: Column, i: Column, field: str, default) -> Column:
    return F.when(i > 0, F.get(items, i - 1)[field]).otherwise(F.lit(default))


def drawings_text(parts: Column) -> Column:
    """``parts`` is an array of (tag, text)."""
    return F.array_join(F.transform(parts, lambda p, i: F.when(
        (p["tag"] == "p") & ~_before(parts, i, "tag", "").isin(HEADINGS), as_sentence(p["text"])).otherwise(p["text"])), " ")


def node_text(node: Column) -> Column:
    texts = F.transform(node["parts"], lambda p: F.struct(p["tag"].alias("tag"), part_text(p).alias("text")))
    texts = F.filter(texts, lambda p: (p["tag"] != "") | (p["text"] != ""))
    return F.when(node["tag"] == DRAWINGS, drawings_text(texts)).otherwise(F.array_join(texts["text"], " "))


def _fold(items: Column, starts, text, glue) -> Column:
    """Texts of the runs of ``items``: an item that starts one is appended, another is glued to the last."""
    def step(out, x):
        last = F.element_at(out, -1)
        return F.when(starts(x) | (F.size(out) == 0), F.concat(out, F.array(text(x)))) \
            .otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(glue(last, text(x)))))
    return F.aggregate(items, F.array().cast("array<string>"), step)


def with_paragraphs(outlines: DataFrame, nodes: str = "nodes") -> DataFrame:
    """Adds ``paragraphs`` (array) to a table with outlines."""
    n = F.col("_nodes")
    own = outlines.withColumn("_nodes", F.filter(F.transform(nodes, lambda x: F.struct(
        x["tag"].alias("tag"), node_text(x).alias("text"))), lambda x: (x["tag"] != "") | (x["text"] != "")))

    def joined(x, i):
        before = F.length(_before(n, i, "text", ""))
        return ((x["tag"] == "p") & _before(n, i, "tag", "").isin(HEADINGS)) | ((before > 0) & (before < MIN_NODE))
    own = own.withColumn("_nodes", F.transform(n, lambda x, i: F.struct(
        x["text"].alias("text"), (x["tag"] == DRAWINGS).alias("whole"), joined(x, i).alias("joined"))))
    own = own.withColumn("_texts", _fold(
        F.filter(n, lambda x: x["whole"] | (x["text"] != "")), lambda x: x["whole"] | ~x["joined"], lambda x: x["text"],
        lambda a, b: F.concat(a, F.lit(" "), b))).drop("_nodes")
    return own.withColumn("paragraphs", join_single_sentences(F.col("_texts"))).drop("_texts")


def sentence_count(text: Column) -> Column:
    """Sentences of a paragraph after short ones have joined the one before."""
    return F.size(merge_short(sentences(text)))


def join_single_sentences(texts: Column) -> Column:
    """X19 on an array of paragraphs."""
    marked = F.transform(texts, lambda t: F.struct(t.alias("text"), (sentence_count(t) == 1).alias("single")))

    def started(items):
        def one(x, i):
            before = _before(items, i, "single", False)
            after = F.coalesce(F.get(items, i + 1)["single"], F.lit(False))
            return F.struct(x["text"].alias("text"), F.when(x["single"], after & ~before)
                            .otherwise(~((i == 1) & before)).alias("starts"))
        return F.transform(items, one)
    # bound once as a lambda variable, so that sentences are counted once for each paragraph
    runs = F.element_at(F.transform(F.array(marked), started), 1)
    return _fold(runs, lambda x: x["starts"], lambda x: x["text"],
                 lambda a, b: F.concat(F.btrim(a, F.lit(".")), F.lit(". "), b))


def page_outlines(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, nodes) for every page."""
    def run(batches):
        import pandas as pd
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "nodes": [outline(x) for x in pdf[html_col]]})
    ship_package(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, html_col).mapInPandas(run, f"{id_col} {kind}, nodes {OUTLINE}")


def page_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, para_no, paragraph) for every page."""
    return with_paragraphs(page_outlines(pages, id_col, html_col)) \
        .select(id_col, F.posexplode("paragraphs").alias("para_no", "paragraph")) \
        .withColumn("para_no", F.col("para_no") + 1)
