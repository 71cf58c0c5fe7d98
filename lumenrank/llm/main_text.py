"""The main text of web pages: flat text blocks, classified by their words, links and neighbours.

A page is read once as a stream of tags (no tree is built) and cut at block-level tags into blocks: text, words, words
in links, and where the block lies (inside a main container, inside boilerplate). Word counts and link densities of a block
and of its neighbours in the page, with these places, go through a decision tree that ``train_blocks`` learns from a
small labelled table: blocks of made-up pages in the layouts of ``LAYOUTS``, where the first letter of each word tells
the label. The tree is applied as one column expression.

A null html has no text. Tags that are not closed, closed twice or nested wrongly only move the borders of blocks; scripts,
styles, comments, head and form controls hold no text. Repeated rows are pages of their own; columns but page_id, url,
html are ignored, and null ids and urls stay. A very long page is read whole in one task. No pages give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.llm.common import small_batches

# HTML elements by what they do to the text around them.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SILENT_TAGS = frozenset("script style noscript template head title svg math iframe object applet canvas audio video select textarea button datalist".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_TAGS = frozenset("nav header footer aside menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
CLOSES_ITSELF = frozenset("p li dt dd tr td th option".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())

# Words of class and id names that tell boilerplate and main containers.
BOILERPLATE_WORDS = frozenset(
    "ad ads adv nav navi menu menus aside side header footer foot top bottom notice notices alert cookie cookies gdpr privacy legal terms copyright share sharing social follow related recommended recommendations more popular trending tags tag meta byline author login signin signup register search skip breadcrumb breadcrumbs crumbs pager pagination paging reply replies respond discussion feedback poll rating widget widgets toolbar tools links linklist promo promos promotion teaser teasers sponsor sponsored partner partners outbrain taboola banner banners popup overlay modal consent newsletter subscribe subscription comment comments".split()
)
BOILERPLATE_PARTS = re.compile("sidebar|comment|footer|masthead|navbar|navigation|cookie|advert|sponsor|promo|newsletter|subscri|breadcrumb|social|disqus|pagination|consent|popup|modal|topbar|toolbar|related")
MAIN_WORDS = frozenset("article articlebody content post entry story main text body prose".split())
_NAME_WORDS = re.compile("[A-Z]?[a-z]+|[A-Z]+")

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "main", "boilerplate", "heading", "page_main")
_BLOCKS = "array<struct<text:string,words:int,links:double,main:int,boilerplate:int,heading:int>>"


def place_of(tag: str, attrs: list[tuple[str, str | None]]) -> str | None:
    """'boilerplate', 'form', 'main' or None: what a block-level element says of the text in it."""
    held = {k: v or "" for k, v in attrs}
    named = f"{held.get('class', '')} {held.get('id', '')}"
    words = {w.lower() for w in _NAME_WORDS.findall(named)}
    told = bool(words & BOILERPLATE_WORDS or BOILERPLATE_PARTS.search(named.lower()))
    hidden = "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "").lower()
    if tag in ("html", "body"):
        return None
    if tag == "form":  # a form may hold a whole page
        return "form"
    if tag in BOILERPLATE_TAGS or hidden or held.get("role", "").lower() in BOILERPLATE_ROLES:
        return "boilerplate"
    if tag == "main" or held.get("role", "").lower() == "main":
        return "main"
    if told:
        return "boilerplate"
    return "main" if tag in MAIN_TAGS or words & MAIN_WORDS else None


class BlockReader(HTMLParser):
    """The blocks of a page, in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.open: list[tuple[str, str | None]] = []
        self.count: dict[str, int] = {}
        self.places: dict[str, list[int]] = {"main": [], "form": [], "boilerplate": []}  # depths of the open elements that tell one
        self.silent = 0

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            inner, form = (self.places[k][-1] if self.places[k] else -1 for k in ("main", "form"))
            heading = any(self.count.get(f"h{k}") for k in range(1, 7))
            links = len("".join(self.linked).split()) / len(words)
            self.blocks.append((" ".join(words), len(words), min(1.0, links), int(inner >= 0), int(bool(self.places["boilerplate"]) or form > inner), int(heading)))
        self.parts, self.linked = [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        if tag in CLOSES_ITSELF and self.open and self.open[-1][0] == tag:
            self.pop()
        place = place_of(tag, attrs) if tag in BLOCK_TAGS else None
        self.open.append((tag, place))
        self.count[tag] = self.count.get(tag, 0) + 1
        self.silent += tag in SILENT_TAGS
        if place:
            self.places[place].append(len(self.open))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def pop(self) -> None:
        tag, place = self.open.pop()
        self.count[tag] -= 1
        self.silent -= tag in SILENT_TAGS
        if place:
            self.places[place].pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK_TAGS:
            self.flush()
        if self.count.get(tag):
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.count.get("a"):
                self.linked.append(data)


def read_blocks(html: str | None) -> list[tuple]:
    """text, words, links (share of its words in links), main, boilerplate, heading of each block of a page."""
    reader = BlockReader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    return reader.blocks


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, blocks of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    names = ("text", "words", "links", "main", "boilerplate", "heading")
    kind = pa.list_(pa.struct([pa.field(n, pa.string() if n == "text" else pa.float64() if n == "links" else pa.int32()) for n in names]))

    def read(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            blocks = [[dict(zip(names, b, strict=True)) for b in read_blocks(h.as_py())] for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(blocks, kind)], names=["page_id", "url", "blocks"])

    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return plain.mapInArrow(read, f"page_id long, url string, blocks {_BLOCKS}")


def with_neighbours(blocks: Column) -> Column:
    """blocks as structs of text and FEATURES; before the first and after the last block lie 0 words."""
    near = lambda x, i, c: F.coalesce(F.get(blocks, i)[c], F.lit(0)).cast("double")
    page = F.exists(blocks, lambda b: (b["main"] == 1) & (b["boilerplate"] == 0)).cast("double")
    return F.transform(
        blocks,
        lambda b, i: F.struct(
            b["text"].alias("text"), b["words"].cast("double").alias("words"), b["links"].alias("links"),
            *[near(b, i + k, c).alias(f"{side}_{c}") for k, side in ((-1, "before"), (1, "after")) for c in ("words", "links")],
            *[b[c].cast("double").alias(c) for c in ("main", "boilerplate", "heading")], page.alias("page_main"),
        ),
    )


#: Layouts of made-up pages. m: a main text of so many words, b: boilerplate, l: boilerplate in a link.
LAYOUTS = (
    "<header>{b3}<nav><ul><li>{l1}</li><li>{l2}</li><li>{l1}</li></ul></nav></header><article><h1>{m6}</h1><p>{m60}</p><p>{m4}</p><p>{m90}</p></article><footer>{b12}</footer>",
    "<nav><ul><li>{l1}</li><li>{l1}</li></ul></nav><div class='ad'>{b9}</div><article><h1>{m1}</h1><p>{m1}</p></article><footer>{b14}</footer>",
    "<nav>{l4}</nav><div class='ad'>{b12}</div><article><h1>{m8}</h1><p>{m120}<p>{m2}<p>{m40}<blockquote>{m12}</blockquote><p>{m30}</article><footer>{b4} {l2}</footer>",
    "<div id='cookie-notice'>{b25}</div><div class='menu'><a>{b1}</a> {l1} {l2}</div><main><h2>{m5}</h2><p>{m70}</p><ul><li>{m6}</li><li>{m9}</li></ul><p>{m20} <a>{m3}</a> {m20}</p><div class='share'>{l1} {l1}</div></main><aside><h3>{b2}</h3><p>{b30}</p></aside><footer>{b10}</footer>",
    "<article><header><h1>{b7}</h1></header><p>{m50}</p><p>{m3}</p><div class='advert'>{b11}</div><p>{m80}</p><footer>{b5}</footer></article><section id='comments'><h3>{b2}</h3><div class='comment'><p>{b40}</p></div><article class='comment'><p>{b15}</p></article></section>",
    "<div class='header'>{b2}</div><div id='content'><h1>{m7}</h1><p>{m45}</p><p>{m1}</p><p>{m66}</p><table><tr><td>{m2}</td><td>{m3}</td></tr></table></div><div id='sidebar'><ul><li>{l3}</li><li>{l4}</li></ul><p>{b22}</p></div><div class='footer'>{b9}</div>",
    "<form id='page'><div class='top'>{b4}</div><div role='main'><p>{m33}</p><p>{m5}</p><p>{m101}</p><form><p>{b3}</p>{b2}</form></div></form><div class='popup'>{b18}</div>",
    "<div><p>{l1} {l1} {l2}</p></div><div><h1>{m6}</h1><p>{m80}</p><p>{m75}</p><p>{m40}</p></div><div><p>{b5}</p></div><div><p>{l2}</p><p>{l3}</p></div>",
    "<table><tr><td>{l1}</td><td>{l2}</td><td>{l1}</td></tr></table><table><tr><td><p>{m55}</p><p>{m48}</p><p>{m60}</p></td></tr></table><table><tr><td>{b6}</td><td>{l2}</td></tr></table>",
    "<div>{b4}</div><div>{l2}</div><div>{l3}</div><div><p>{m90}</p><p>{m18}</p><p>{m66}</p></div><div>{l5}</div><div>{l4}</div><div>{b7}</div>",
    "<nav>{l3}</nav><section class='notice'><p>{b20}</p></section><div class='post'><h2>{m4}</h2><p>{m2}</p><p>{m3}</p></div><div class='related'><h3>{b2}</h3><p>{l7}</p><p>{l8}</p></div><div class='comments'><p>{b35}</p><p>{b4}</p></div>",
    "<aside><article><h3>{b4}</h3><p>{b26}</p></article></aside><article><h1>{m9}</h1><h2>{m3}</h2><p>{m70}</p><p>{m65} <a>{m4}</a></p><aside>{b17}</aside><p>{m8}</p></article><form>{b6}</form>",
    "<header><p>{b15}</p></header><main><article><p>{m12}</p></article></main><footer><p>{b30}</p><p>{l2} {l3}</p></footer>",
    "<article><h1>{m5}</h1><p>{m3}</p></article>",
    "<h1>{m5}</h1><p>{m30}</p><p>{m12}</p><p>{m50}</p>",
    "<main><p>{m25}</p><p>{m2}</p></main><div class='comment-list'><p>{b45}</p><p>{b30}</p></div>",
    "<p>{m40}</p><p>{m70}</p><p>{m20}</p><p>{l3}</p>",
    "<div class='entry-content'><p>{m10}</p><p>{m44}</p></div><ul class='menu'><li>{l2}</li></ul><p>{b8}</p>",
    "<p>{b6}</p><article><p>{m3}</p><p>{m5}</p></article><p>{b30}</p><p>{b50}</p>",
    "<section class='banner'><h2>{b3}</h2><p>{b40}</p></section><section><h1>{m6}</h1><p>{m35}</p><p>{m60}</p></section><section class='widget'><p>{b22}</p></section>",
    "<ul><li>{l1}</li><li>{l2}</li><li>{l2}</li><li>{l1}</li></ul><h1>{m8}</h1><p>{m100}</p><p>{m7}</p><p>{m85}</p><ul><li>{l4}</li><li>{l5}</li></ul><p>{b7} {l1}</p>",
    "<div class='login'><form>{b5}</form></div><article><p>{m2}</p><h2>{m3}</h2><p>{m60}</p></article><div id='disqus_thread'><p>{b28}</p></div>",
    "<nav>{l2}</nav><article><p>{m5} <a>{m5}</a></p><p><a>{m6}</a></p><p>{m30}</p></article><div class='newsletter'>{b14}</div><footer>{b3}</footer>",
)

#: Each layout is filled so many times, with numbers of words multiplied by another factor each.
FILLS = (0.4, 1.0, 1.6, 2.5)


def labelled_pages() -> list[str]:
    """The pages of LAYOUTS, filled; a word's first letter tells whether it is main text."""

    def fill(m: re.Match, by: float) -> str:
        words = " ".join([f"{'m' if m[1] == 'm' else 'b'}ain"] * max(1, round(int(m[2]) * by)))
        return f"<a href='#'>{words}</a>" if m[1] == "l" else words

    return [re.sub(r"\{([mbl])(\d+)\}", lambda m: fill(m, by), layout) for layout in LAYOUTS for by in FILLS]  # noqa: B023


def labelled_blocks(spark: SparkSession, pages: list[str] | None = None) -> DataFrame:
    """FEATURES and label (1 for main text) of the blocks of labelled pages."""
    made = spark.createDataFrame([(i, None, html) for i, html in enumerate(labelled_pages() if pages is None else pages)], "page_id long, url string, html string")
    each = page_blocks(made).select(F.explode(with_neighbours(F.col("blocks"))).alias("b"))
    return each.select(*[F.col(f"b.{c}") for c in FEATURES], F.startswith(F.col("b.text"), F.lit("m")).cast("double").alias("label"))


def train_blocks(spark: SparkSession, pages: list[str] | None = None, depth: int = 6) -> DecisionTreeClassificationModel:
    """A decision tree of the labelled table."""
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(labelled_blocks(spark, pages))
    return DecisionTreeClassifier(maxDepth=depth, maxBins=128, minInstancesPerNode=2, impurity="entropy").fit(rows.coalesce(1))


def tree_rule(model: DecisionTreeClassificationModel) -> Column | object:
    """The tree as a function from a block (with FEATURES) to whether it is main text."""

    def rule(node, block: Column) -> Column:
        if node.subtreeDepth() == 0:
            return F.lit(node.prediction() == 1.0)
        split = node.split()
        under = block[FEATURES[split.featureIndex()]] <= split.threshold()
        return F.when(under, rule(node.leftChild(), block)).otherwise(rule(node.rightChild(), block))

    return lambda block: rule(model._call_java("rootNode"), block)


def main_text(pages: DataFrame, model: DecisionTreeClassificationModel | None = None) -> DataFrame:
    """page_id, url, text (the main blocks, two line feeds between them), n_chars of pages."""
    chosen = tree_rule(model or train_blocks(pages.sparkSession))
    blocks = page_blocks(pages).withColumn("blocks", with_neighbours(F.col("blocks")))
    text = F.array_join(F.transform(F.filter("blocks", chosen), lambda b: b["text"]), "\n\n")
    return blocks.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.char_length("text").cast("long"))
