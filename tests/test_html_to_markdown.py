"""Whole blocks of a page, against the parser of the standard library."""

from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from docweave.jobs.catalogue import QUERIES, html_lines
from docweave.operators.label import markdown
from tests.conftest import DATA


class Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.blocks, self.open = [], False

    def handle_starttag(self, tag, attrs):
        if tag in ("h1", "h2", "h3", "h4", "p"):
            self.blocks.append([tag, ""])
            self.open = True
        elif tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in ("h1", "h2", "h3", "h4", "p", "article"):
            self.open = False

    def handle_data(self, data):
        if self.open:
            self.blocks[-1][1] += data

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def test_every_block_is_whole(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DATA}/sf0.001/pages.parquet").collect()}
    for r in QUERIES["html_to_markdown"](spark, f"{DATA}/sf0.001").collect():
        parser = Blocks()
        parser.feed(html[r["page_id"]])
        rows = [(tag, " ".join(text.split())) for tag, text in parser.blocks]
        assert r["markdown"].split("\n\n") == [("#" * int(tag[1]) + " " if tag != "p" else "") + text for tag, text in rows if text]


@pytest.mark.parametrize(
    "html, text",
    [
        ("<p><b>a</b> b<br>c</p>", "a b c"),
        ('<h2 class="x>y"><a href="/">T</a></h2><P id=1>one <i>two\nthree</i><p>four<div>no</div>', "## T\n\none two three\n\nfour"),
        ("<h1><div>T</div></h1><pre>no</pre><picture>no</picture><p>1 < 2<!-- <p>no</p> --></p><script>'<p>no</p>'</script>", "# T\n\n1 < 2"),
        ("<p></p>", ""),
        (None, None),
    ],
)
def test_blocks(spark, html, text):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(markdown(F.array_join(html_lines(F.col("html")), "\n"))).first()[0] == text
