import hashlib
import tarfile
import time
from collections import Counter
from html.parser import HTMLParser
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from feloom.llm import chat_format, html_extract, media

from .conftest import SF

PAGE = """<html><body class="has-sidebar"><header>Top</header><nav><ul><li>Menu</ul></nav><div id=cookie-bar>We use them</div>
<main><article class="post-12"><header><h1>Title &lt;x&gt;</h1></header><div class=share-buttons>Share</div>
<p>One, two &amp; three <a href=x>link</a> text here   which is long enough.</p><p>a<br>b &nbsp; c<ul><li>x<li>y</ul>
<form><input>Mail</form><!-- <p>no</p> --><aside>side</aside><script>if(a<b){"</p>"}</script><table><tr><td>1<td>2</table></article>
<section class="comments"><article>Nice post, a really long comment text here, yes</article></section></main><footer>f</footer>"""


def test_page():
    expected = "Title <x>\nOne, two & three link text here which is long enough.\na b c\nx\ny\n1\n2"
    assert html_extract.Page(PAGE).main_text(None) == expected
    assert html_extract.Page(PAGE).main_text("main>article.post") == expected
    assert html_extract.Page("a < b &eacute;").main_text("no>path") == "a < b é"
    assert html_extract.Page("<p>unclosed <b>bold<p>next</div><script>never").main_text(None) == "unclosed bold\nnext"


def test_whole_article():
    """What lies beside the winning container in its article belongs to the text."""
    p = "<p>Enough words to count, in a sentence that goes on for a while and then some more, and more.</p>"
    page = f"<main><article><h1>Headline</h1><div class=lead>The lead.</div><div class=article-body>{p * 6}</div><section><p>At the end.</p></section></article></main>"
    for path in (None, "main>article>div.article-body"):
        text = html_extract.Page(page).main_text(path).split("\n")
        assert text[:2] == ["Headline", "The lead."] and len(text) == 9 and text[-1] == "At the end."


def test_hidden():
    shown = ["style='overflow:hidden'", "class='overflow-hidden'", "class=hidden-xs", "data-hidden=1", "title='a hidden place'", "class= hidden"]
    gone = ["hidden", "hidden=''", "class='x' HIDDEN", "class='x'hidden", "aria-hidden='true'", "style='display: none'", "style='visibility:hidden'"]
    for attributes in shown + gone:
        text = html_extract.Page(f"<body><div {attributes}><p>Some text.</p></div></body>").main_text(None)
        assert text == ("Some text." if attributes in shown else ""), attributes


LONG_P = "<p>Enough words to count, in a sentence that goes on for a while and then some more, and more.</p>"


def test_wrapped_articles():
    """Names, forms and open quotes around an article do not take it away; small elements of such names go."""
    body = LONG_P * 5
    for page in (
        f"<body><div class='content-with-sidebar'>{body}</div></body>",
        f"<body><div class='elementor-widget elementor-widget-theme-post-content'>{body}</div></body>",
        f"<body><form id=aspnetForm>{body}</form></body>",
        f"<body><div class=widget-area><article>{body}</article></div></body>",
        f"<body><div class='main'>{body}<form><p>Mail us your address, name and whatever else you like to say.</p></form></div></body>",
        f"<body><div class='main'>{body}</div><div class=sidebar-content>{LONG_P}</div><div class='comments-body'>{LONG_P * 9}</div></body>",
        f"<body><div class='main'><p title='x' class=\"x>Enough words to count, in a sentence that goes on for a while and then some more, and more.</p>{LONG_P * 4}<p class=\"y\"></p></div></body>",
        f"<body><div data-x=\"<b title='a'>no</b>\" class='main'>{body}</div></body>",
    ):
        text = html_extract.Page(page).main_text(None)
        assert text.split("\n") == [LONG_P[3:-4]] * 5, page


def test_markup_in_linear_time():
    for odd in ("<p class=\"x>", "<p class='x", "<", "<!-- ", "<p a=b\"", "<script>", "<a '\">"):
        page = LONG_P * 3 + odd * 100_000
        start = time.process_time()
        html_extract.Page(page)
        assert time.process_time() - start < 20, odd


class Reader(HTMLParser):
    """The words within article, by the standard parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.depth, self.skip, self.words = 0, 0, []
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        names = dict(attrs).get("class") or ""
        self.depth += tag == "article"
        if self.skip or tag in ("nav", "aside", "form", "script", "style", "button", "footer") or any(w in names for w in ("comment", "share", "promo", "advert", "related", "newsletter")):
            self.skip += tag not in html_extract.VOID

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= bool(self.skip and tag not in html_extract.VOID)

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.words += data.split()


def test_articles_by_another_parser(spark):
    """Of the words that the standard parser finds in article elements nearly all are extracted, and hardly others."""
    shares = []
    for r in html_extract.extract(spark.read.parquet(f"{SF}/pages.parquet")).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        there, got = Counter(Reader(r.html).words), Counter(r.text.split())
        if there:
            both = (there & got).total()
            shares.append((both / there.total(), both / max(1, got.total())))
    assert len(shares) >= 50 and (np.mean(shares, axis=0) > 0.97).all()


def test_host():
    assert [html_extract.host_of(u) for u in ("http://A.b:80/x", "//c.d", "x", None, "https://u@e.f?q")] == ["a.b", "c.d", "", "", "e.f"]


def test_extract(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = html_extract.extract(pages).collect()
    assert len(got) == pages.count() and all(r.text and r.n_chars == len(r.text) and r.path in ("article", None) for r in got)


def test_consensus(spark):
    """The host's path wins on a page whose own best container is another."""
    text = "Enough words to count, in a sentence that goes on for a while and then some more."
    usual = f"<div class='box'><p>{text}</p></div><div class='list'>short</div>"
    other = f"<div class='box'><p>{text}</p></div><div class='list'><p>{text}</p><p>{text}</p></div>"
    far = f"<div class='box'><p>Tiny.</p></div><div class='list'>{f'<p>{text}</p>' * 4}</div>"
    rows = [(i, "http://h.x/a", usual) for i in range(9)] + [(9, "http://h.x/b", other), (10, None, None), (11, "http://h.x/c", ""), (12, "http://o.x", other), (12, "http://o.x", other), (13, "http://h.x/d", far)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash"))).collect()}
    assert got[9].text == text and got[9].path == "div.box" and got[12].text == f"{text}\n{text}" and got[13].text == f"{text}\n{text}\n{text}\n{text}" and (got[10].text, got[11].text) == ("", "")
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_media(spark, odd, nothing, tmp_path):
    got = media.media_columns(odd, f"file://{tmp_path}/m", 4096).collect()
    assert len(got) == odd.count()
    texts = Counter()
    for r in odd.collect():
        raw = (r.text or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        texts[r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-16:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == texts
    stored = {}
    for shard in (tmp_path / "m").glob("*.tar"):
        with tarfile.open(shard) as tar:
            for m in tar:
                body = tar.extractfile(m).read()
                stored[m.name] = body
                assert m.name == hashlib.sha256(body).hexdigest() + ".png"
    assert all(len(stored[f"{r.media_sha256}.png"]) == r.media_bytes for r in got)
    assert len({r.feature for r in got if r.doc_id in (2, 3)}) == 1
    assert media.media_columns(nothing, f"file://{tmp_path}/n").count() == 0


def test_headers_by_range(spark, docs, tmp_path):
    index = media.store(docs.limit(20), f"file://{tmp_path}/h")
    rows = media.read_headers(index).collect()
    assert len(rows) == 20 and all((r.width, r.depth) == (192, 8) and r.height > 0 for r in rows)
    with pytest.raises(ValueError):
        media.image_header(b"x" * 33)


TURNS = [
    (1, 0, "system", "Be [INST] kind"),
    (1, 1, "user", "</s>[INST] ok [/INST]"),
    (1, 2, "assistant", "<\\s> <\\\\/s> $1 \\ [\\INST] "),
    (2, 1, "assistant", "first?"),
    (2, 0, "assistant", None),
    (3, 0, "to[/ROLE]ol", "\n"),
    (3, 1, None, ""),
    (3, 1, None, ""),
    (None, 0, "user", "no id"),
]


def test_chats(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    for conv, r in got.items():
        expected = sorted((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        assert [(t.role, t.text) for t in r.turns] == [t[1:] for t in expected]
        assert r.loss_text == "".join(t[2] for t in expected if t[1] == "assistant") and r.n_turns == len(expected)
        assert r.formatted == "".join(s.text for s in r.segments)
    assert {k: r.valid for k, r in got.items()} == {1: True, 2: False, 3: False, None: False}
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_escape_round_trip(spark):
    import random

    rng = random.Random(4)
    parts = [*chat_format.TEMPLATE.controls(), "\\", "\\\\", "<", "[", "s>", "$1", " ", "x", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert r.t == r.u and not any(c in r.e for c in chat_format.TEMPLATE.controls())
