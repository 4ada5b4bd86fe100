"""Archives and extraction."""

import base64
import hashlib
from urllib.parse import quote

import numpy as np
import pytest
import zstandard

from aetherlog.llm import extraction, warc

SCHEMA = "capture_id BIGINT, stream_url STRING, payload STRING, record_id STRING, archive STRING"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture(scope="module")
def captures():
    body = [(i, f"http://radio.example/{i}?q=%20ü b", ("same " * 50 if i % 4 == 0 else f"page {i} " * (i * 40)), "x", "y") for i in range(50)]
    return body + [(60, None, None, "x", "y"), (61, "http://a\r\nX: y", "", "x", "y"), (62, "u", "\r\n\r\nWARC/1.1\r\n\r\n", "x", "y"),
                   (None, "n", "only null", "x", "y"), (70, "v", "z" * 3_000_000, "x", "y"), (71, "v", "z" * 3_000_000, "x", "y"), (5, "again", body[5][2], "x", "y")]


def test_round_trip(spark, captures):
    archives = warc.write_archives(spark.createDataFrame(captures, SCHEMA).repartition(3), archive_bytes=300_000)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(captures) and archives.count() > 3
    first = {}
    for i, _, t, *_ in captures:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    urls = {str(i): None if u is None else quote(u, safe="".join(map(chr, range(33, 127)))) for i, u, *_ in captures if i not in (None, 5)}
    for r in got:
        key = None if r["record_id"] is None else int(r["record_id"])
        text = next(t for i, _, t, *_ in captures if i == key) or ""
        to = first.get(text, key)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(text.encode()), digest(text))
        assert r["record_type"] == ("response" if to == key else "revisit")
        assert r["refers_to"] == (None if to == key else str(to))
        assert r["payload"] == (bytearray(text.encode()) if to == key else None)
        assert r["record_id"] not in urls or r["target_uri"] == urls[r["record_id"]]


def test_frames_stand_alone_and_records_are_found(spark, captures):
    archives = warc.write_archives(spark.createDataFrame(captures, SCHEMA), archive_bytes=5_000_000, frame_bytes=20_000)
    wanted = spark.createDataFrame([("3",), ("8",), ("62",), ("nobody",)], "record_id STRING")
    got = {r["record_id"]: r for r in warc.fetch_records(archives, wanted).collect()}
    assert set(got) == {"3", "8", "62"} and bytes(got["62"]["payload"]) == b"\r\n\r\nWARC/1.1\r\n\r\n" and got["8"]["refers_to"] == "0"
    row = max(archives.collect(), key=lambda r: len(r['records']))
    content = bytes(row["content"])
    table = warc.seek_table(content)
    frames = [warc.read_frame(content, f) for f in table]
    assert len(table) > 1
    # any Zstandard reader gets all records, as the seek table is a skippable frame
    reader = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True)
    assert reader.read() == b"".join(frames)
    for e in row["records"]:
        headers, _, end = warc.parse_record(frames[e["frame"]], e["offset"])
        assert headers["WARC-Record-ID"] == f"<urn:capture:{e['record_id']}>" and end - e["offset"] == e["length"]


def test_damage_is_noticed(spark):
    writer = warc.ArchiveWriter(3)
    writer.add("1", warc._record("1", "u", "1970-01-01T00:00:00Z", b"other", 5, digest("right"), None))
    df = spark.createDataFrame([(bytearray(writer.finish()),)], "content BINARY")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archives(df).collect()


def test_small_payloads_and_none(spark):
    df = spark.createDataFrame([(1, "u", "ab", "", ""), (2, "u", "ab", "", ""), (3, "u", "abcd", "", ""), (4, "u", "abcd", "", "")], SCHEMA)
    got = {r["record_id"]: r["record_type"] for r in warc.read_archives(warc.write_archives(df, min_bytes=3)).collect()}
    assert got == {"1": "response", "2": "response", "3": "response", "4": "revisit"}
    assert warc.write_archives(spark.createDataFrame([], SCHEMA)).count() == 0


ARTICLE = ["A title", "First paragraph with bold words & signs, long enough to be the main thing on this page of ours.", "Short.",
           "Another long paragraph follows here with a link inside it and more to read for everybody who came this far.", "End."]
INNER = ("<h1>A title</h1><p>First <b>para</b>graph with <i>bold</i> words &amp; signs,\n long enough to be the main thing on this page of ours."
         "<p>Short.</p><p>Another&#32;long paragraph follows here with a <a href=x>link</a> inside it and more to read for everybody who "
         "came this far.</p><div>End.</div>")
AROUND = ("<nav><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></nav>", "<header><h2>Site name of ours</h2></header>",
          "<aside><p>Popular posts of the week that nobody asked for, but which are rather long texts to read.</p></aside>",
          "<div class='cookie-notice'>We use cookies to make this page slower than it has to be, please agree to all of them.</div>",
          "<form><label>Search our long archive of pages here</label><input><button>Go</button></form>",
          "<section id=comments><p>First! A reader's comment that is as long as a paragraph of the article itself, or so.</p></section>",
          "<footer>&copy; us, and a long line of legal text that should not be in any article at all, ever.</footer>",
          "<script>document.write('<p>no</p>')</script><style>p{x:y}</style><!-- <p>not this</p> --><noscript><p>nor this</p></noscript>",
          "<div class='ad'>Buy this thing now, it is a long advert with many words in it for you to read.</div>")


@pytest.mark.parametrize("shell", ["<article>{}</article>", "<main><div>{}</div></main>", "<div id=content>{}</div>", "<table><tr><td>{}</td></tr></table>",
                                   "<div role=main><header><p>{}</header></div>"])
def test_article_without_its_surroundings(shell):
    before, after = "".join(AROUND[:5]), "".join(AROUND[5:])
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body>{before}{shell.format(INNER)}{after}</body></html>"
    if "role" in shell:  # a header is only the article's own inside article or main
        page = page.replace("<header><p>", "<p>").replace("</header></div>", "</div>")
    assert extraction.main_text(page) == " ".join(ARTICLE)


@pytest.mark.parametrize("shell", [
    "<div class='site-content has-sidebar'><article>{}</article></div>", "<div class='container no-sidebar'>{}</div>",
    "<div class='site-content has-sidebar'><div>{}</div></div>", "<div class=sidebar><main>{}</main></div>"])
def test_a_name_does_not_take_the_article(shell):
    page = f"<!DOCTYPE html><html><head><title>T</title><meta charset=utf-8></head><body>{AROUND[0]}{AROUND[3]}{shell.format(INNER)}{AROUND[6]}</body></html>"
    assert extraction.main_text(page) == " ".join(ARTICLE)


def test_named_parts_of_the_article_stay():
    long = "A paragraph of the article that is long enough to be seen as content by all means, as it goes on and on."
    page = ("<article><div class='post-header'><h1>Title</h1></div><p>{0}</p><h2 id='related-work'>Related work</h2><p>{0}</p>"
            "<section id='search-results'><h2>Results</h2><p>{0}</p></section><p>{0}</p></article>").format(long)
    assert extraction.main_text(page) == f"Title {long} Related work {long} Results {long} {long}"


LONG = "A paragraph of the article that is long enough to be seen as content by all means, as it goes on and on."


@pytest.mark.parametrize("page, want", [
    (f"<article><h1>T</h1><p>{LONG}<p>{LONG}<ol class='comment-list'><li>{LONG}<li>First!</ol></article>", f"T {LONG} {LONG}"),
    (f"<main><h1>T</h1><p>{LONG}<section class='user-comments'><p>{LONG * 3}</section></main>", f"T {LONG}"),
    (f"<article><h1>T</h1><div class='share-buttons'>Share this on all networks you know of right now</div><p>{LONG}</article>", f"T {LONG}"),
    (f"<main><div class='cookie-bar'>We use cookies to make this page slower than it has to be.</div><p>{LONG}<p>{LONG}</main>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}<div class='newsletter-box'><p>Get our letter every week, it is full of words to read.</div><p>{LONG}</article>", f"{LONG} {LONG}"),
    (f"<article><p>{LONG}<div style='color:red; display:none'>{LONG}</div><p hidden>x</p><p>End.</article>", f"{LONG} End."),
    (f"<body><article><h1>T</h1><p>{LONG}</article><article><p>{LONG} More.</article></body>", f"T {LONG} {LONG} More."),
    (f"<body><nav><a href=x>n</a></nav><h1>T</h1><p>Lead.<div><p>{LONG}<p>{LONG}</div><footer>f</footer></body>", f"T Lead. {LONG} {LONG}"),
    (f"<main><h1>T</h1><article><p>{LONG}</article></main>", f"T {LONG}"),
    (f"<main><p>{LONG}<ul><li><a href=1>One more</a><li><a href=2>And two</a><li><a href=3>And three</a></ul><p>{LONG}<p>{LONG}</main>", f"{LONG} {LONG} {LONG}"),
])
def test_templates(page, want):
    assert extraction.main_text(page) == want


def test_ratios_decide(monkeypatch):
    """With all ratios alike the pages without an article element come out otherwise."""
    teaser = "".join(f"<div><p>Teaser {i} of another page</div>" for i in range(9))
    pages = [f"<body><div>{teaser}</div><div id=x><p>{LONG * 2}<p>{LONG * 3}<p>{LONG}</div><div>{teaser}</div></body>",
             f"<main><div class='post-header'>{LONG}</div><p>{LONG * 2}<div class='related'><p>See also</div></main>",
             f"<table><tr><td>{teaser}<td><p>{LONG * 3}<p>{LONG}</table>"]
    before = [extraction.main_text(p) for p in pages]
    assert before[0] == f"{LONG * 2} {LONG * 3} {LONG}" and "See also" not in before[1]
    monkeypatch.setattr(extraction, "smoothed_ratios", lambda lengths, tags, sigma=1.0: np.ones(len(lengths)))
    assert sum(extraction.main_text(p) != b for p, b in zip(pages, before)) >= 2


def test_deep_nesting_is_linear():
    import time

    begun = time.process_time()
    assert extraction.main_text("<div>" * 50_000 + "<p>hello there</p></span>" * 100) == " ".join(["hello there"] * 100)
    assert extraction.main_text("<div>a" * 20_000).startswith("a a a")
    assert time.process_time() - begun < 10


def test_head_without_an_end():
    for start in ("<html><head><title>T</title><body>", "<head><meta charset=utf-8><title>T</title>", "<head><script>var x</script>"):
        assert extraction.main_text(f"<!DOCTYPE html>{start}<article>{INNER}</article>") == " ".join(ARTICLE)
    assert extraction.main_text("<head><title>T</title>words without a body") == "words without a body"


def test_bare_and_broken_pages():
    assert extraction.main_text("") == "" and extraction.main_text("<p></p>") == ""
    assert extraction.main_text("just text &lt;3 &eacute") == "just text <3 é"
    assert extraction.main_text("<p>one<p>two<br>three <b>fo</b>ur") == "one two three four"
    assert extraction.main_text("<article><p>a</b></p></span><p>b</article>") == "a b"
    long = "word " * 100_000
    assert extraction.main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_extract_pages(spark):
    rows = [(1, "u", f"<article>{INNER}</article>", "x"), (2, None, None, "x"), (3, "v", "", "x"), (1, "u", f"<article>{INNER}</article>", "x")]
    got = extraction.extract_pages(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, text STRING")).collect()
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in got) == sorted(
        [(1, " ".join(ARTICLE), len(" ".join(ARTICLE)))] * 2 + [(2, "", 0), (3, "", 0)])
    assert extraction.extract_pages(spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")).count() == 0
