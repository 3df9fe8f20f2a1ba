"""Operators 1 and 10 on pages."""

import gzip
import hashlib
import os

import pytest
from brute import main_text

from voltweave.llm import html, warc
from voltweave.llm.tables import shared_dir

BIG, OTHER = "<p>" + "x" * 1200 + "</p>", "<p>é" + "y" * 1200


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id * 0 AS record_id", "'x' AS digest", "0 AS n")


def test_round_trip_resolves_revisits(spark):
    rows = [
        (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/9\r\nX: 1", BIG), (3, "http://b", OTHER), (4, None, None), (5, "u", ""), (6, "v", "small"), (7, "w", "small"), (None, "n", BIG), (2, "http://a/2", BIG),
        (8, "e", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 50),
    ]
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in warc.archive_round_trip(pages(spark, rows)).collect()}
    wanted = set()
    for p, _, h in rows:
        raw = (h or "").encode()
        again = h == BIG and p in (1, 2)
        wanted.add((p, "revisit" if again else "response", 9 if again else None, len(raw), hashlib.sha1(raw).hexdigest()))
    assert got == wanted
    assert warc.archive_round_trip(pages(spark, rows)).count() == len(rows)
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_archives_are_archives_and_damage_is_noticed(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(pages(spark, [(1, "http://a", BIG), (2, "http://b", BIG)]).coalesce(1), path)
    files = [f for f in os.listdir(path) if f.endswith(".gz")]
    data = b"".join(gzip.open(f"{path}/{f}").read() for f in files)
    found = list(warc.records(data))
    assert sorted(h["warc-type"] for h, _ in found) == ["response", "revisit"]
    for h, block in found:
        assert h["content-type"].startswith("application/http") and block.startswith(b"HTTP/1.1 200 OK\r\n")
        assert (BIG.encode() in block) == (h["warc-type"] == "response")
    with pytest.raises(ValueError):
        list(warc.records(data[:-10]))
    with pytest.raises(ValueError):
        list(warc.records(b"junk"))
    assert shared_dir(spark)


def test_members_and_pieces_of_archives(spark, tmp_path):
    """One gzip member for each record is the common form; members may also be cut anywhere, and a record is whole in any."""
    path = str(tmp_path / "w")
    rows = [(k, f"http://a/{k}", f"<p>{k} " + "z" * (k * 3000)) for k in range(40)] + [(50, "http://b", "<p>5 " + "z" * 15000)]
    warc.write_archives(pages(spark, rows).coalesce(1), path)
    data = b"".join(gzip.open(f"{path}/{f}").read() for f in os.listdir(path) if f.endswith(".gz"))
    found = list(warc.records(data))
    assert len(found) == 41
    for cuts in (range(0, len(data), 999), [0], [0, *(data.index(b"WARC/1.1\r\n", k) for k in range(1, len(data), 50000) if b"WARC/1.1\r\n" in data[k:])]):
        cuts = sorted({*cuts, len(data)})
        members = b"".join(gzip.compress(data[a:b]) + b"\0" * (a % 3) for a, b in zip(cuts, cuts[1:], strict=False))
        assert list(warc.records(warc.unzipped(members))) == found
    with pytest.raises(ValueError):
        list(warc.records(warc.unzipped(gzip.compress(data)[:-9])))
    with pytest.raises(ValueError):
        list(warc.records(warc.unzipped(b"no archive")))
    for name, parts in (("each", 41), ("three", 3)):
        os.makedirs(tmp_path / name)
        lines = [x + b"" for x in data.split(b"WARC/1.1\r\n")[1:]]
        step = -(-len(lines) // parts)
        (tmp_path / name / "x.warc.gz").write_bytes(b"".join(gzip.compress(b"".join(b"WARC/1.1\r\n" + x for x in lines[k : k + step])) for k in range(0, len(lines), step)))
        got = warc.read_archives(spark, str(tmp_path / name))
        assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got.select("page_id", "record_type", "refers_to").collect()) == [(k, "revisit", 50) if k == 5 else (k, "response", None) for k in [*range(40), 50]]


def test_archives_are_bounded_and_pages_meet_revisits_both_ways(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20000)
    rows = [(k, "u", f"<p>{k % 9} " + "z" * 4000) for k in range(60)] + [(99, "u", "y" * 50000)]
    plain = sorted(map(tuple, warc.archive_round_trip(pages(spark, rows)).collect()), key=str)
    warc.write_archives(pages(spark, rows).coalesce(1), str(tmp_path / "w"))
    sizes = [len(gzip.open(tmp_path / "w" / f).read()) for f in os.listdir(tmp_path / "w") if f.endswith(".gz")]
    assert len(sizes) > 3 and sorted(sizes)[-1] > 50000 and all(n <= 20004 for n in sorted(sizes)[:-1])
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, warc.archive_round_trip(pages(spark, rows)).collect()), key=str) == plain


PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a></li><li><a href=2>More</a></li></ul></nav><div class="cookie-notice">We use cookies on this long page, accept them all please.</div>
<article><h1>The title</h1><p><b>First &amp; bold text that is rather long<br>and goes on</b> for a while.<p>Short.</p><ul><li>An item</li></ul>
<div class="ad">Buy this now, a long advertisement text that goes on.</div><p>Last&nbsp;paragraph with <a href=3>a link</a> and more.</p><form><input>Search</form></article>
<aside>Aside text</aside><section id="comments"><p>A reader's comment that is quite long and detailed, really very long.</p></section><footer>&copy; me</footer></body></html>"""


def test_article_is_kept_whole_and_the_rest_goes():
    assert html.extract(PAGE) == "The title First & bold text that is rather long and goes on for a while. Short. An item Last paragraph with a link and more."


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("  \n ", ""), ("plain words only", "plain words only"), ("<p>one<p>two", "one two"), ("<nav>menu</nav>", ""), ("a <![weird[ b", None), ("<", "<"), ("<!--", None), ("<p>&lt;tag&gt; &#x41;&#66;", "<tag> AB")])
def test_odd_pages(page, text):
    got = html.extract(page)
    assert text is None or got == text


def test_without_an_article_element():
    body = "".join(f"<p>Paragraph number {k} has a good many words in it, as articles do, and ends here.</p>" for k in range(6))
    page = f"<html><body><div id=menu><a>x</a><a>y</a></div><div class=content>{body}</div><div class=sidebar><p>Related things to read, a long list of words.</p></div></body></html>"
    assert html.extract(page).startswith("Paragraph number 0") and html.extract(page).endswith("ends here.") and "Related" not in html.extract(page)


def long_text(k, n=12):
    return f"Part {k} has a good many words in it, " * n + "and ends here."


@pytest.mark.parametrize("start, end", [("<div>", "</div>"), ("<section>", "</section>"), ("<table><tr><td>", "</td></tr></table>"), ("<blockquote>", "</blockquote>")])
@pytest.mark.parametrize("n", [2, 6, 40])
def test_every_part_of_a_page_is_kept(start, end, n):
    body = "".join(f"{start}<p>{long_text(k)}</p>{end}" for k in range(n))
    menu = "<div><a href=1>Home</a></div><div><a href=2>More</a></div>"
    wanted = " ".join(long_text(k) for k in range(n))
    assert html.extract(f"<html><body>{menu}{body}{menu}<footer>Foot</footer></body></html>") == wanted
    assert html.extract(f"<html><body>{menu}<div>{body}</div><div class=sidebar><p>{long_text(99)}</p></div></body></html>") == wanted


def test_a_page_of_text_alone_is_kept_whole():
    for sizes in ([9] * 6, [60, 9, 9, 9, 9, 9, 9], range(1, 20)):
        parts = "".join(f"<div><p>{long_text(k, n)}</p></div>" for k, n in enumerate(sizes))
        wanted = " ".join(long_text(k, n) for k, n in enumerate(sizes))
        assert html.extract(f"<body>{parts}</body>") == html.extract(f"<body><nav><a href=1>Home</a></nav>{parts}<footer>Foot</footer></body>") == wanted


def test_every_article_of_a_page_is_kept():
    parts = "".join(f"<article><h2>T{k}</h2><p>{long_text(k)}</p></article>" for k in range(7))
    wanted = " ".join(f"T{k} {long_text(k)}" for k in range(7))
    assert html.extract(f"<body><nav><a href=1>Home</a></nav><main>{parts}</main></body>") == html.extract(f"<body>{parts}</body>") == wanted


def test_small_parts_between_large_ones_are_kept():
    sizes = [1, 40, 2, 0, 20, 1, 3, 30, 1]
    parts = "".join(f"<div><p>{long_text(k, n)}</p></div>" for k, n in enumerate(sizes))
    wanted = " ".join(long_text(k, n) for k, n in enumerate(sizes))
    assert html.extract(f"<body><div><a href=1>Home</a><a href=2>More</a></div><div class=x>{parts}</div></body>") == html.extract(f"<body>{parts}</body>") == wanted


def test_names_veto_as_whole_tokens():
    body = "".join(f"<p>{long_text(k)}</p>" for k in range(4))
    wanted = " ".join(long_text(k) for k in range(4))
    for name in ("has-sidebar", "no-comments", "with_ads", "page layout-footer", "commentary", "adverbs"):
        assert html.extract(f'<body><div class="{name}"><article>{body}</article></div></body>') == wanted
        assert html.extract(f'<body><div class="{name}">{body}</div></body>') == wanted
    for name in ("comment", "comments", "user-comment", "post_comments", "comment-12", "x sidebar", "site-footer", "cookie-notice", "ad"):
        veto = f'<div class="{name}"><p>{long_text(99)}</p></div>'
        assert html.extract(f"<body><article>{body}{veto}</article>{veto}</body>") == wanted


def test_comments_in_articles_of_their_own_go():
    body = "".join(f"<p>{long_text(k)}</p>" for k in range(4))
    wanted = " ".join(long_text(k) for k in range(4))
    comment = f'<article class="comment"><p>{long_text(50)}</p></article>'
    assert html.extract(f"<body><article>{body}{comment}{comment}</article></body>") == wanted
    assert html.extract(f"<body><article>{body}</article>{comment}{comment}</body>") == wanted


def test_the_clusters_decide(monkeypatch, small):
    """With one cluster for all lines, menus and adverts come back, named or not."""
    body = "".join(f"<p>{long_text(k)}</p>" for k in range(4))
    tiny = "".join(f"<div><i><b>{w}</b></i></div>" for w in ("Home", "News", "Help", "Maps", "Jobs"))
    page = f"<body>{tiny}<nav><p>Menu</p></nav><div>{body}</div><div class=ad>Buy</div>{tiny}</body>"
    import pyarrow.parquet as pq

    pages_ = [page, *pq.read_table(f"{small}/pages.parquet")["html"].to_pylist()]
    before = [html.extract(x) for x in pages_]
    assert before[0] == " ".join(long_text(k) for k in range(4))
    monkeypatch.setattr(html, "high_cluster", lambda values: values > -1)
    after = [html.extract(x) for x in pages_]
    assert "Home" in after[0] and "Menu" in after[0] and all(a != b for a, b in zip(before, after, strict=True))


def test_table(spark, small):
    got = html.extract_text(spark.read.parquet(f"{small}/pages.parquet").selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert len(got) == 50 and all(r["n_chars"] == len(r["text"]) > 0 for r in got)
    for r in spark.read.parquet(f"{small}/pages.parquet").collect()[:20]:
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        wanted = html.extract(f"<article>{inner}</article>")
        assert next(g for g in got if g["page_id"] == r["page_id"])["text"] == wanted
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        assert next(g for g in got if g["page_id"] == r["page_id"])["text"] == main_text(r["html"])
    assert html.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
