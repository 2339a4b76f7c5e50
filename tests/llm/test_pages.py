"""Main text, archives and audio fingerprints against fixtures and brute force."""

import base64
import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.llm import chroma, sitetree, warc
from sieveline.llm.common import new_folder

from .conftest import DATA

# -- main text

ARTICLE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>if (a < b) { t = "</p><article>x"; }</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav><!-- ad <p>hidden</p> --><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p>First  <b>bold</b>
 line&nbsp;here<br>next <p>Second &lt;tag&gt; &#233; &copy<ul><li>one<li>two</ul><div class="share">Share</div><form>Name <input></form><table><tr><td>c1<td>c2</table>
<section class="comments"><p>Reader says</p></section><article class="comment">Me too</article><p>Last</article><aside>Side</aside><footer>Foot</footer>"""


def test_an_article_without_what_surrounds_it():
    assert sitetree.Page(ARTICLE).text().split("\n") == ["A & B", "First bold line here next", "Second <tag> é ©", "one", "two", "c1", "c2", "Last"]


@pytest.mark.parametrize("html,text", [
    ("", ""), (None, ""), ("plain words", "plain words"), ("a < b > c", "a < b > c"), ("<p>unclosed <b>bold", "unclosed bold"), ("<p>x</p></div></article>y", "x\ny"), ("<script>never closed <p>x", ""),
    ("<p title='a > b'>x</p>", "x"), ("<div hidden>no</div><p>yes", "yes"), ("<p>a<span>b</span>c</p>", "abc"), ("<P>Upper</P><BR/>lower", "Upper\nlower"), ("<![CDATA[data]]><p>x", "data\nx"), ("<!-- never closed <p>x", ""),
    ("<main><p>in</p></main><p>out</p>", "in"), ("<div role=navigation>n</div>x", "x"), ("<p>&#x1F600; &bogus; &amp;amp;</p>", "😀 &bogus; &amp;"), ("<div class='content-with-sidebar'><p>x</p></div>", "x"),
    ("<p>out</p><div id=Content><p>in</p></div>", "in"), ("<div class=content><p>out</p><article>in</article></div>", "in"), ("<article class='post comments-open'>in</article>", "in"),
])
def test_small_pages(html, text):
    assert sitetree.Page(html).text() == text


def site(n, host="h.example"):
    rng = random.Random(8)
    words = lambda k: " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(2, 9) for _ in range(k))
    pages, texts = [], []
    for i in range(n):
        body = [words(20) for _ in range(3)]
        promo = f"<div class=box><p>Our great offers</p><p>Call us {'today' if i % 2 else 'now'}</p></div>"
        pages.append((i, f"https://{host}/{i}", f"<html><body><div class=top><span>Daily words</span></div><div class=text>{''.join(f'<p>{b}</p>' for b in body)}</div>{promo}</body></html>"))
        texts.append("\n".join(body))
    return pages, texts


def test_style_tree_cuts_what_a_site_repeats(spark):
    pages, texts = site(30)
    few, _ = site(3, "other.example")
    df = spark.createDataFrame([*pages, *[(100 + i, u, h) for i, u, h in few], (200, "https://h.example/copy", pages[0][2])], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitetree.extract(df).collect()}
    assert [got[i] for i in range(30)] == texts and got[200] == texts[0]
    assert "Our great offers" in got[100]  # too few pages to tell
    # Without room for an array of cut nodes each page gets its own by a join: the same texts.
    assert {r["page_id"]: r["text"] for r in sitetree.extract(df, held=0).collect()} == got


def brute_scores(pages):
    """{node: (pages, importance, score)} of [(html, root)] by plain loops."""
    trees, above, expected = {}, {}, {}
    for html, root in sorted(set(pages), key=str):
        for node, (up, e, forms, contents) in sitetree.page_nodes(sitetree.Page(html), root).items():
            trees.setdefault(node, []).append((forms, contents))
            above[node], expected[node] = up, e
    own = {}
    for node, shown in trees.items():
        forms = Counter(f for fs, _ in shown for f in fs)
        blocks = Counter(x for _, cs in shown for x in cs)
        n, m = len(shown), sum(forms.values())
        base = math.log(max(n, m, 1))
        entropy = -sum(c / m * math.log(c / m) for c in forms.values()) / base if base > 0 and m else 1.0
        spread = 1 - sum(c * math.log(c) for c in blocks.values()) / sum(blocks.values()) / math.log(n) if n > 1 and blocks else 1.0
        own[node] = ((1 - sitetree.DECAY) * m, entropy, sum(blocks.values()), spread)
    out = {}
    for node, shown in trees.items():
        total = weight = 0.0
        for below, (m, entropy, s, spread) in own.items():
            chain = [below, *above[below]]
            if node in chain:
                d = sitetree.DECAY ** chain.index(node)
                total, weight = total + d * (m * entropy + s * spread), weight + d * (m + s)
        importance = 1.0 if len(shown) < sitetree.PAGES else total / weight if weight else 0.0
        out[node] = (len(shown), importance, sitetree.TOLD * expected[node] + (1 - sitetree.TOLD) * importance)
    return out


def test_scores_equal_brute_force(spark, rows_of):
    pages = [(u, h) for _, u, h in rows_of("pages", "page_id, url, html")] + [("https://h.example/x", h) for _, _, h in site(12)[0]] + [("https://h.example/x", ARTICLE.replace("Menu", f"Menu {i % 3}")) for i in range(9)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    roots = [r["root"] for r in sitetree._rows(df).orderBy("page_id").collect()]
    want = brute_scores([(h, r) for (_, h), r in zip(pages, roots, strict=True)])
    got = {r["node"]: (r["pages"], r["importance"], r["score"]) for r in sitetree.node_scores(sitetree.tree_nodes(df)).collect()}
    assert set(got) == set(want) and len({round(w[1], 3) for w in want.values()}) > 5
    for node, (n, importance, score) in want.items():
        assert got[node][0] == n and abs(got[node][1] - importance) < 1e-9 and abs(got[node][2] - score) < 1e-9


def test_the_tree_decides_on_the_tables(spark, rows_of):
    """With nothing cut from the tree, menus, adverts and footers come back on every page."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    with_tree = {r["page_id"]: r["text"] for r in sitetree.extract(pages).collect()}
    without = {r["page_id"]: r["text"] for r in sitetree.extract(pages, cut=-1.0).collect()}
    assert all(len(without[k]) > len(with_tree[k]) and with_tree[k] in without[k] for k in with_tree)
    assert all(n.startswith("body|") for n in sitetree.Page(pages.first()["html"]).names()[:1])


def test_entropies_decide_about_plain_containers(spark):
    """The same markup, of which the site repeats one part and varies the other."""
    page = lambda i: f"<div class=a><p>Words of page {i} alone</p></div><div class=b><p>Call us {i % 2}</p></div>"
    docs = spark.createDataFrame([(i, "https://s.example/", page(i)) for i in range(20)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in sitetree.extract(docs).collect()} == {i: f"Words of page {i} alone" for i in range(20)}


def test_entropies_decide_about_parts_of_articles(spark):
    """A box in all articles of a site is cut; a table stays where articles are copies or near copies, or pages too few."""
    rng = random.Random(5)
    words = lambda: " ".join(rng.choice("abcdefghijklmnop") * rng.randrange(2, 9) for _ in range(20))
    pages, texts = [], []

    def add(host, title, lines, facts, box="", menu=""):
        body = "".join(f"<p>{x}</p>" for x in lines)
        table = "".join(f"<tr><td class=k>{a}</td><td class=v>{b}</td></tr>" for a, b in facts)
        notice = f"<div class=box><p>{box}</p></div>" if box else ""
        pages.append((len(pages), f"https://{host}/", f"<nav>{menu}</nav><article><h1>{title}</h1><div class=a>{body}</div>{notice}<table>{table}</table>Last of {title}</article><footer>f</footer>"))
        texts.append("\n".join([title, *lines, *[x for f in facts for x in f], f"Last of {title}"]))

    same, near = [words() for _ in range(10)], [words() for _ in range(10)]
    for i in range(20):
        add("boxes", f"t {i}", [words() for _ in range(3)], [("Price", f"{i} coins"), ("Weight", f"{i} stones")], "Our great offers", f"m {i}")
        add("copies", "t", same, [("Price", "9")], menu=f"m {i}")
        add("near", f"t {i}", [words() if k == i % 10 else x for k, x in enumerate(near)], [("Price", "9")])
        # Near copies alone have a table on this host, whose other articles differ.
        add("mixed", f"t {i}", [words() if k == i % 10 and i < 8 else x for k, x in enumerate(near if i < 8 else [words(), words()])], [("Price", "9")] if i < 8 else [])
        add("titles", f"t {i}", same, [])  # the greater part of an article repeats
        add("seldom", f"t {i}", [words()], [("Price", "9")] if i < sitetree.PAGES - 1 else [])  # the table is empty elsewhere
    for i in range(sitetree.PAGES - 1):
        add("few", f"t {i}", [words()], [("Price", "9")])
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitetree.extract(df).collect()}
    assert [got[i] for i in range(len(texts))] == texts
    assert {r["page_id"]: r["text"] for r in sitetree.extract(df, held=0).collect()} == got
    # The page's own word alone would keep the boxes, whose score comes from their importance.
    scores = sitetree.node_scores(sitetree.tree_nodes(df))
    assert "Our great offers" in sitetree.Page(pages[0][2]).text() and scores.where("pages = 20 and importance = 0 and rest > 0.9").count() == 1


def brute_rests(page, root):
    own, blocks = sitetree.hashes(page, root)[0], [(at, t) for at, t in page.blocks if page.role(page.nodes[at], True) == "article"]
    out, size = {}, sum(len(t) for _, t in blocks)
    above = lambda k: {own[k]} | (above(page.nodes[k].above) if k else set())
    for key in {own[k] for k, n in enumerate(page.nodes) if page.role(n) == "part"}:
        rest = [t for at, t in blocks if key not in above(at)]
        if len(rest) < len(blocks):
            least = 2 * sum(map(len, rest)) < size
            out[key] = list(range(sitetree.SLOTS)) if least else [min(x) for x in zip(*map(sitetree.slots, rest), strict=True)]
    return out


def test_rests_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        tags = [rng.choice(["<div>", "<div class=x>", "<section>", "</div>", "</section>", "<ul><li>", "</ul>", "<span>", "</span>", "<nav>", "</nav>", "<table><tr><td>", "</table>", "<p>", "<main>", "</main>"]) for _ in range(rng.randrange(40))]
        page = sitetree.Page("<p>before<article>" + "".join(t + rng.choice(["", "w" * rng.randrange(1, 9)]) for t in tags) + rng.choice(["", "</article>after"]))
        assert sitetree.page_rests(page, 7) == brute_rests(page, 7)


def test_deep_pages_have_no_limit(spark):
    deep = lambda i: "<div class=a>" * 3_000 + f"<p>deep {i}</p>" + "</div>" * 3_000 + "<nav>menu</nav><article><p>main</p></article>"
    docs = spark.createDataFrame([(1, None, deep(1)), (2, "x", "<div>" * 2_000 + "plain words"), (3, "y", "<article>" + "<div>" * 2_000 + "deep main" + "</div>" * 2_000 + "</article><p>out"), (4, "z", "<p>" + "long " * 1_000_000)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitetree.extract(docs).collect()}
    assert (got[1], got[2], got[3]) == ("main", "plain words", "deep main") and len(got[4]) == 4_999_999


def test_pages_query(spark, odd, none, rows_of):
    got = {r["page_id"]: r for r in sitetree.op1_html(spark, DATA).collect()}
    pages = rows_of("pages", "page_id, url, html")
    assert set(got) == {p[0] for p in pages}
    for page_id, url, html in pages:
        r = got[page_id]
        assert (r["url"], r["n_chars"]) == (url, len(r["text"]))
        inside = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        assert r["text"].split("\n")[0] == " ".join(sitetree.entities.unescape(re.search(r"<h1>(.*?)</h1>", inside, re.S)[1]).split())
        plain = " ".join(sitetree.entities.unescape(re.sub(r"<[^>]+>", " ", inside)).split())
        assert re.sub(r"\s", "", r["text"]) == re.sub(r"\s", "", plain)
    strange = odd.select("doc_id", "text", "k", "g").toDF("page_id", "html", "url", "host").withColumn("noise", F.lit("x")).withColumn("root", F.lit("r")).withColumn("same", F.lit("s"))
    assert sitetree.extract(strange).count() == odd.count() and sitetree.extract(strange.where("false")).count() == 0


# -- archives


def test_records_come_back_byte_for_byte(spark, odd, none):
    pages = odd.select("doc_id", "text", "k", "source").toDF("page_id", "html", "digest", "url").unionByName(spark.createDataFrame([(900, "same", "d", "http://a b"), (901, "same", "d", None), (902, "same", "d", "u"), (None, "same", None, None)], "page_id long, html string, digest string, url string"))
    folder = new_folder(spark, "warc")
    warc.write_archive(pages, folder)
    records = warc.read_records(spark, folder)
    told = {r["page_id"]: r for r in warc.parse_records(records).collect() if r["page_id"] is not None}
    by_text, inputs = defaultdict(list), pages.collect()
    for r in inputs:
        by_text[r["html"] or ""].append(r["page_id"])
    for r in inputs:
        if r["page_id"] is None:
            continue
        data, keeper = (r["html"] or "").encode(), max(p for p in by_text[r["html"] or ""] if p is not None)
        t = told[r["page_id"]]
        assert (t["payload_bytes"], t["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (t["record_type"], t["refers_to"]) == (("response", None) if r["page_id"] == keeper else ("revisit", keeper))
    for r in records.collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        payload = rest[:-4].partition(b"\r\n\r\n")[2]
        assert payload == (bytes(r["payload"]) if r["payload"] is not None else b"")
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    assert len(spark.read.parquet(f"{folder}/payloads").collect()) == len(by_text)  # each payload once
    empty = new_folder(spark, "warc")
    warc.write_archive(pages.where("false"), empty)
    assert warc.parse_records(warc.read_records(spark, empty)).count() == 0


def test_short_payloads_are_all_responses(spark):
    pages = spark.createDataFrame([(1, "ab", "u"), (2, "ab", "u"), (3, "long one", "u"), (4, "long one", "u")], "page_id long, html string, url string")
    heads, _ = warc.archive(pages, least_bytes=5)
    assert sorted((r["page_id"], r["carries"]) for r in heads.collect()) == [(1, True), (2, True), (3, False), (4, True)]


def test_damage_is_found(spark):
    folder = new_folder(spark, "warc")
    warc.write_archive(spark.createDataFrame([(1, "a", "u")], "page_id long, html string, url string"), folder)
    spark.read.parquet(f"{folder}/payloads").withColumn("payload", F.lit("b").cast("binary")).coalesce(1).write.parquet(f"{folder}/bad")
    heads = spark.read.parquet(f"{folder}/heads")
    other = new_folder(spark, "warc")
    heads.write.parquet(f"{other}/heads")
    spark.read.parquet(f"{folder}/bad").write.parquet(f"{other}/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_records(spark, other).collect()


def test_revisits_find_their_payload_and_files_hold_all_records(spark):
    rows = [(k, "http://a/", f"page {k % 7} é" if k % 3 else "") for k in range(60)]
    folder = new_folder(spark, "warc")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = warc.whole_pages(spark, folder, part=5).collect()
    assert sorted((r["page_id"], bytes(r["payload"]).decode()) for r in got) == sorted((k, h) for k, _, h in rows)
    records = warc.read_records(spark, folder)
    files = warc.write_files(records, new_folder(spark, "files")).collect()
    assert sum(r["n_records"] for r in files) == 60
    data = b"".join(gzip.open(r["path"].removeprefix("file://")).read() for r in files)
    seen, at = set(), 0
    while at < len(data):  # a reader of its own: lines up to the empty one, then as many bytes as they say
        end = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:end].decode().split("\r\n")
        fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        body = data[end + 4 : end + 4 + int(fields["content-length"])]
        at = end + 4 + len(body)
        assert version == "WARC/1.1" and data[at : at + 4] == b"\r\n\r\n" and body.startswith(b"HTTP/1.1 200 OK\r\n")
        at += 4
        k = int(fields["warc-record-id"][len("<urn:x-page:") : -1])
        seen.add(k)
        if fields["warc-type"] == "response":
            assert body.partition(b"\r\n\r\n")[2] == rows[k][2].encode()
        else:
            assert rows[int(fields["warc-refers-to"][len("<urn:x-page:") : -1])][2] == rows[k][2]
    assert seen == set(range(60))


def test_warc_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{DATA}/pages.parquet')")
    want = sorted(map(str, con.sql(warc.OP6_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in warc.op6_warc(spark, DATA).collect()) == want


# -- audio


def tune(seed, notes=40):
    rng = np.random.default_rng(seed)
    return chroma.melody(rng.normal(0, 0.2, notes))


def test_integral_image_filters_against_plain_sums():
    samples = tune(1, 20)
    picture, codes = chroma.chroma(samples), chroma.fingerprint(samples)
    assert len(codes) == len(picture) - chroma.WIDEST + 1
    for t in (0, 5, len(codes) - 1):
        out = 0
        for shape, p, high, wide in chroma.FILTERS:
            part = picture[t : t + wide].astype(np.float64)
            area = lambda a, b, c, d: part[a:b, c:d].sum()  # noqa: E731, B023
            every, third = area(0, wide, p, p + high), high // 3
            one, other = {
                "all": lambda: (every, area(0, wide, 0, 12) * high / 12),  # noqa: B023
                "pitch": lambda: (area(0, wide, p, p + high // 2), area(0, wide, p + high // 2, p + high)),  # noqa: B023
                "time": lambda: (area(0, wide // 2, p, p + high), area(wide // 2, wide, p, p + high)),  # noqa: B023
                "cross": lambda: (area(0, wide // 2, p, p + high // 2) + area(wide // 2, wide, p + high // 2, p + high), area(0, wide // 2, p + high // 2, p + high) + area(wide // 2, wide, p, p + high // 2)),  # noqa: B023
                "bands": lambda: ((m := area(0, wide, p + third, p + 2 * third)), (every - m) / 2),  # noqa: B023
                "slices": lambda: ((m := area(wide // 3, 2 * (wide // 3), p, p + high)), (every - m) / 2),  # noqa: B023
            }[shape]()
            level = sum(np.log((1 + one) / (1 + other)) > c for c in chroma.CUTS)
            out = out << 2 | (0, 1, 3, 2)[level]
        assert bin(int(codes[t]) ^ out).count("1") <= 1  # sums differ in the last digits


def test_alignment_finds_the_offset():
    whole = tune(2, 80)
    a = chroma.fingerprint(whole)
    rng = np.random.default_rng(0)
    shift = 30
    part = whole[shift * chroma.HOP : shift * chroma.HOP + 60 * chroma.NOTE] + rng.normal(0, 0.02, 60 * chroma.NOTE).astype(np.float32)
    votes, offset, error = chroma.align(a, chroma.fingerprint(part))
    assert offset == shift and error < 0.05 and votes > 20
    louder = chroma.align(a, chroma.fingerprint(whole * 3))
    assert louder[1:] == (0, 0.0) or louder[2] < 0.01
    assert chroma.align(a, chroma.fingerprint(tune(3, 80)))[2] > chroma.MATCH
    assert chroma.align(a, np.zeros(0, np.uint32))[2] == 1.0 and len(chroma.fingerprint(np.zeros(10))) == 0
    assert chroma.bit_error(a, a, len(a)) == 1.0


def test_one_equal_integer_is_no_match_and_long_recordings_align():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 1 << 32, n, dtype=np.uint32) for n in (200, 200))
    b[190] = a[5]
    assert chroma.align(a, b)[:2] == (1, -185) and not chroma.is_match(200, 200, 1, -185, 0.1)
    assert not chroma.is_match(200, 200, 9, 195, 0.0) and chroma.is_match(200, 5, 3, 0, 0.1) and chroma.is_match(2, 200, 2, -7, 0.0) and not chroma.is_match(200, 200, 9, 0, 0.31)
    long = rng.integers(0, 1 << 32, 1_400_000, dtype=np.uint32)
    assert chroma.align(long, long[1_300_000:1_300_100]) == (100, 1_300_000, 0.0)


@pytest.mark.parametrize("split", [2, 2_000])
def test_frequent_integers_are_dealt_to_cells(spark, split):
    """Recordings that share a held note in all places, as brute force sees them."""
    rng = np.random.default_rng(1)
    codes = {k: np.where(rng.random(60) < 0.8, 77, rng.integers(0, 1 << 32, 60)).astype("<u4") for k in range(0, 700, 50)}
    codes[999] = codes[100][10:].copy()
    prints = spark.createDataFrame([(k, len(v), bytearray(v.tobytes())) for k, v in codes.items()], "rec_id long, n_codes long, codes binary")
    got = {(r["class_id"], r["match_id"]): (r["votes"], r["offset"]) for r in chroma.match_recordings(prints, lambda i: i % 100 == 0, split).collect() if r["matched"]}
    want = {}
    for c, a in codes.items():
        for q in range(0, 700, 100):
            votes, offset, error = chroma.align(a, codes[q])
            if q != c and chroma.is_match(len(a), len(codes[q]), votes, offset, error):
                want[c, q] = votes, offset
    assert got == want and got[999, 100] == (50, -10) and len(want) > 20


def test_search_equals_pairwise_alignment(spark):
    rng = np.random.default_rng(5)
    tunes = {i: rng.normal(0, 0.2, 40) for i in range(0, 40)}
    tunes[50] = np.concatenate([rng.normal(0, 0.2, 6), tunes[0][:34]])
    tunes[51] = tunes[3]
    rows = [(k * 50, v.tolist()) for k, v in tunes.items()] + [(7, None), (9, []), (None, tunes[0].tolist()), (11, [None, float("nan")] + [0.1] * 30), (0, tunes[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    prints = chroma.fingerprints(df, "vec_id", chroma.melody, "embedding")
    got = chroma.match_recordings(prints, lambda i: i % 100 == 0).collect()
    assert len(got) == len(rows)
    codes = {r["rec_id"]: np.frombuffer(r["codes"], "<u4") for r in prints.collect() if r["rec_id"] is not None and r["n_codes"]}
    found = {r["rec_id"]: r for r in got}
    for r in got:
        if r["rec_id"] is None:
            assert (r["class_id"], r["match_id"]) == (found[0]["class_id"], found[0]["match_id"])  # equal codes are one class
            continue
        if r["rec_id"] not in codes:
            assert r["match_id"] is None and not r["matched"]
            continue
        a, best, matches = codes[r["class_id"]], None, 0
        for q in sorted(codes):
            if q % 100 == 0 and q != r["class_id"] and codes[q].tobytes() != a.tobytes():
                votes, offset, error = chroma.align(a, codes[q])
                matches += chroma.is_match(len(a), len(codes[q]), votes, offset, error)
                if chroma.is_match(len(a), len(codes[q]), votes, offset, error) and (best is None or (error, -votes, q) < best[:3]):
                    best = (error, -votes, q, offset)
        assert (r["match_id"], r["votes"], r["offset"]) == ((best[2], -best[1], best[3]) if best else (None, None, None))
        assert r["n_matches"] == matches and r["matched"] == (matches > 0)
    assert found[2500]["match_id"] == 0 and found[2500]["matched"] and abs(found[2500]["offset"] - 12) <= 1
    assert found[2550]["class_id"] == 150


def test_all_matches_of_a_class_are_returned(spark):
    rng = np.random.default_rng(8)
    tune = rng.normal(0, 0.2, 60)
    # Near copies of one tune, of which five are queries, an exact copy of one of them, and another tune.
    tunes = {k: np.concatenate([rng.normal(0, 0.2, n), tune[: 60 - n]]) for k, n in ((100, 0), (200, 2), (300, 4), (400, 6), (500, 8), (7, 3), (8, 5))}
    tunes |= {9: tunes[7], 11: rng.normal(0, 0.2, 60), 600: rng.normal(0, 0.2, 60)}
    df = spark.createDataFrame([(k, v.tolist()) for k, v in tunes.items()], "vec_id long, embedding array<double>")
    prints = chroma.fingerprints(df, "vec_id", chroma.melody, "embedding")
    codes = {r["rec_id"]: np.frombuffer(r["codes"], "<u4") for r in prints.collect()}
    got = chroma.match_recordings(prints, lambda i: i % 100 == 0).collect()
    expected = {}
    for c in sorted(set(codes) - {9}):
        for q in range(100, 700, 100):
            votes, offset, error = chroma.align(codes[c], codes[q])
            if q != c and chroma.is_match(len(codes[c]), len(codes[q]), votes, offset, error):
                expected[c, q] = votes, offset
    of_classes = [r for r in got if r["matched"] and r["rec_id"] == r["class_id"]]
    assert {(r["class_id"], r["match_id"]): (r["votes"], r["offset"]) for r in of_classes} == expected and len(of_classes) == len(expected)
    assert {q for c, q in expected if c == 7} == {100, 200, 300, 400, 500} and {c for c, q in expected if q == 300} == {100, 200, 400, 500, 7, 8}
    assert {r["rec_id"] for r in got} == set(tunes) and [r["class_id"] for r in got if r["rec_id"] == 9] == [7]


def test_recordings_with_clashing_columns(spark):
    df = spark.createDataFrame([(k, [0.1 * k, 0.2] * 20, k, "x", "y") for k in range(5)], "vec_id long, embedding array<double>, rec_id int, codes string, place string")
    got = chroma.match_recordings(chroma.fingerprints(df, "vec_id", chroma.melody, "embedding"), lambda i: i % 100 == 0)
    assert got.count() == 5 and got.where("rec_id is null").count() == 0


def test_pcm_and_empty_media(spark):
    sound = (tune(4) * 20_000).astype("<i2")
    df = spark.createDataFrame([(1, bytearray(sound.tobytes())), (2, bytearray(b"")), (3, bytearray(b"\x01")), (4, None)], "id long, media binary")
    got = {r["rec_id"]: r["n_codes"] for r in chroma.fingerprints(df, "id", chroma.pcm16, "media").collect()}
    assert got[1] > 50 and got[2] == got[3] == got[4] == 0
    assert chroma.match_recordings(chroma.fingerprints(df.where("false"), "id", chroma.pcm16, "media"), lambda i: i % 100 == 0).count() == 0
