"""HTML extraction, packing, WARC, SentencePiece, language ID and top-k search, each against brute force, an exact round trip or held-out accuracy."""

import hashlib
import io
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import html_extract, language_id, packing, sentencepiece_codec, top_k, warc
from quillspark.llm.common import new_path

random.seed(11)
DOCS, PAGES = "doc_id long, text string", "page_id long, url string, html string"
VOCABULARY = packing.vocabulary_path(packing.VOCABULARY)
ODD = ["", None, " ", "a  b", "\n a", "x" * 5000, "<|endoftext|> x  <|endoftext|>", "it's  we'll", "é ß 漢字 🙂", "</s> <unk>", "a\x00b", "word " * 3000]


def test_html_article_only():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Head</header>
    <nav><ul><li>Menu</li></ul></nav><!-- c <p>no</p> --><div class="ad-box">Buy</div><aside>Side</aside><article><h1>One &amp; two</h1><p>First <b>bo</b>ld&nbsp;x
    <br>line<p>Second<div class="share">Tweet</div><form><input>Send</form><ul><li>i<li>j</ul></article><div id="comments"><p>Reader says a lot, really a lot, more than the article itself says.</p></div>
    <div class="cookie-notice">Cookies</div><footer>&copy;</footer></body>"""
    assert html_extract.main_text(page) == "One & two First bold x line Second i j"


@pytest.mark.parametrize("page", ["", None, "plain text", "<p>", "<", "<div", "<a href='x", "<!--", "<script>", "&#x110000;&amp", "<div>" * 3000 + "deep" + "</div>" * 10])
def test_html_broken(page):
    html_extract.main_text(page)


def test_html_votes(spark):
    good = '<body><div class="box7"><p>{}</p></div><div class="teaser"><p>{}</p></div></body>'
    pages = [(i, "http://h.example/x", good.format("article words here " * 9, "see")) for i in range(9)]
    pages += [(9, "http://h.example/y", good.format("short but it is the article", "a longer teaser that would win by itself, a little")), (10, None, None), (11, "nonsense", "<p>x</p>"), (11, "nonsense", "<p>x</p>")]
    frame = spark.createDataFrame(pages, PAGES).select("*", F.lit(0).alias("host"), F.lit(0).alias("HTML"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract(frame).collect()}
    assert got[9] == ("short but it is the article", 27) and got[10] == ("", 0) and got[11] == ("x", 1) and len(got) == 12
    counted = html_extract.votes(frame).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    assert html_extract.host_paths(counted).filter("host = 'h.example'").first().paths[0] == "body>div.box#"
    assert html_extract.extract(frame.limit(0)).count() == 0


LONG_TEXT = "words of the body " * 60


@pytest.mark.parametrize(
    "page, want",
    [
        ('<body><article><h1>T</h1><p>lead</p><div class="body"><p>{}</p></div></article><div class="teaser"><p>see</p></div></body>', "T lead {}"),
        ('<main><h1>T</h1><article><div class="a"><div class="b"><p>{}</p></div></div><p>end</p></article></main>', "T {} end"),
        ('<body><div class="post"><p>before</p><blockquote>{}</blockquote><p>after</p></div><div class="teaser">see</div></body>', "before {} after"),
        ('<body><div class="post"><p>before</p><table><tr><td>{}</td></tr></table></div></body>', "before {}"),
        ('<body><div class="post"><section class="a">{}</section><section class="b">more</section></div></body>', "{} more"),
        ('<body><div class="post"><div class="title"><h1>T</h1></div><div class="wrap"><div class="body">{}</div></div></div></body>', "T {}"),
        ('<p>lead</p><div class="body">{}</div>', "lead {}"),
        ('<body><div class="page"><a href="/">Home</a> | <a href="/b">More</a><div class="body">{}</div><div class="teaser">see</div></div></body>', "{}"),
        ('<body><article><p>lead</p><div class="share">Tweet</div><div class="body">{}</div><div id="comments">Nice</div></article></body>', "lead {}"),
    ],
)
def test_html_whole(spark, page, want):
    page, want = page.format(LONG_TEXT), " ".join(want.format(LONG_TEXT).split())
    assert html_extract.main_text(page) == want
    if "article" in page:
        frame = spark.createDataFrame([(i, f"http://h.example/{i}", page) for i in range(3)], PAGES)
        assert {r.text for r in html_extract.extract(frame).collect()} == {want}


@pytest.mark.parametrize(
    "page, want",
    [
        ('<body><form id="aspnetForm"><article><h1>T</h1><p>{}</p><form><label>Name</label><input>Send it</form></article></form></body>', "T {}"),
        ('<body><form id="f"><div class="main"><p>{}</p></div><div class="sidebar">Side</div></form></body>', "{}"),
        ('<body><div class="main"><p>{}</p></div><form><p>Your name and a message to us</p></form></body>', "{}"),
        ('<body><div class="layout-with-sidebar"><div class="post"><p>{}</p></div><div class="left-sidebar"><p>Side text</p></div></div></body>', "{}"),
        ('<body><div class="widget-area"><div class="post"><p>{}</p></div><div class="widget-area"><p>Side text</p></div></div></body>', "{}"),
        ('<article><p class="tags-intro">On tags.</p><p>{}</p><p class="table-widget">A table.</p><p class="tags">a, b</p><div class="share-buttons">Tweet</div><div class="ad-slot-7-special">Buy</div></article>', "On tags. {} A table."),
        ('<article><p>short</p></article><div class="sidebar"><p>{}</p></div><div class="user-comments"><p>{}</p></div>', "short"),
    ],
)
def test_html_weighs_names(page, want):
    assert html_extract.main_text(page.replace("{}", LONG_TEXT)) == " ".join(want.replace("{}", LONG_TEXT).split())


def test_html_in_linear_time():
    """Broken markup of a size, and of four times that size: no more than some eight times the time."""
    import time

    made = {
        "a": lambda n: "<a " * n, "quotes": lambda n: "<a " + '="' * n, "closed quotes": lambda n: "<a " + '="' * n + ">x", "spans": lambda n: "<span>x" * n,
        "unclosed": lambda n: "<b>" * n + "</i>" * n, "crossing": lambda n: "<i><div>" + "<b>" * n + "</i>" * n, "items": lambda n: "<div>" * n + "<li>x" * n,
        "odd quote": lambda n: "<a y " * n + '=">"', "comments": lambda n: "<!-- " * n, "less": lambda n: "<" * n, "slash": lambda n: "</" * n, "space": lambda n: "<a x" + (" " * 99 + "y") * n,
        "tables": lambda n: "<table><tr><td>" * n + "x", "raw": lambda n: "<title>x" * n, "number": lambda n: "&#" + "9" * n + ";", "references": lambda n: "&" * n,
    }

    def took(source):
        start = time.perf_counter()
        html_extract.main_text(source)
        return time.perf_counter() - start

    for name, make in made.items():
        few, many = min(took(make(5000)) for _ in range(3)), min(took(make(20000)) for _ in range(2))
        assert many < 8 * few + 0.2, name
    assert took("<a " + '="' * 32) < 0.1
    assert html_extract.main_text("<p>&#" + "9" * 6000 + ";") == "\ufffd"


def _built(rng):
    """A page of known parts, in correct markup, and the text of its article."""
    say = lambda n: " ".join(rng.choice(["word", "été", "x&y", "a<b", "漢字", "end."]) for _ in range(n))
    esc = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace("é", rng.choice(["é", "&eacute;", "&#233;", "&#xE9;"])).replace(" ", rng.choice([" ", "\n ", "&nbsp;"]))
    blocks, want = [], []
    for _ in range(rng.randint(1, 6)):
        t, u = say(rng.randint(8, 30)), say(3)
        kind = rng.randint(0, 4)
        if kind == 0:
            blocks.append(f"<p>{esc(t)}</p>")
        elif kind == 1:
            blocks.append(f"<p>{esc(t)} <b>{esc(u)}</b><i>!</i><br/>{esc(u)}")
            t = f"{t} {u}! {u}"
        elif kind == 2:
            blocks.append(f"<ul><li>{esc(t)}<li>{esc(u)}</ul>")
            t = f"{t} {u}"
        elif kind == 3:
            blocks.append(f"<h2 class='t{rng.randint(0, 9)}'>{esc(u)}</h2><blockquote>{esc(t)}</blockquote>")
            t = f"{u} {t}"
        else:
            blocks.append(f"<table><tr><td>{esc(t)}<td>{esc(u)}</table>")
            t = f"{t} {u}"
        want.append(t)
        blocks.append(rng.choice(["", f"<!-- {say(3)} -->", f"<div class='share-buttons'>{esc(say(2))}</div>", f"<aside>{esc(say(9))}</aside>", f"<script>if (a<b) '<p>{say(2)}</p>'</script>", f"<form><p>{esc(say(5))}</p></form>"]))
    other = [f"<nav><a href='/a'>{esc(say(2))}</a></nav>", f"<header>{esc(say(4))}</header>", f"<div class='ad'>{esc(say(20))}</div>", f"<section id='comments'><p>{esc(say(40))}</p></section>", f"<div role=\"navigation\">{esc(say(3))}</div>", f"<footer>&copy; {esc(say(4))}</footer>"]
    rng.shuffle(other)
    cut = rng.randint(0, len(other))
    return f"<!DOCTYPE html><html><head><title>{esc(say(3))}</title></head><body>{''.join(other[:cut])}<article>{''.join(blocks)}</article>{''.join(other[cut:])}</body></html>", " ".join(want)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_html_of_built_pages(spark, sent):
    """Pages whose article is known by construction; a host with most of the pages, paths sent to the pages or joined by salted hosts."""
    rng = random.Random(5)
    built = [_built(rng) for _ in range(400)]
    rows = [(i, f"http://{'hot' if i % 4 else i}.example/{i}", page) for i, (page, _) in enumerate(built)]
    got = html_extract.extract(spark.createDataFrame(rows, PAGES), sent=sent).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(i, t, len(t)) for i, (_, t) in enumerate(built)]


def test_plan_fills_sequences():
    for _ in range(30):
        capacity = random.choice([7, 16, 100])
        lengths = [random.randint(1, capacity) for _ in range(random.randint(0, 300))]
        held = Counter()
        spots = set()
        for length, rank, first, offset, each in packing.plan(Counter(lengths), capacity):
            after = min((r for l, r, *_ in packing.plan(Counter(lengths), capacity) if l == length and r > rank), default=Counter(lengths)[length])
            for r in range(rank, after):
                s, at = first + (r - rank) // each, offset + (r - rank) % each * length
                held[s] += length
                for x in range(at, at + length):
                    assert x < capacity and (s, x) not in spots
                    spots.add((s, x))
        assert sum(held.values()) == sum(lengths) and len(spots) == sum(lengths)
        assert all((s, x) in spots for s in held for x in range(held[s]))
        bins = []  # best fit decreasing, one piece at a time
        for length in sorted(lengths, reverse=True):
            room = min((b for b in bins if b >= length), default=None)
            if room is None:
                bins.append(capacity - length)
            else:
                bins[bins.index(room)] = room - length
        assert len(held) == len(bins)


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    texts = ODD + [" ".join(random.choice(["alpha", "beta,", "gamma\n"]) for _ in range(random.randint(1, 400))) for _ in range(60)]
    frame = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "null id")], DOCS).select("*", F.lit(0).alias("length"), F.lit(0).alias("rank"))
    rows = packing.pack(frame, VOCABULARY).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    mine = {(r.doc_id, r.piece): r for r in rows}
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = k = 0
        while at < len(ids):
            r = mine[i, k]
            assert r.start == at and (r.length == 1024 or k == 0) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at, k = at + r.length, k + 1
    assert sum(r.doc_id == 3 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert packing.pack(frame.limit(0), VOCABULARY).count() == 0


def test_packing_long_white_space(spark):
    coder = packing.Encoder(VOCABULARY)
    assert coder.by_rank
    space = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000"
    texts = [" " * 2_000_000, "a" + "\n" * 1_000_000 + "b", " \n" * 600_000 + "'s x" + "\r" * 1_100_000 + "\u3000", space * 70_000 + "é", "  a" + " " * 99_999 + "b \n" + " " * 100_000 + "1", "\x1c" * 120_000 + "  x"]
    want = [np.array([*coder.tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for t in texts]
    for text, ids in zip(texts, want, strict=True):
        assert coder.of(text) == ids[:-1].tobytes()
    rows = packing.pack(spark.createDataFrame([(0, texts[0]), (1, texts[1]), (2, "short")], DOCS), VOCABULARY).collect()
    for i in range(2):
        mine = sorted((r.start, r.length, r.ids_crc32) for r in rows if r.doc_id == i)
        assert sum(n for _, n, _ in mine) == len(want[i]) and all(c == zlib.crc32(want[i][a : a + n].tobytes()) for a, n, c in mine)
    assert any(r.doc_id == 2 for r in rows)


def test_sentencepiece(spark):
    import sentencepiece

    path = packing.vocabulary_path(sentencepiece_codec.MODEL)
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ODD + ["".join(random.choice("ab1 \n\t'.é \xa0漢") for _ in range(random.randint(1, 40))) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), DOCS).select("*", F.lit(0).alias("ids"))
    rows = sentencepiece_codec.encoded(frame, path)
    for r in rows.collect():
        assert r.ids == theirs.encode(texts[r.doc_id] or "")
    assert {r.doc_id: r.text for r in sentencepiece_codec.decoded(rows, path).collect()} == {i: theirs.decode(theirs.encode(t or "")) for i, t in enumerate(texts)}
    for r in sentencepiece_codec.checked(frame, path).collect():
        ids = theirs.encode(texts[r.doc_id] or "")
        assert (r.n_ids, r.ids_crc32, r.parity) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
        assert r.round_trip == (theirs.decode(ids) == (texts[r.doc_id] or ""))
    assert sentencepiece_codec.checked(frame.limit(0), path).count() == 0
    assert sentencepiece_codec.Codec(path, verify=False).agrees("a", np.array([5], "<u4")) is None
    coder = sentencepiece_codec.Codec(path)
    for wrong in ([5], [5, 5]):
        assert coder.agrees("ends in spaces  ", np.array(wrong, "<u4")) is False
    odd = [theirs.encode("a </s> b"), [1, *theirs.encode("x y"), 2], [0], []]
    assert coder.decode_batch(odd) == [coder.decode(x) for x in odd]
    assert coder.tokenizer.decode(theirs.encode("Hi é 🙂 there")) == "Hi é 🙂 there"


def test_sentencepiece_unigram(tmp_path):
    """A unigram model, written here field by field."""
    import struct

    import sentencepiece

    def field(n, kind, body):
        def varint(x):
            out = b""
            while x > 127:
                out, x = out + bytes([x & 127 | 128]), x >> 7
            return out + bytes([x])

        return varint(n << 3 | kind) + (varint(body) if kind == 0 else varint(len(body)) + body if kind == 2 else body)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{i:02X}>", -20.0, 6) for i in range(256)), ("▁", -3.0, 1), ("▁the", -2.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1), ("▁a", -4.2, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, t)) for p, s, t in pieces)
    data += field(2, 2, field(3, 0, 1) + field(35, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_codec.Codec(str(path))
    for t in ("the ab a", "abab", "é the", ""):
        assert ours.encode([t])[0].tolist() == theirs.encode(t) and ours.decode(theirs.encode(t)) == theirs.decode(theirs.encode(t))


def test_sentencepiece_parity_of_normalised(tmp_path):
    """A model that squeezes white space: right ids agree, wrong ones don't."""
    import struct

    def field(n, kind, body):
        return bytes([n << 3 | kind]) + (bytes([body]) if kind == 0 else bytes([len(body)]) + body if kind == 2 else body)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -3.0, 1), ("▁the", -2.0, 1), ("a", -4.0, 1), ("b", -4.5, 1), ("ab", -5.0, 1), ("▁a", -4.2, 1)]
    data = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, t)) for p, s, t in pieces)
    data += field(2, 2, field(3, 0, 1)) + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 1) + field(5, 0, 1))
    path = tmp_path / "s.model"
    path.write_bytes(data)
    coder = sentencepiece_codec.Codec(str(path), True)
    assert coder.squeeze and all(coder.agrees(t, coder.encode([t])[0]) for t in ("the  ab a", " abab ", ""))
    assert not coder.agrees("the  ab", np.array([5, 5], "<u4"))


def members(records):
    return b"".join(records)


def test_warc_splits_agree_at_every_size():
    nested = warc.record(5, "u", b"inner " * 20, "d", None, False)
    payloads = [b"x" * i for i in (0, 1, 99, 5000)] + [random.randbytes(3000), nested, nested + nested, b"\x1f\x8b\x08" * 50]
    data = b"".join(warc.record(i, f"http://e/{i}\r\n", p, hashlib.sha256(p).hexdigest(), None, False) for i, p in enumerate(payloads))

    class File(io.BytesIO):
        def read_at(self, n, at):
            return self.getbuffer()[at : at + n].tobytes()

    for split in (1, 7, 100, 1000, len(data)):
        got = [p for a in range(0, len(data), split) for _, _, p in warc.records_in(File(data), len(data), a, min(a + split, len(data)))]
        assert got == payloads
        assert payloads == [p for a in range(0, len(data), split) for _, _, p in warc.records_in(File(data), len(data), a, min(a + split, len(data)), held=100)]
    with pytest.raises(ValueError):
        list(warc.records_in(File(data[:-5]), len(data) - 5, 0, len(data) - 5))


def test_warc(spark):
    long = "é" * 60
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, "short"), (4, "x", "short"), (5, "x", None), (6, "x", ""), (7, "y", "<p>" + "z" * 200), (None, "n", long), (2, "http://b", long), (1, "again", long)]
    frame = spark.createDataFrame(rows, PAGES).select("*", F.lit(0).alias("digest"), F.lit(0).alias("first"))
    got = warc.read(spark, warc.write(frame, new_path(spark, "t")), split=50)
    want = []
    for i, url, h in rows:
        data = (h or "").encode()
        again = h == long and i != 1
        want.append((i, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert warc.read(spark, warc.write(frame.limit(0), new_path(spark, "t"))).count() == 0


def test_language(spark):
    words = {"en": "the and that with from this have", "fr": "le la des avec pour dans être", "de": "der und nicht für über mit ein"}
    rows = [(i, " ".join(random.choice(words[k].split()) for _ in range(40)), k) for i in range(400) for k in [random.choice(list(words))]]
    odd = [(1000, None, "en"), (1001, "", None), (1002, "123 !? \n", "fr"), (None, "der und nicht", "de"), (1003, "the and that", None)]
    frame = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").select("*", F.lit(0).alias("score"), F.lit("x").alias("held_out"))
    model = language_id.fitted(frame)
    assert (np.count_nonzero(model.table) < model.table.size / 50) and model.temperature > 0
    got = {r.doc_id: r for r in language_id.predicted(frame, model).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} >= set(held) and len(held) > 50
    truth = {i: k for i, _, k in rows}
    assert np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.95
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002)) and got[None].lang_pred == "de" and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in got.values())
    alone = model.predict([rows[0][1]])
    assert model.predict([r[1] for r in rows])[1][0] == pytest.approx(alone[1][0])
    empty = language_id.fitted(frame.limit(0))
    assert {r.lang_pred for r in language_id.predicted(frame, empty).collect()} == {"und"}
    one = language_id.fitted(frame.filter("lang = 'fr'"))
    assert {r.lang_pred for r in language_id.predicted(frame, one).collect()} == {"und", "fr"}
    assert language_id.predicted(frame.limit(0), model).count() == 0
    kept = language_id.accepted(frame, model, 0.5)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.select("doc_id").collect()} >= set(truth)


def ftrl_plain(rows, languages, alpha=0.3, beta=1.0, l1=0.02, l2=0.01, epochs=3):
    """Follow-the-regularised-leader one coordinate at a time: {(slot, language): weight}, idf and the bias under slot None."""
    taught = [r for i, r in enumerate(rows) if i % 5 != 4]
    df = {}
    for counted, _ in taught:
        for slot in counted:
            df[slot] = df.get(slot, 0) + 1
    idf = {s: math.log((1 + len(taught)) / (1 + n)) + 1 for s, n in df.items()}
    z, n = {}, {}

    def weight(key):
        zk = z.get(key, 0.0)
        return 0.0 if abs(zk) <= l1 else -(zk - math.copysign(l1, zk)) / ((beta + math.sqrt(n.get(key, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for counted, lang in taught:
            x = {s: language_id.SCALE * c / sum(counted.values()) * idf[s] for s, c in counted.items()} | {None: 1.0}
            logits = {k: sum(v * weight((s, k)) for s, v in x.items()) for k in languages}
            top = max(logits.values())
            total = sum(math.exp(v - top) for v in logits.values())
            for k in languages:
                error = math.exp(logits[k] - top) / total - (k == lang)
                for s, v in x.items():
                    g, old, w = error * v, n.get((s, k), 0.0), weight((s, k))
                    z[s, k] = z.get((s, k), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w
                    n[s, k] = old + g * g
    return {key: weight(key) for key in z}, idf


def test_language_training_step_by_step():
    words = {"en": "the and that", "fr": "le la des", "de": "der und nicht"}
    texts = [(" ".join(random.Random(i).choices(words[k].split(), k=12)), k) for i in range(24) for k in [list(words)[i % 3]]]
    counted = [language_id.counts(t) for t, _ in texts]
    model = language_id.train(counted, [k for _, k in texts])
    want, idf = ftrl_plain([(dict(zip(c[0].tolist(), c[1].tolist(), strict=True)), k) for c, (_, k) in zip(counted, texts, strict=True)], model.languages)
    assert any(w == 0 for w in want.values()) and any(w for w in want.values())
    for (slot, lang), w in want.items():
        got, expected = (model.bias, w) if slot is None else (model.table[slot], w * idf[slot])
        assert got[model.languages.index(lang)] == pytest.approx(expected, rel=1e-5, abs=1e-9)
    unseen = np.setdiff1d(np.arange(len(model.table)), [s for s, _ in want if s is not None])
    assert not model.table[unseen].any()


def test_language_of_long_texts(spark):
    """A text of millions of characters is counted whole, and the sample is bounded in bytes."""
    long = {"en": "the and that with from " * 100_000, "fr": "le la des avec pour " * 100_000}
    rows = [(i, long[k] if i < 2 else " ".join(random.Random(i).choices(long[k][:60].split(), k=20)), k) for i in range(300) for k in [("en", "fr")[i % 2]]]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for bound in (language_id.SAMPLE_BYTES, 200_000):
        got = {r.doc_id: r.lang_pred for r in language_id.predicted(frame, language_id.fitted(frame, sample_bytes=bound)).collect()}
        assert got == {i: k for i, _, k in rows}
    whole, (slots, n) = long["en"], language_id.counts(long["en"])
    assert n.sum() == 3 * (len(whole) + 1) - 3 and len(slots) < 200


def top_brute(rows, k, every):
    valid = {i: [int(np.nan_to_num(np.floor(64 * np.float64(x)))) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in valid:
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(valid[q], valid[c], strict=True)), c) for c in valid if c != q and len(valid[c]) == len(valid[q]))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_threshold_saves_entries():
    """Every entry at or over the cutoff is collected, and few others are."""
    rng = np.random.default_rng(3)
    q, c = (np.floor(64 * x / np.linalg.norm(x, axis=1, keepdims=True)) for x in (rng.normal(size=(50, 64)), rng.normal(size=(4000, 64))))
    lists = top_k._partials(top_k._narrow(q), top_k._narrow(c), 2)
    assert lists[0].dtype == np.float32
    total = (q @ c.T).astype(np.int64)
    assert ((lists[0] + lists[1]).astype(np.int64) == total).all()
    for best, most in ((20, 0.15), (4000, 1.0)):
        cut = np.sort(total, axis=1)[:, -best]
        at = np.zeros(total.shape, bool)
        at[top_k.sufficient(lists, cut)] = True
        assert at[total >= cut[:, None]].all() and at.mean() <= most
    low = np.full(50, -(2**63))
    assert len(top_k.sufficient(lists, low)[0]) == total.size
    huge = [np.array([[2**70, -(2**70)]], dtype=object), np.array([[0, 5]], dtype=object)]
    assert top_k.sufficient(huge, np.array([2**62]))[1].tolist() == [0]


@pytest.mark.parametrize("block", [2048, 13])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(top_k, "BLOCK", block)
    monkeypatch.setattr(top_k, "QUERIES", block)
    rows = [(i, [random.choice([-1.0, 0.0, 0.5, random.gauss(0, 1)]) for _ in range(6)]) for i in range(120)]
    rows += [(i, [1.0] * 6) for i in range(120, 160)] + [(200, None), (None, [1.0] * 6), (220, [1.0, None]), (240, [float("nan")]), (260, [float("inf"), 1.0]), (280, []), (300, [3.0]), (320, [1e10, -1e10]), (321, [1e9, 1e9]), (340, [1e308] * 3), (341, [-1e308, 1.0, 0.5]), (360, [70000.0, 0.5, 1.0, 2.0]), (361, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", F.lit(0).alias("dim"), F.lit(0).alias("rank"))
    got = sorted(tuple(r) for r in top_k.search(frame, F.col("vec_id") % 20 == 0, k=5).collect())
    top = 2**63 - 1
    assert got == [(q, n, c, max(-top - 1, min(top, s))) for q, n, c, s in top_brute(rows, 5, 20)]
    assert top_k.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    twice = frame.union(frame.filter("vec_id < 3"))
    assert sorted(tuple(r) for r in top_k.search(twice, F.col("vec_id") % 20 == 0, k=5).collect()) == got


BODY, TALK = "<p>" + "The article tells what happened. " * 23 + "</p>", "".join(f"<p>Reader {i} says a lot about it all, and then more.</p>" for i in range(40))
TOLD = " ".join(("The article tells what happened. " * 23).split())


@pytest.mark.parametrize("talk", ['<div class="reviews">{}</div>', '<section class="discussion">{}</section>', '<div class="x7">{}</div>', '<div id="comments">{}</div>', '<section><div class="thread">{}</div></section>'])
@pytest.mark.parametrize("frame", ["<body><article>{}</article>{}</body>", "<body>{1}<article>{0}</article></body>", '<body><div class="page"><article><h2></h2>{}</article>{}</div></body>'])
def test_html_article_before_larger_talk(talk, frame):
    assert html_extract.main_text(frame.format(BODY, talk.format(TALK))) == TOLD


@pytest.mark.parametrize("talk", ['<div class="reviews">{}</div>', '<section class="discussion">{}</section>', '<div class="comments-area">{}</div>'])
def test_html_talk_in_main(talk):
    assert html_extract.main_text(f"<body><main><article>{BODY}</article>{talk.format(TALK)}</main></body>") == TOLD


@pytest.mark.parametrize("mark", ['class="post-12 hentry comments-open"', 'class="ads-enabled"', 'class="content ad-free"', 'id="newsletter-issue-12"', 'aria-hidden="true"'])
@pytest.mark.parametrize("tag", ["div", "section", "article"])
def test_html_no_page_lost_to_a_word(mark, tag):
    page = f'<body><nav>Menu</nav><{tag} {mark}>{BODY}</{tag}><div class="comments">Short words.</div><footer>End</footer></body>'
    assert html_extract.main_text(page) == TOLD


@pytest.mark.parametrize("box", ['<div class="ad-box">{}</div>', '<div class="comments">{}</div>', '<div class="sponsored-unit x">{}</div>', '<div aria-hidden="true">{}</div>', '<div class="newsletter-signup">{}</div>', '<p class="cookie-notice">{}</p>'])
def test_html_boxes_still_go(box):
    for frame in ("<article>{}{}</article>", '<div class="post">{}{}</div>'):
        assert html_extract.main_text(f"<body>{frame.format(BODY, box.format('Buy or say something here.'))}</body>") == TOLD


def test_html_lists_of_articles_stay_whole():
    cards = "".join(f"<article><p>{'Card text of some length here. ' * 9}</p></article>" for _ in range(5))
    assert html_extract.main_text(f"<body><main>{cards}</main></body>").count("Card text") == 45


def test_html_div_layouts_by_precision_and_recall(spark):
    """Four hosts without article elements, each with its own layout and with talk that is larger than the article on every other page."""
    layouts = ['<div class="wrap"><div class="story-{n}"><h1>{h}</h1>{b}</div><div class="comments-list">{t}</div></div>', '<div id="c"><div class="entry"><h1>{h}</h1><div class="txt">{b}</div></div><div class="reviews">{t}</div></div>',
               '<table><tr><td class="side">Menu</td><td class="main"><h1>{h}</h1>{b}</td></tr></table><div id="disqus_thread">{t}</div>', '<div class="post"><h1>{h}</h1>{b}<div class="share-buttons">Tweet</div></div><section class="discussion">{t}</section>']
    pages, want = [], {}
    for i in range(80):
        words = " ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(60 + i))
        talk = "".join(f"<p>{' '.join(random.choice('iota kappa lambda mu nu xi'.split()) for _ in range(20))}</p>" for _ in range(i % 2 * 12 + 1))
        pages.append((i, f"https://h{i % 4}.example/p{i}", f"<body><nav>Home</nav>{layouts[i % 4].format(n=i, h=f'Title {i}', b=f'<p>{words}</p>', t=talk)}<footer>c</footer></body>"))
        want[i] = Counter(f"Title {i} {words}".split())
    right = found = wanted = 0
    for r in html_extract.extract(spark.createDataFrame(pages, PAGES)).collect():
        got = Counter(r.text.split())
        right, found, wanted = right + (got & want[r.page_id]).total(), found + got.total(), wanted + want[r.page_id].total()
    assert right / found > 0.99 and right / wanted > 0.99


@pytest.mark.parametrize("together", [(1, 3), (2, 32), (16, 1)])
def test_top_k_in_groups(spark, monkeypatch, together):
    """Several groups of queries and of candidates: each pair of groups meets once."""
    for name, value in (("BLOCK", 13), ("QUERIES", 2), ("TOGETHER", together)):
        monkeypatch.setattr(top_k, name, value)
    rows = [(i, [random.gauss(0, 1) for _ in range(3 + i % 2)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_k.search(frame, F.col("vec_id") % 10 == 0, k=4).collect()) == top_brute(rows, 4, 10)
