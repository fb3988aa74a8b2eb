"""The corpus operators against brute force, round trips and held-out labels, with the defined results of odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelathe.llm import bpe, chosen_path, components, decontaminate, html, langid, ogg, quality, queries, repeats, toxicity, warc
from codelathe.llm.common import shared_path, table
from tests.conftest import SF

LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in any column, empty, blank, accented, repeated and long texts.
ODD = [
    (1, None, "en", None, None),
    (2, "", None, "s", 0),
    (3, " \t\n", "en", "s", 3),
    (4, "É un Ça ñ ß 日本語 🎉", "fr", "s", 1),
    (4, "É un Ça ñ ß 日本語 🎉", "fr", "s", 1),
    (None, "no id here at all", "en", "s", 1),
    (5, "word " * 30_000, "en", "s", 150_000),
    (6, "123 456 !!! ...", "en", "s", 1),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clash(df):
    """Extra columns with the names that operators give."""
    return df.withColumns({n: F.lit("x") for n in ("out", "bpe", "ogg", "main", "bench", "toxicity", "lang_id", "score", "t", "b", "e", "h", "n", "spans", "repeats", "kept", "rep", "component", "near_key", "quality_score")})


def documents(spark):
    return table(spark, SF, "documents")


# --- html ---------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a href=/>Home</a></nav>
<article><header><h1>A &amp; B</h1></header><p>First   long paragraph of the article with enough words to count.<p>Second, <b>bold</b> text &lt;x&gt; goes on for a while as well.
<div class="ad">Buy now</div><form><input value=q>Search</form><ul><li>item</ul><p>End.<section id="comments"><p>I disagree with all of this and say so at great length.</p></section></article>
<aside>Related</aside><div class="cookie-notice">Cookies</div><footer>&copy; X</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "A & B\nFirst long paragraph of the article with enough words to count.\nSecond, bold text <x> goes on for a while as well.\nitem\nEnd."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p><!-- x -->") == ""
    assert html.main_text("plain words") == "plain words"
    assert html.main_text("<div><p>" + "long text here " * 20 + "</p><p>short</p></div><div id=sidebar>menu</div>").endswith("short")
    assert html.main_text("<article><p>unclosed <b>text") == "unclosed text"


def block(n: int, tag: str = "p") -> str:
    return f"<{tag}>{'x' * n}</{tag}>"


def test_main_text_around_the_seeds():
    sizes = lambda page: [len(x) for x in html.main_text(page).split("\n")]
    body = "<div class=body>" + block(700) * 8 + "</div>"
    frame = "<nav><a href=/>Home</a></nav>{}<footer>Imprint</footer>"
    inside = frame.format(f"<div id=content>{block(40, 'h1')}{block(200)}{body}</div>")
    assert sizes(inside) == [40, 200, *[700] * 8]
    assert sizes(f"<div id=wrap>{inside}</div>") == [40, 200, *[700] * 8]
    shared = f"<div id=content>{block(40, 'h1')}<div class=share>Share</div>{block(80, 'div')}{body}{block(30)}</div>"
    assert sizes(frame.format(shared)) == [40, 80, *[700] * 8, 30]
    for lines in ([30, 200, 900, 150, 120, 100], [40, 90, 600, 700, 650, 60, 30]):
        text = block(lines[0], "h1") + "".join(map(block, lines[1:]))
        assert sizes(f"<body>{frame.format(text)}") == lines
        assert sizes(f"<body>{block(7, 'div')}<ul><li><a href=/>Home</a></ul>{text}{block(9, 'div')}") == lines
    assert sizes(f"<body><div>{block(20, 'div')}{block(60, 'div')}{block(900) * 6}</div><div>{block(150)}</div>")[:2] == [20, 60]


def test_all_articles_of_a_page():
    lines = [(20, 900, 910), (21, 300, 310), (22, 320, 330)]
    page = "<body><nav>Home</nav>" + "".join(f"<article>{block(a, 'h2')}{block(b)}{block(c)}</article>" for a, b, c in lines) + "<footer>Imprint</footer>"
    assert [len(x) for x in html.main_text(page).split("\n")] == [n for x in lines for n in x]


def link_list(n: int) -> str:
    return "<ul>" + "".join(f"<li><a href=/{k}>link {k}</a></li>" for k in range(n)) + "</ul>"


def test_ratios_decide(monkeypatch):
    long = [("word " * n).strip() for n in (80, 95, 70, 110, 60)]
    body = "".join(f"<p>{t}</p>" for t in long)
    plain = f"<body><div class=x1><div>{link_list(12)}</div><div>Buy this</div></div><div class=x2>{body}</div><div class=x3><div>Terms</div>{link_list(9)}</div>"
    inside = f"<body><article><h1>{long[0]}</h1>{body}{link_list(10)}</article>"
    assert html.main_text(plain) == "\n".join(long)
    assert html.main_text(inside) == "\n".join([long[0], *long])
    for constant in (np.ones, np.zeros):
        monkeypatch.setattr(html, "smoothed", lambda r, c=constant: c(len(r)))
        assert html.main_text(plain) != "\n".join(long) and html.main_text(inside) != "\n".join([long[0], *long])


def test_ratios_against_plain_python():
    page = html.Lines()
    page.feed(f"<body><nav><a href=/>Home</a></nav><div><p>{'x' * 90}</p><p>short <b>b</b></p>{link_list(3)}<p>{'y' * 140}</p></div>")
    page.close()
    page.end_line()
    ratios = [len(t) / max(1, n) for t, n in zip(page.texts, page.tags)]
    kernel = [np.exp(-(k**2) / 2) for k in (-2, -1, 0, 1, 2)]
    want = []
    for n in range(len(ratios)):
        near = [(kernel[k + 2], ratios[n + k]) for k in (-2, -1, 0, 1, 2) if 0 <= n + k < len(ratios)]
        want.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    assert html.smoothed(np.array(ratios)) == pytest.approx(want)
    low, high = min(want), max(want)
    for _ in range(50):
        groups = [x for x in want if x <= (low + high) / 2], [x for x in want if x > (low + high) / 2]
        low, high = (sum(g) / len(g) for g in groups)
    assert html.threshold(np.array(want)) == pytest.approx((low + high) / 2)


def test_html_of_odd_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(none)[0].count() == 0
    text = "words and more " * 40_000
    assert html.main_text(f"<div><p>{text}</p></div>") == " ".join(text.split())


def test_smoothing_and_threshold():
    assert html.smoothed(np.ones(5)) == pytest.approx(np.ones(5))
    assert 1 < html.threshold(np.array([0.0, 1.0, 10.0, 11.0])) < 10


def test_html_query(spark):
    for r in queries.QUERIES["op1_html_extraction"](spark, SF).collect():
        assert r.n_chars == len(r.text) and r.n_chars > 0
    pages = spark.createDataFrame([(1, "u", None), (2, None, "<p>x")], "page_id long, url string, html string")
    df, out = html.extract(clash(pages))
    assert {r.page_id: r[out]["text"] for r in df.collect()} == {1: "", 2: "x"}


# --- quality ------------------------------------------------------------------------------


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.7)).astype(float)
    rules = quality.fit_rules(x, y, ["a", "b", "c"])
    assert ((rules.score(x) >= 0.5) == (y > 0)).mean() > 0.95 and 0 < len(rules.rules) < 150
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    got = [r.s for r in df.select(rules.column({n: F.col(n) for n in "abc"}).alias("s")).collect()]
    assert got == pytest.approx(list(rules.score(x[:50])))
    assert quality.fit_rules(x[:0], y[:0], ["a", "b", "c"]).score(x[:1])[0] == pytest.approx(0.5)


def test_rules_against_plain_conjunctions():
    rng = np.random.default_rng(5)
    x = rng.random((400, 4))
    y = ((x[:, 1] > 0.4) ^ (x[:, 3] > 0.7)).astype(float)
    rules = quality.fit_rules(x, y, ["a", "b", "c", "d"])
    for row, score in zip(x[:100], rules.score(x[:100])):
        total = rules.bias
        for weight, rule in zip(rules.weights, rules.rules):
            total += weight * all(row[k] > bound if above else row[k] <= bound for k, above, bound in rule)
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_held_out(spark, odd, empty):
    found = queries.QUERIES["op2_quality_rules"](spark, SF.replace("0.001", "0.01"))
    rows = found.where("held_out").join(table(spark, SF.replace("0.001", "0.01"), "labels"), "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    rules = quality.fit(documents(spark), table(spark, SF, "labels"), "quality")
    df, out = quality.score(clash(odd), rules)
    assert all(0 <= r[out] <= 1 for r in df.collect()) and df.count() == len(ODD)
    assert quality.score(empty, rules)[0].count() == 0
    assert quality.fit(empty, spark.createDataFrame([], "doc_id long, quality int"), "quality").bias == pytest.approx(0)


# --- bpe ----------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, odd, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.vocabulary())
    rng = random.Random(5)
    texts = [r.text or "" for r in documents(spark).collect()] + [r[1] or "" for r in ODD]
    texts += ["<|endoftext|>hi<|startoftext|>", "ΑΣ Σας ΟΔΟΣ", "don't I'll 'SUN", "x\x1cy\x85z ½ ٣ á", "aaaaaaaaaaaaaab" * 9, "İ ǅ", "\x00\x01"]
    texts += ["".join(rng.choice("abcté <|>'s1 🎉\n") for _ in range(200)) for _ in range(200)]
    held = bpe.TrieCodec(bpe.vocabulary())
    for t, (ids, decoded) in zip(texts, held.encode_texts(texts)):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and decoded == library.decode(want, skip_special_tokens=False)
        assert held.decode(want) == decoded
    df, out = bpe.digests(clash(odd))
    rows = {r.doc_id: r[out] for r in df.collect()}
    assert rows[1]["n_tokens"] == 0 and rows[1]["ids_sha256"] == hashlib.sha256(b"").hexdigest() == rows[2]["decoded_sha256"]
    assert bpe.digests(empty)[0].count() == 0


# --- repeats ------------------------------------------------------------------------------


def brute_repeats(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        change = np.zeros(len(r) + 1, int)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                change[i] += 1
                change[i + length] -= 1
        hit = np.cumsum(change)[: len(r)] > 0
        edge = np.concatenate([[False], hit])
        out.append((len(r), int(hit.sum()), int((edge[1:] & ~edge[:-1]).sum()), hashlib.sha256(bytes(np.frombuffer(r, np.uint8)[~hit])).hexdigest()))
    return out


def test_index_statistics():
    rng = random.Random(1)
    for _ in range(40):
        t = [rng.randint(1, 3) for _ in range(rng.randint(1, 70))]
        t = np.array(t + t[: len(t) // 2] + [255], np.uint8)
        want = []
        for i in range(len(t)):
            best = 0
            for j in range(len(t)):
                k = 0
                while i != j and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
                    k += 1
                best = max(best, k)
            want.append(best)
        index = repeats.RunLengthIndex(t)
        assert index.matching_statistics().tolist() == want and index.runs <= len(t)


def test_repeats(spark, odd):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(60), text(200)
    texts = [text(80) + passage + text(80) for _ in range(12)] + [base] * 3 + [base[:500] + "X" + base[501:], base[1:]]
    texts += ["a" * 500, "a" * 199, "ab" * 300, passage + passage, text(40), "", None, "é" * 120, "xé" + "é" * 119]
    df = spark.createDataFrame([(i if i % 7 else None, t) for i, t in enumerate(texts)] + [(1, texts[1])], "doc_id long, text string")
    want = collections.Counter(brute_repeats([*texts, texts[1]]))
    for how in ({}, {"most": 5}, {"most": 1}, {"index_bytes": 1000}):
        found, out = repeats.removed(df, **how)
        assert collections.Counter(tuple(r[out]) for r in found.collect()) == want
    found, out = repeats.removed(clash(odd))
    rows = [r[out]["n_removed"] for r in found.orderBy("doc_id").collect()]
    assert len(rows) == len(ODD) and rows[-2] == 150_000
    assert repeats.removed(odd.limit(0))[0].count() == 0


def test_anchors_of_periodic_texts():
    rng = random.Random(4)
    for unit in ("a", "word ", "abcdefghij" * 30, "".join(rng.choice("abc") for _ in range(5000))):
        raw = (unit * (2 << 20))[: 2 << 20].encode()
        h, _, b, e, _ = repeats.anchors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 200, 40)
        assert (e - b).sum() < 5 * len(raw) and (e - b).max() <= (1 << 14) + 200
        assert len(h) < len(raw) / 40 and b.min() == 0 and e.max() == len(raw)


def test_repeats_of_very_long_texts(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    size = 20 << 20
    for unit in ("a", "word "):
        text = (unit * (size // len(unit) + 1))[:size]
        pq.write_table(pa.table({"doc_id": [1, 2, 3], "text": [text, "short", None]}), tmp_path / "long.parquet")
        found, out = repeats.removed(spark.read.parquet(str(tmp_path / "long.parquet")))
        rows = {r.doc_id: tuple(r[out]) for r in found.collect()}
        assert rows[1] == (size, size, 1, hashlib.sha256(b"").hexdigest())
        assert rows[2][:3] == (5, 0, 0) and rows[3][:3] == (0, 0, 0)
        spark.catalog.refreshByPath(str(tmp_path / "long.parquet"))


def test_repeats_on_the_table(spark):
    rows = queries.QUERIES["op4_suffix_dedup"](spark, SF).orderBy("doc_id").collect()
    want = brute_repeats([r.text for r in documents(spark).orderBy("doc_id").collect()])
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == want


# --- warc ---------------------------------------------------------------------------------


def test_warc(spark):
    big, small = "<p>" + "x" * 200, "<p>x"
    rows = [(3, "http://a/ é%\r\n", big), (2, "u", big), (9, None, big), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (2, "u2", big), (None, "u", big), (8, "v", "é" * 50), (10, "v", "é" * 50), (11, "w", "a" * 99), (12, "w", "a" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    stored = warc.archive(clash(pages), shared_path(spark, "warc-test"))
    found = warc.read(stored).collect()
    assert sorted((r.page_id or 0, r.url or "") for r in found) == sorted((r[0] or 0, r[1] or "") for r in rows)
    kind = collections.defaultdict(set)
    for r in found:
        kind[r.page_id].add((r.record_type, r.refers_to))
        assert r.payload_bytes in (0, 4, 99, 100, 203)
    assert kind[3] == kind[9] == kind[None] == {("revisit", 2)} and kind[2] == kind[8] == {("response", None)} and kind[10] == {("revisit", 8)}
    assert all(kind[n] == {("response", None)} for n in (4, 5, 6, 7, 11, 12))
    assert warc.read(warc.archive(pages.limit(0), shared_path(spark, "warc-test"))).count() == 0


def test_seekable_bundle(spark, tmp_path):
    import zstandard

    writer = warc.BundleWriter(frame_bytes=300)
    for n in range(20):
        body = f"<p>page {n}".encode() * (n + 1)
        writer.add(warc.Record(n, f"http://h/{n}", body, hashlib.sha256(body).hexdigest(), len(body)))
    data = writer.close()
    reader = warc.BundleReader(data)
    assert reader.record(warc.name_of(7, hashlib.sha256(b"<p>page 7" * 8).hexdigest())).payload == b"<p>page 7" * 8
    assert len(reader.frames) > 5 and [r.page_id for r in reader] == [r.page_id for r in reader.mapped()] == list(range(20))
    same = warc.BundleWriter()
    for n in (1, 1, 1):
        same.add(warc.Record(n, "u", b"x", hashlib.sha256(b"x").hexdigest(), 1))
    assert len(list(warc.BundleReader(same.close()).mapped())) == 3
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == b"".join(reader.frame(n) for n in range(len(reader.frames)))
    with pytest.raises(warc.WarcError):
        warc.BundleReader(data[:-1])
    df = spark.createDataFrame([("a.warc.zst", bytearray(data))], "name string, content binary")
    warc.write_files(df, str(tmp_path))
    assert (tmp_path / "a.warc.zst").read_bytes() == data


# --- toxicity -----------------------------------------------------------------------------


def test_toxicity(spark, odd, empty):
    sf = SF.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    chain = toxicity.fit(docs, labels.where("doc_id % 4 <> 0"))
    df, out = toxicity.predict(docs, chain)
    rows = df.select("doc_id", f"{out}.*").join(labels.where("doc_id % 4 = 0"), "doc_id").collect()
    assert sum(r.is_toxic and not r.toxic for r in rows) <= 1
    assert sum(bool(r.is_toxic and r.toxic) for r in rows) >= 0.6 * sum(r.toxic for r in rows) > 0
    assert chain.categories == ["low_quality", "toxic"] and len(chain.models[1].weights) == len(chain.features) + 1
    marked, out = toxicity.predict(clash(odd), chain)
    assert marked.count() == len(ODD) and not marked.where(f"{out}.is_toxic").count()
    assert toxicity.clean(empty, chain).columns == empty.columns
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.clean(docs, none).count() == docs.count()


def test_chain_against_plain_sums(spark):
    docs, labels = table(spark, SF.replace("0.001", "0.01"), "documents"), table(spark, SF.replace("0.001", "0.01"), "labels")
    chain = toxicity.fit(docs, labels)
    df, out = toxicity.predict(docs.limit(60).select("doc_id", "text"), chain)
    place = {int(b): k for k, b in enumerate(chain.features)}
    for r in df.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        held = [place[b] for b in set(toxicity.buckets(raw, np.array([0, len(raw)]))[1].tolist()) if b in place]
        odds = []
        for name, model in zip(chain.categories, chain.models):
            margin = model.bias + sum(model.weights[k] for k in held) + sum(w * o for w, o in zip(model.weights[len(place) :], odds))
            assert r[out][f"p_{name}"] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)
            odds.append(min(6.0, max(-6.0, margin)))
        assert r[out]["is_toxic"] == (r[out][f"p_{chain.categories[-1]}"] >= chain.threshold)


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    x = (rng.random((800, 6)) < 0.3).astype(np.float32)
    first = x[:, 0] * (1 - x[:, 1])
    chain = toxicity.fit_chain(x, np.arange(6), {"one": first, "two": first})
    assert chain.models[1].weights[-1] > 0.2
    assert toxicity.best_threshold(np.array([3.0, 1.0, -2.0]), np.array([1.0, 1.0, 0.0])) == pytest.approx(1 / (1 + np.exp(0.5)), abs=0.01)


# --- ogg ----------------------------------------------------------------------------------


def slow_crc(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else (crc << 1) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("size", [0, 1, 191, 192, 193, 255, 4032, 4033, 70_000, 300_000])
def test_ogg_round_trip(size):
    text = random.Random(size).randbytes(size)
    for block in (192, 4032, 65_280, 130_560):
        assert ogg.restore(ogg.store(ogg.padded(text), 2, block)).payload == ogg.padded(text)
    found = ogg.described(text)
    assert found[0] == size and found[1] % 192 == 0 and found[1] >= max(192, size) and found[3] == zlib.crc32(ogg.padded(text)[-16:])


def test_ogg_damage_is_found():
    media = ogg.store(ogg.padded(b"hello" * 5000))
    assert ogg.page_crc(b"some bytes") == slow_crc(b"some bytes")
    for at in (0, 30, 100, len(media) - 1):
        broken = bytearray(media)
        broken[at] ^= 4
        with pytest.raises(ogg.OggError):
            ogg.restore(bytes(broken))
    with pytest.raises(ogg.OggError):
        ogg.restore(media[:-10])
    streams = ogg.demultiplex(media)
    assert len(streams) == 2 and all(start % 192 == 0 for s in streams.values() for start, _ in ogg.dated(s))


def test_ogg_columns_on_the_table(spark):
    texts = {r.doc_id: r.text or "" for r in documents(spark).collect()}
    for r in queries.QUERIES["op7_ogg_media"](spark, SF).collect():
        raw = texts[r.doc_id].encode()
        full = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))
        media = ogg.store(full)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest()) and r.feature


def test_ogg_query(spark, odd):
    df, out = ogg.features(clash(odd))
    rows = collections.defaultdict(set)
    for r in df.collect():
        rows[r.doc_id].add(tuple(r[out]))
    assert rows[1] == rows[2] and len(rows[4]) == 1 and next(iter(rows[1]))[:2] == (0, 192)


# --- near copies --------------------------------------------------------------------------


def brute_groups(rows, width, least):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    group = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                    new, old = sorted((group[a], group[b]))
                    group = {k: new if v == old else v for k, v in group.items()}
    return {i: (len(sets[i]), group[i]) for i in ids}


@pytest.mark.parametrize(("width", "least", "rows"), [(3, 85, 3000), (5, 80, 3000), (3, 85, 6)])
def test_near_copies(spark, width, least, rows):
    rng = random.Random(7)
    words = [f"w{n}" for n in range(500)]
    base = [rng.choice(words) for _ in range(150)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(40)]
    for _ in range(25):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(copy))
    texts += ["one", "One", "two words", "two  WORDS", "", None, "words two", texts[3], texts[3].upper()]
    docs = [(7 * n + 3, t) for n, t in enumerate(texts)]
    rng.shuffle(docs)
    found = chosen_path.groups(clash(spark.createDataFrame(docs, "doc_id long, text string")), width=width, least=least, node_rows=rows).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_groups(docs, width, least)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_copies_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    found = queries.QUERIES["op8_near_dedup"](spark, SF).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_groups(rows, 3, 85)


def test_near_copies_of_odd_rows(spark, odd, empty):
    found = chosen_path.groups(clash(odd)).collect()
    assert len(found) == len(ODD) and {r.component_id for r in found if r.doc_id is None} == {None}
    kept = chosen_path.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert chosen_path.keep_one(empty).count() == 0


def test_near_copies_of_each_text_of_an_id(spark):
    def pair(name, i, key):
        words = [f"{name}{i}w{k}" for k in range(60)]
        return [(i, " ".join(words)), (key + i, " ".join([*words, "more"]))]

    rows = [x for i in range(1, 11) for name, key in (("a", 100), ("b", 200)) for x in pair(name, i, key)]
    found = chosen_path.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in found} == {k + i: i for i in range(1, 11) for k in (0, 100, 200)}


def test_components(spark):
    links = [(n, n + 1) for n in range(1, 40)] + [(100, 50), (50, 100), (60, 60), (None, 3)]
    found = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.v: r.component for r in found} == {n: 1 for n in range(1, 41)} | {50: 50, 100: 50}


# --- language -----------------------------------------------------------------------------


def test_language(spark, odd, empty):
    sf = SF.replace("0.001", "0.01")
    rows = queries.QUERIES["op9_language_id"](spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    profiles = langid.fit(documents(spark))
    df, out = langid.identify(clash(odd), profiles)
    found = {r.doc_id: tuple(r[out]) for r in df.collect()}
    assert found[1] == found[2] == found[3] == found[6] == ("und", 0.0) and found[4][0] in profiles
    assert langid.fit(empty) == {} and langid.judge(["text"], {}, 10) == (["und"], [0.0])


def test_rank_profiles():
    who, key, rank = langid.ranked(["aab b", None], 3)
    assert set(who.tolist()) == {0} and rank.tolist() == [0, 1, 2]
    assert collections.Counter(langid.grams(["ab"])[1].tolist())[ord("a")] == 1


def plain_profile(texts, length):
    """The n-grams of words with their borders, most frequent first, ties by code points."""
    count = collections.Counter()
    for t in texts:
        for word in "".join(c.lower()[0] if c.isalpha() else " " for c in t or "").split():
            padded = [0x110000, *map(ord, word), 0x110000]
            count.update((c,) for c in padded[1:-1])
            count.update(tuple(padded[k : k + n]) for n in (2, 3) for k in range(len(padded) - n + 1))
    return sorted(count, key=lambda g: (-count[g], sum(c << 21 * k for k, c in enumerate(reversed(g)))))[:length]


def test_language_against_plain_distances(spark):
    rows = documents(spark).where("text is not null and lang is not null").select("doc_id", "text", "lang").collect()
    rows += [type(rows[0])(doc_id=-n, text=t, lang=k) for n, (k, t) in enumerate([("ru", "быстрая лисица прыгает через ленивую собаку " * 3), ("el", "η γρήγορη αλεπού πηδάει πάνω από το σκυλί " * 3), ("ja", "日本語の文章はここにあります。短い文です。" * 3), ("hi", "यह एक छोटा सा वाक्य है और कुछ नहीं " * 3)], 1)]
    by_lang = collections.defaultdict(list)
    for r in rows:
        by_lang[r.lang].append(r.text)
    want = {k: plain_profile(v, 400) for k, v in by_lang.items()}
    df = spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows], "doc_id long, text string, lang string")
    profiles = langid.fit(df)
    code = lambda g: sum(c << 21 * k for k, c in enumerate(reversed(g)))
    assert profiles == {k: [code(g) for g in v] for k, v in want.items()} and len(profiles) >= 8
    texts = ["собака и лисица", "το σκυλί", "日本語です", "एक वाक्य", *[r.text for r in rows[:40]]]
    langs, scores = langid.judge(texts, profiles, 400)
    assert langs[:4] == ["ru", "el", "ja", "hi"]
    for t, lang, score in zip(texts, langs, scores):
        mine = plain_profile([t], 400)
        far = {k: sum(abs(v.index(g) - n) if g in v else 400 for n, g in enumerate(mine)) for k, v in want.items()}
        first, second = sorted(far.values())[:2]
        assert lang == min(sorted(far), key=far.get) and score == pytest.approx(1 - first / second)


# --- decontamination ----------------------------------------------------------------------


def test_decontamination(spark, odd, empty):
    rng = random.Random(9)
    words = [f"w{n}" for n in range(60)] + ["é", "x1", "日本"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(n))
    items = [(n, text(rng.randint(8, 25))) for n in range(12)] + [(100, "W1 w2"), (101, "w3"), (102, "..."), (103, None), (None, text(9)), (104, "w5 w5 w5")]
    items.append((105, items[0][1]))
    docs = [(n, text(rng.randint(0, 60))) for n in range(60)]
    docs += [(100 + n, text(9) + " " + items[n % 12][1].upper() + " " + items[(n + 1) % 12][1] + text(5)) for n in range(24)] + [(500, None), (501, items[2][1])]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = collections.defaultdict(set)
    for i, t in items:
        w = pattern.findall((t or "").translate(LOWER))
        n = min(8, len(w))
        for k in range(len(w) - n + 1 if n and i is not None else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    want = {}
    for i, t in docs:
        w = pattern.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for k in range(len(w)):
            for n in range(1, 9):
                if k + n <= len(w) and tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want[i] = (len(w), len(hit), len(found), decontaminate.items_digest(list(found)), len(found) >= 2)
    frame = clash(spark.createDataFrame(docs, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 300):
        df, out = decontaminate.matches(frame, bench, bench_bytes=size)
        c = decontaminate.judged(df, out)
        got = {r[0]: tuple(r[1:]) for r in df.select("doc_id", *(c[k].alias(f"r_{k}") for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))).collect()}
        assert got == want
    assert decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.clean(odd, bench.limit(0)).count() == len(ODD)
    assert decontaminate.clean(empty, bench).count() == 0


# --- pipeline -----------------------------------------------------------------------------


def test_pipeline(spark, odd):
    import corpus_pipeline as p

    docs = documents(spark).cache()
    assert [n for n, _ in p.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "bpe"]
    done = dict(p.STAGES)
    larger = SF.replace("0.001", "0.01")  # the smallest table has a handful of toxic labels
    labels = {r.doc_id: r.toxic for r in table(spark, larger, "labels").collect()}
    kept = {r.doc_id for r in done["toxicity"](spark, table(spark, larger, "documents"), larger).collect()}
    gone = lambda toxic: [i not in kept for i, x in labels.items() if x == toxic]
    assert np.mean(gone(0)) <= 0.01 and np.mean(gone(1)) >= 0.8
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = brute_groups(rows, 5, 80)
    one = done["near_dedup"](spark, docs, SF)
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == {i for i, (n, g) in groups.items() if i == g}
    cleaned = {r.doc_id: r for r in done["suffix_dedup"](spark, docs, SF).collect()}
    for (i, t), (_, gone, _, _) in zip(rows, brute_repeats([t for _, t in rows])):
        assert (cleaned[i].text == t) == (gone == 0) and (gone == 0 or cleaned[i].n_chars == len(cleaned[i].text))
    marked = queries.QUERIES["op10_decontamination"](spark, SF)
    clean = {r.doc_id for r in marked.where("longest < 8 and not contaminated").collect()}
    assert {r.doc_id for r in done["decontamination"](spark, docs, SF).collect()} == clean
    last = done["bpe"](spark, docs, SF).collect()
    assert {r.doc_id: r.n_tokens for r in last} == {r.doc_id: r.n_tokens for r in queries.QUERIES["op3_bpe_codec"](spark, SF).collect()}
    assert p.run(spark, SF).count() > 0
    for stage in done.values():
        assert stage(spark, odd.limit(0), SF).count() == 0
        assert stage(spark, odd, SF).count() >= 6
