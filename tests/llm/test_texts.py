"""Operators 1, 2, 3, 5 and 10 against exact round trips, other tokenisers and brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import collect, corpus, frame, odd_frames
from verbena.llm import html_extract, media, repetition, token_counts, toxicity
from verbena.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def unigram():
    """An independent tokeniser with the same vocabulary."""
    from sentencepiece import sentencepiece_model_pb2 as schema
    from tokenizers import Tokenizer, models

    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        m = schema.ModelProto.FromString(f.read())
    t = Tokenizer(models.Unigram([(p.piece, p.score) for p in m.pieces], unk_id=0, byte_fallback=True))
    return lambda x: len(t.encode("▁" + x.replace(" ", "▁")).ids) if x else 0


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(token_counts.vocabulary(tokenizer_file("piece_bpe_32k.model")))


def test_token_counts_match_the_tokeniser(spark, unigram):
    texts = corpus(1)
    got = collect(token_counts.token_counts(frame(spark, texts), tokenizer_file("piece_bpe_32k.model")), "doc_id", "n_tokens")
    assert got == [(i, unigram(t or "")) for i, t in enumerate(texts)]


@settings(max_examples=150, deadline=None)
@given(x=st.text(alphabet="ab the\n\tingé漢😀_▁.", max_size=60))
def test_token_counts_on_any_text(unigram, counter, x):
    assert counter.counts([x.encode()]).tolist() == [unigram(x)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var x="</p>";</script></head><body><header>Site name</header><nav><ul><li><a href=/a>A</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article class="post post-12"><header><h1>Head &amp; tail</h1><span>by</span></header><p>One <b>two</b>
 three&nbsp;four<br>five</p><p>Second<ul><li>x<li>y</ul><div class="ad">Buy</div><form>f<input></form><section id="comments"><p>Nice</p></section>end</article></main>
<aside>side</aside><footer>&copy; 1</footer></body></html>"""


def test_main_text():
    text, path = html_extract.extract(PAGE, None)
    assert text == "Head & tail\n\nOne two three four five\n\nSecond\n\nx\n\ny\n\nend"
    assert path == "/html/body/main/article.post.post-"
    assert html_extract.extract(PAGE, path) == (text, path)


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b", "a\n\nb"), ("<p>a &am", "a &am"), ("<p>a &amp", "a &"), ("a < b", "a < b"), ("<div><p>x</div>y", "x"), ("<!-- c --><p>q<!-- open", "q"), ("<script>x", "")])
def test_odd_html(page, text):
    assert html_extract.extract(page, None)[0] == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/apdiv \"'=&;!-x", max_size=80))
def test_any_html_is_read(page):
    html_extract.extract(page, None)


@pytest.mark.parametrize("page, text", [
    ("<p class=can't>kept</p><p>more</p>", "kept\n\nmore"), ('<p>a</p><img alt="5" height"><p>after</p>', "a\n\nafter"), ('<p class="open>a</p><p>b</p>', "a\n\nb"),
    ('<p title="the hidden world">kept</p>', "kept"), ("<p hidden>x</p><p>y</p>", "y"), ('<p style="color:red; display: none">x</p><p>y</p>', "y"),
    ('<article class="share price"><p>kept</p></article>', "kept"), ('<article id="copyright"><p>kept</p></article>', "kept"), ('<div class="legal analysis">kept</div>', "kept"),
    ("<form><p>one</p><input><p>two</p></form>", "one\n\ntwo"), ("<body><p>lead</p><nav><p>the long rest of it</p>", "lead\n\nthe long rest of it"), ("<div class=comments>all there is</div>", "all there is"),
    ("<p>keep <button>Buy</button> this <span class=ad>ad</span> too</p>", "keep this too"), ("<p>a <noscript>b</noscript>c<svg><text>t</text></svg> d<select><option>x</select></p>", "a c d"),
    ("<!-->x", "x"), ("<b><p>one</b> two</p>", "one two"), ("<title>x", "x"),
])
def test_html_as_it_comes(page, text):
    assert html_extract.extract(page, None)[0] == text


@pytest.mark.parametrize("page", ["<i>" * 20_000 + "x", "<div>" * 20_000 + "x" + "</div>" * 20_000, "<b>t" * 12_000, "<ul><li>" + "<b>" * 8000 + "<li></li>" * 8000, "<title>" * 8000, "<div><p>" * 8000, "<p><i>" * 8000, "<a b='" * 8000, "<section class=ad>x" * 8000])
def test_deep_pages_take_no_time(page):
    import time

    began = time.process_time()
    html_extract.extract(page, None)
    assert time.process_time() - began < 1


def test_votes_and_texts_equal_a_plain_loop(spark):
    """Votes summed in a dict and every page read by its host's winner, for all pages of a table."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.collect()
    votes = {}
    for r in rows:
        found = html_extract.read_page(r["html"] or "")
        scores = html_extract.container_scores(found)
        depth = html_extract.depths_of(found, scores)
        for path, x in scores.items():
            own = votes.setdefault(html_extract.host_of(r["url"]), {}).setdefault(path, [0.0, depth[path]])
            own[0] += x / sum(scores.values())
    best = {h: max(own, key=lambda p: (round(own[p][0], 6), own[p][1], html_extract.signed(p))) for h, own in votes.items()}
    want = sorted((r["page_id"], html_extract.extract(r["html"], best.get(html_extract.host_of(r["url"])))[0]) for r in rows)
    assert collect(html_extract.main_text(pages), "page_id", "text") == want


def test_hosts_agree_on_a_path(spark):
    """A page whose own best container is another one follows its host's vote."""
    good = "<body><div class='story'><p>" + "word " * 50 + "</p></div><div class='blurb'><p>short</p></div></body>"
    odd = "<body><div class='story'><p>tiny tale</p></div><div class='blurb'><p>" + "buy now " * 60 + "</p></div></body>"
    pages = [(i, f"http://A.example/{i}", good) for i in range(5)] + [(5, "http://a.example/5", odd), (6, "http://b.example/", odd), (7, None, None), (8, "x", "<p>q")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_extract.main_text(df).collect()}
    assert got[5]["text"] == "tiny tale" and got[6]["text"].startswith("buy now") and got[7]["text"] == "" and got[8]["text"] == "q"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == 9
    html_extract_bytes, html_extract.BROADCAST_BYTES = html_extract.BROADCAST_BYTES, -1
    try:  # the salted join gives the same
        assert {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()} == {k: r["text"] for k, r in got.items()}
    finally:
        html_extract.BROADCAST_BYTES = html_extract_bytes


def test_text_beside_the_winning_path(spark):
    """Headlines, leads and sections of an article outside the winning container stay; lists of links do not join."""
    body = "<p>" + "body words " * 40 + "</p>"
    lead = f"<html><body><article><h1>Headline</h1><p>The lead.</p><div class=body>{body}</div></article><p>elsewhere</p></body></html>"
    parts = f"<html><body><main><section class=intro><p>The intro.</p></section><section class=body>{body}</section></main></body></html>"
    links = f"<html><body><main><article><div class=body>{body}</div></article><ul><li><a href=/1>First link of many</a><li><a href=/2>Second link</a></ul></main></body></html>"
    pages = [(3 * i + k, f"http://{k}.example/{i}", page) for i in range(3) for k, page in enumerate((lead, parts, links))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.main_text(df).collect()}
    words = ("body words " * 40).strip()
    for i in range(3):
        assert got[3 * i] == f"Headline\n\nThe lead.\n\n{words}"
        assert got[3 * i + 1] == f"The intro.\n\n{words}"
        assert got[3 * i + 2] == words


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=20_000))
def test_media_round_trip(data):
    payload = media.padded(data)
    assert len(payload) % 192 == 0 and len(payload) >= 192 and payload.startswith(data) and not payload[len(data) :].strip(b" ")
    (track,) = media.walk(media.store(payload))
    assert media.read_samples(media.store(payload), track) == payload
    assert track["codec"] == "raw " and abs(track["duration"] - len(payload) / 192 / 25) < 1e-9
    for k, (offset, size) in enumerate(track["keyframes"].tolist()):
        assert media.store(payload)[offset : offset + size] == payload[k * 12 * 192 : k * 12 * 192 + 192]


def plain_tree(data, start=0, end=None):
    """An independent reader: (kind, body or children) by the size fields alone."""
    out, end = [], len(data) if end is None else end
    while start < end:
        size, kind = int.from_bytes(data[start : start + 4], "big"), data[start + 4 : start + 8]
        head = 16 if size == 1 else 8
        size = int.from_bytes(data[start + 8 : start + 16], "big") if size == 1 else size
        body = (start + head, start + size)
        out.append((kind, plain_tree(data, *body) if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl") else data[slice(*body)]))
        start += size
    return out


def find_box(tree, *path):
    for kind in path:
        tree = next(x for k, x in tree if k == kind)
    return tree


def test_media_by_an_independent_reader():
    for size in (0, 1, 192, 5000, 192 * 24 * 3):
        payload = media.padded(bytes(i % 251 for i in range(size)))
        file = media.store(payload)
        (track,) = media.walk(file)
        table = lambda name: find_box(plain_tree(file), b"moov", b"trak", b"mdia", b"minf", b"stbl", name)
        word = lambda x, i: int.from_bytes(x[4 * i : 4 * i + 4], "big")
        stsz, stco, stsc, stss = map(table, (b"stsz", b"stco", b"stsc", b"stss"))
        offsets, entries = [word(stco, 2 + i) for i in range(word(stco, 1))], [(word(stsc, 2 + 3 * i), word(stsc, 3 + 3 * i)) for i in range(word(stsc, 1))]
        samples = []
        for c, at in enumerate(offsets, 1):
            for i in range([n for first, n in entries if first <= c][-1]):
                samples.append((at + i * word(stsz, 1), word(stsz, 1)))
        keys = [word(stss, 2 + i) - 1 for i in range(word(stss, 1))]
        assert len(samples) == word(stsz, 2) and b"".join(file[a : a + n] for a, n in samples) == payload
        assert list(map(tuple, track["samples"].tolist())) == samples and list(map(tuple, track["keyframes"].tolist())) == [samples[k] for k in keys]


def test_compact_sizes_and_fragments():
    """A track with 4-bit sizes, and two movie fragments with run tables and defaults."""
    import struct

    box, full, u = media.box, media.full, lambda *x: struct.pack(f">{len(x)}I", *x)
    mdat = box(b"mdat", bytes(range(100)))
    stbl = box(b"stbl", full(b"stsd", u(1), box(b"avc1", bytes(70))), full(b"stts", u(1, 3, 10)), full(b"stsc", u(1, 1, 3, 1)), full(b"stz2", u(4, 3), bytes([0x52, 0x30])), full(b"stco", u(1, 8)))
    trak = box(b"trak", full(b"tkhd", u(0, 0, 7, 0, 30), bytes(60), flags=7), box(b"mdia", full(b"mdhd", u(0, 0, 10, 30, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl)))
    head = mdat + box(b"moov", full(b"mvhd", bytes(96)), trak, box(b"mvex", full(b"trex", u(7, 1, 5, 6, 0x10000))))
    one = box(b"moof", box(b"traf", full(b"tfhd", u(7), flags=0x20000), full(b"trun", u(2, 100, 0, 4, 9), flags=0x205)))
    two = box(b"moof", box(b"traf", full(b"tfhd", u(7, 3), flags=0x20008), full(b"trun", u(2, 200), flags=1)))
    (t,) = media.walk(head + one + two)
    a, b = len(head), len(head) + len(one)
    assert t["codec"] == "avc1" and t["samples"].tolist() == [[8, 5], [13, 2], [15, 3], [a + 100, 4], [a + 104, 9], [b + 200, 6], [b + 206, 6]]
    assert t["keyframes"].tolist() == [[8, 5], [13, 2], [15, 3], [a + 100, 4]] and t["duration"] == (30 + 10 + 6) / 10


def test_odd_media(spark):
    """Deep nesting, forged counts and columns that are called as the features are."""
    import struct

    deep = b""
    for _ in range(20_000):
        deep = struct.pack(">I4s", 8 + len(deep), b"moov") + deep
    good = media.store(media.padded(b"x" * 500))
    at = good.index(b"stsz")
    forged = good[: at + 12] + struct.pack(">I", 0xFFFFFFFF) + good[at + 16 :]
    rows = [(1, bytearray(deep), 1), (2, bytearray(forged), 2), (3, bytearray(good), 3), (4, None, 4)]
    got = {r["doc_id"]: r for r in media.media_columns(spark.createDataFrame(rows, "doc_id long, media binary, codec int")).collect()}
    assert [got[i]["codec"] for i in (1, 2, 3, 4)] == [None, None, "raw ", None] and got[3]["n_samples"] == 3


def test_media_digest(spark):
    texts = corpus(2)
    for r in media.stored_digest(frame(spark, texts)).collect():
        payload = media.padded((texts[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(media.store(payload)).hexdigest() and r["media_bytes"] == len(media.store(payload))


def test_media_columns(spark):
    files = media.store_texts(frame(spark, ["a" * 500, None])).unionByName(spark.createDataFrame([(9, 0, None), (10, 3, bytearray(b"bad"))], "doc_id long, n_bytes long, media binary"))
    got = {r["doc_id"]: r for r in media.media_columns(files).collect()}
    assert got[0]["n_samples"] == 3 and got[0]["keyframes"][0]["length"] == 192 and got[9]["codec"] is None and got[10]["duration"] is None


def rules(text):
    words = (text or "").encode().split()
    three = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if three[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    ten = Counter(tuple(words[i : i + 10]) for i in range(len(words) - 9))
    cover = {j for i in range(len(words) - 9) if ten[tuple(words[i : i + 10])] > 1 for j in range(i, i + 10)}
    lines = [x for x in (text or "").encode().split(b"\n") if x.strip()]
    chars = sum(len(w.decode()) for w in words)
    longest = next((k for k in range(len(words), 0, -1) if any(n > 1 for n in Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)).values())), 0) if len(words) < 400 else None
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    share = sum(len(words[j].decode()) for j in cover) / max(1, chars)
    return (len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed), share, longest


def test_repetition_rules(spark):
    texts = [*corpus(3), "# a | b <i> & 50%\n" * 5 + "\n\n"]
    for r in repetition.repetition_rules(frame(spark, texts)).collect():
        base, share, longest = rules(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base
        assert abs(r["covered"] - share) < 1e-9
        if longest is not None:
            assert r["longest_repeat"] == (longest if longest >= 10 else 0)
        assert r["kept"] == (not base[5] and share <= 0.3 and r["longest_repeat"] <= 100)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=4))
def test_suffix_arrays(docs):
    words, doc = np.array([w for d in docs for w in d], np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    s = repetition.suffix_arrays(words, doc)
    suffixes = [(d, tuple(x[i:])) for d, x in enumerate(docs) for i in range(len(x))]
    assert [suffixes[i] for i in s.order] == sorted(suffixes)
    for k in range(1, len(suffixes)):
        (d, a), (e, b) = suffixes[s.order[k - 1]], suffixes[s.order[k]]
        same = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b))) if d == e else 0
        assert s.lcp[k] == same


def test_lcp_intervals():
    s = repetition.suffix_arrays(np.array([1, 2, 1, 2, 1, 2]), np.zeros(6, np.int64))
    assert sorted(zip(*(x.tolist() for x in repetition.lcp_intervals(s.lcp, 1)), strict=True)) == [(0, 2, 2), (1, 2, 4), (3, 5, 1), (4, 5, 3)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=30), min_size=1, max_size=4))
def test_maximal_repeats_equal_brute_force(docs):
    words, doc = np.array([w for d in docs for w in d], np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    starts, lengths = repetition.repeats(repetition.suffix_arrays(words, doc), words, doc, 3)
    want, base = {}, 0
    for d in docs:
        places = {}
        for n in range(3, len(d)):
            for i in range(len(d) - n + 1):
                places.setdefault(tuple(d[i : i + n]), []).append(i)
        for x, at in places.items():
            n = len(x)
            left, right = {d[i - 1] if i else -1 - i for i in at}, {d[i + n] if i + n < len(d) else -1 - i for i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want |= {base + i: max(n, want.get(base + i, 0)) for i in at}
        base += len(d)
    assert dict(zip(starts.tolist(), lengths.tolist(), strict=True)) == want and len(starts) == len(want)


def test_one_word_over_and_over_takes_linear_time():
    import time

    began = time.process_time()
    m = repetition.measure([b"same " * 100_000, b"a b c " * 50_000, b"x"])
    assert m["longest_repeat"].tolist() == [99_999, 149_997, 0] and m["covered_chars"].tolist() == [400_000, 150_000, 0]
    assert time.process_time() - began < 20


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        t = np.unique(rng.zipf(1.4, 12) % 90)
        w = rng.random(len(t))
        vectors.append((t, w / np.sqrt(w @ w)))
    dense = np.zeros((700, 90))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for share in (0.0, 0.05, 2.0):  # all lists long, some, none
        index = toxicity.BlockMaxIndex(vectors, 90, share)
        got = index.nearest(vectors[:60], 15, np.arange(60))
        for q in range(60):
            cosines = dense @ dense[q]
            cosines[q] = 0
            want = [i for i in np.lexsort((np.arange(700), -cosines.round(12)))[:15] if cosines[i] > 0]
            assert got[q][0].tolist() == want and np.allclose(got[q][1], cosines[want])


def test_toxicity_equals_brute_force(spark):
    """Term weights, cosines, votes and calibration of all documents, each written out anew."""
    import math

    docs, labels = toxic_corpus(spark)
    texts = {r["doc_id"]: Counter(w for w in (x.strip(toxicity.EDGE) for x in r["text"].lower().split()) if w) for r in docs.collect()}
    label = {r["doc_id"]: r["toxic"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    n, m, n1 = len(texts), len(label), sum(label.values())
    held = {w for i in label for w in texts[i]}

    def weight(w):
        if w not in held:
            return toxicity.FLOOR * math.log(n + 1)
        both, a = sum(w in texts[i] for i in label), sum(w in texts[i] for i in label if label[i])
        chi2 = m * (a * (m - n1) - (both - a) * n1) ** 2 / (n1 * (m - n1) * max(both, 0.5) * max(m - both, 0.5))
        return math.log((n + 1) / (sum(w in t for t in texts.values()) + 1)) * (toxicity.FLOOR + math.sqrt(min(1, max(chi2 - toxicity.CHANCE, 0) / m)))

    table = {w: weight(w) for w in {w for t in texts.values() for w in t}}
    vectors = {i: {w: (1 + math.log(c)) * table[w] for w, c in t.items()} for i, t in texts.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}

    def raw(i, skip):
        cosines = sorted(((sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) / norm[i] / norm[j], j) for j in label if j != skip), reverse=True)[:15]
        votes = [(c**2 / (1.05 - min(c, 1)), label[j]) for c, j in cosines if c > 0]
        return (sum(v * y for v, y in votes) + toxicity.PRIOR_WEIGHT * n1 / m) / (sum(v for v, _ in votes) + toxicity.PRIOR_WEIGHT)

    curve = toxicity.isotonic(np.array([raw(i, i) for i in label]), np.array([label[i] for i in label], float), np.ones(m))
    for i in texts:
        assert abs(got[i]["score"] - np.interp(raw(i, None), *curve)) < 1e-6


def test_isotonic_rises():
    x, y = toxicity.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert np.allclose(np.interp([0.1, 0.25, 0.4], x, y), [0, 0.5, 1])


def toxic_corpus(spark):
    import random

    rng = random.Random(0)
    from tests.llm.helpers import prose

    texts, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        words = prose(rng, 60).split()
        if bad:
            for w in rng.sample(["idiotic", "scummy", "worthless", "trashy"], 2):
                words.insert(rng.randint(0, 60), w)
        texts.append(" ".join(words))
        labels.append((i, 1, int(bad)))
    return frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = toxic_corpus(spark)
    got = toxicity.toxicity(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert [r["held_out"] for r in got] == [zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in got] and len(held) > 30
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["neighbours"] and r["terms"] for r in got if r["predicted"])
    # held-out labels are never read
    flipped = toxicity.toxicity(docs, labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic"))
    assert collect(flipped, "doc_id", "score") == sorted((r["doc_id"], r["score"]) for r in got)
    kept = {r["doc_id"] for r in toxicity.without_toxic(docs, labels).collect()}
    assert kept == {r["doc_id"] for r in got if not r["predicted"]}


def test_toxicity_without_labels(spark):
    docs, labels = toxic_corpus(spark)
    none = toxicity.toxicity(docs, labels.limit(0)).collect()
    assert len(none) == 300 and {r["score"] for r in none} == {0.0}


def test_odd_tables(spark):
    labels = spark.createDataFrame([(1, 0, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    model = tokenizer_file("piece_bpe_32k.model")
    for name, df in odd_frames(spark):
        for run in (lambda d: token_counts.token_counts(d, model), media.stored_digest, repetition.repetition_rules, lambda d: toxicity.toxicity(d, labels)):
            assert run(df).count() == df.count(), name
    pages = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], "page_id long, url string, html string")
    assert html_extract.main_text(pages).count() == 3 and html_extract.main_text(pages.limit(0)).count() == 0
