import hashlib
import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import html_text, lm_scoring, media
from quarry.llm.words import NOT_SPACE, batch_words
from tests.llm.fixtures import AWKWARD, documents, empty


def chain(rng, n):
    """Words that follow each other: a network that looks at neighbours can predict them."""
    out, k = [], rng.randrange(12)
    for _ in range(n):
        out.append(f"t{k}")
        k = (k + 1) % 12 if rng.random() < 0.95 else rng.randrange(12)
    return " ".join(out)


def test_pseudo_likelihood(spark):
    rng = random.Random(1)
    texts = [chain(rng, 400) for _ in range(60)]
    shuffled = texts[0].split()
    rng.shuffle(shuffled)
    docs = documents(spark, [*texts, " ".join(shuffled), *AWKWARD])
    words, net = lm_scoring.learn(docs.repartition(3))
    rows = {r.doc_id: r for r in lm_scoring.score(docs, words, net).collect()}
    assert rows[0].mean_log_probability > rows[60].mean_log_probability + 0.3
    for k, text in enumerate([*texts, " ".join(shuffled), *AWKWARD]):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        assert rows[k].n_words == n
        if n:
            assert math.isclose(rows[k].mean_log_probability * n, rows[k].log_likelihood, rel_tol=1e-9)
        else:
            assert rows[k].log_likelihood == 0 and rows[k].mean_log_probability is None
    assert lm_scoring.score(empty(spark), *lm_scoring.learn(empty(spark))).collect() == []


def word_hashes(text):
    w = next(batch_words(pa.array([text]), NOT_SPACE))
    return w.hashes()


def test_counts_cover_all_words(spark):
    counts = lm_scoring.count(documents(spark, ["a b a", None, "B c", ""]).repartition(2))
    a, b, c = word_hashes("a b c").view(np.int64).tolist()
    assert {r.hash: r.n for r in counts.collect()} == {a: 2, b: 2, c: 1}


def test_class_probabilities_sum_to_one():
    net = lm_scoring.Network.start(np.log(np.full(lm_scoring.CLASSES, 1 / lm_scoring.CLASSES)))
    around = np.tile(np.array([[1, 2, 3, lm_scoring.EDGE]]), (lm_scoring.CLASSES, 1))
    assert abs(np.exp(net.log_probability(around, np.arange(lm_scoring.CLASSES))).sum() - 1) < 1e-5


def test_shares_within_classes_sum_to_one(spark):
    texts = [" ".join(f"q{k % (k // 7 + 1)}" for k in range(3000))]
    words = lm_scoring.vocabulary(lm_scoring.count(documents(spark, texts)))
    hashes = np.unique(word_hashes(texts[0]))
    cls, share, rest = words.code(hashes)
    unseen = np.exp(-words.total)
    sums = np.bincount(cls, np.exp(share), words.prior.size)[words.own :] + unseen
    assert not rest.any() and np.allclose(sums, 1) and abs(np.exp(words.prior).sum() - 1) < 1e-9


def test_words_that_share_a_class_keep_their_counts(spark, monkeypatch):
    """Classes grow with the number of words; each word has its own count, whether it is sent to all tasks or joined."""
    n = 150_000
    texts = [" ".join(f"r{k}" for k in range(lo, min(lo + 2000, n))) for lo in range(0, n, 2000)]
    counts = lm_scoring.count(documents(spark, [*texts, "R7 r8 r7"]).repartition(3))
    r7, r8 = word_hashes("r7 r8").view(np.int64).tolist()
    assert counts.count() == n and {r.hash: r.n for r in counts.where("n > 1").collect()} == {r7: 3, r8: 2}
    words = lm_scoring.vocabulary(counts)
    assert words.prior.size > 4 * lm_scoring.CLASSES and words.size == n + 3 and abs(np.exp(words.prior).sum() - 1) < 1e-3
    monkeypatch.setattr(lm_scoring, "KNOWN", 100)
    few = lm_scoring.vocabulary(counts)
    assert few.hashes.size == 2 and few.code(word_hashes("r7 r9"))[2].tolist() == [False, True]


@pytest.mark.parametrize("known", [1 << 18, 60])
def test_scores_against_loops(spark, monkeypatch, known):
    """Every scored document once more, word by word, from the spellings' counts and the network's weights."""
    monkeypatch.setattr(lm_scoring, "KNOWN", known)
    rng = random.Random(3)
    texts = [" ".join(f"v{int(rng.paretovariate(0.4)) % 5000}" for _ in range(300)) for _ in range(40)]
    docs = documents(spark, [*texts, "never seen before"])
    words, net = lm_scoring.learn(documents(spark, texts).repartition(3))
    seen = {}
    for word in " ".join(texts).split():
        seen[word] = seen.get(word, 0) + 1
    own_words = sorted(seen, key=lambda x: (-seen[x], int(word_hashes(x)[0])))[: words.own]
    own = {w: k for k, w in enumerate(own_words)}
    shared = words.total.size
    cls = {w: own.get(w, words.own + int(word_hashes(w)[0] >> np.uint64(32)) % shared) for w in [*seen, "never", "before"]}
    weight = [1.0] * shared
    for w, n in seen.items():
        if w not in own:
            weight[cls[w] - words.own] += n + 1
    places = net.inner_bias.shape[1]

    def log_softmax(z, k):
        z = z.astype(float)
        return z[k] - z.max() - math.log(np.exp(z - z.max()).sum())

    got = {r.doc_id: r.log_likelihood for r in lm_scoring.score(docs.repartition(2), words, net).collect()}
    for k, text in [*enumerate(texts[:6]), (40, "never seen before")]:
        line, total = text.split(), 0.0
        ids = [cls.get(w, words.own + int(word_hashes(w)[0] >> np.uint64(32)) % shared) for w in line]
        for i, c in enumerate(ids):
            sides = [ids[i + d] if 0 <= i + d < len(ids) else lm_scoring.EDGE for d in (-2, -1, 1, 2)]
            h = np.tanh(sum(net.tables[j][x] for j, x in enumerate(sides)))
            total += log_softmax(h @ net.out + net.bias, c // places) + log_softmax(h @ net.inner[c // places] + net.inner_bias[c // places], c % places)
            if c >= words.own:
                total += math.log(seen.get(line[i], 0) + 1) - math.log(weight[c - words.own])
        assert math.isclose(got[k], total, rel_tol=1e-5), k


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "GROUP_WORDS", 3000)
    monkeypatch.setattr(lm_scoring, "WORDS_A_WEIGHT", 0)
    monkeypatch.setattr(lm_scoring, "AVERAGED", 2)
    rng = random.Random(4)
    docs = documents(spark, [chain(rng, rng.choice([5, 300])) for _ in range(90)])
    found = [{r.doc_id: r.mean_log_probability for r in lm_scoring.score_corpus(docs.repartition(n)).collect()} for n in (1, 8)]
    assert max(abs(found[0][k] - found[1][k]) for k in found[0]) < 1e-6


def test_every_word_is_a_target_once(spark):
    """A group's network has stepped through all words of its documents, in the order of their hashes, in batches that hold each once."""
    texts = ["one", "two words", None, "", " ".join(f"m{k % 700}" for k in range(9001))]
    docs = documents(spark, texts)
    words = lm_scoring.vocabulary(lm_scoring.count(docs))
    coded = lm_scoring.encode(docs, words)
    net = lm_scoring.train(coded, words)
    once = lm_scoring.Network.start(words.prior)
    rows = [np.frombuffer(bytes(r.classes), words.kind).astype(np.int64) for r in coded.where("n > 0").orderBy("ord").collect()]
    own = np.concatenate(rows)
    around = lm_scoring.contexts(own, np.repeat(np.arange(len(rows)), [r.size for r in rows]))
    assert own.size == 9004 == words.size
    for lo in range(0, own.size, lm_scoring.BATCH):
        once.descend(around[lo : lo + lm_scoring.BATCH], own[lo : lo + lm_scoring.BATCH], 1 / (1 + lo / 200_000))
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(net.parts(), once.parts()))


def test_contexts_stay_in_their_text():
    edge = lm_scoring.EDGE
    around = lm_scoring.contexts(np.array([5, 6, 7, 8]), np.array([0, 0, 0, 2]))
    assert around.tolist() == [[edge, edge, 6, 7], [edge, 5, 7, edge], [5, 6, edge, edge], [edge] * 4]


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body><header>site</header><nav><ul><li>menu</li></ul></nav>'
    '<div class="cookie-notice">cookies</div><aside>side</aside><!-- <p>no</p> --><article><h1>Head &amp; tail</h1><p>One  <b>two</b>\n three<p>Four&nbsp;five<br>six</p>'
    '<div class="ad">buy</div><form><p>mail?</p></form></article><section id="comments"><article class="comment"><p>first!</p></article></section><footer>&copy; site'
)


def test_article_of_a_page():
    assert html_text.main_text(html_text.blocks(PAGE), None) == "Head & tail\nOne two three\nFour five\nsix"
    assert html_text.main_text(html_text.blocks(None), None) == "" == html_text.main_text(html_text.blocks("<nav>x</nav>"), None)
    assert html_text.main_text(html_text.blocks("plain a < b"), None) == "plain a < b"
    assert html_text.main_text(html_text.blocks("<p class=ad>x<p>y"), None) == "y"
    assert html_text.main_text(html_text.blocks("<p>&am<b></b>p; &amp;lt; a&nbsp;b"), None) == "&amp; &lt; a b"


def test_names_that_only_contain_a_frame_word_hide_nothing():
    for name in ("layout has-sidebar", "wrapper with-sidebar", "single post comments-open", "content side-by-side", "sidebar"):
        page = f'<body><div class="{name}"><nav>menu</nav><article><p>the story</p><div class="ad">buy</div></article></div></body>'
        assert html_text.main_text(html_text.blocks(page), None) == "the story", name
    assert html_text.blocks('<form><div class="sidebar">x</div><main><p>y</p></main></form>') == [("y", 1)]
    for name in ("ad", "cookie-notice", "site-header", "nav2", "widget_area left", "x related-posts"):
        assert html_text.blocks(f'<div class="{name}">frame</div><p>text</p>') == [("text", 0)], name
    assert html_text.main_text(html_text.blocks('<article>a</article><div id="comments"><article>first!</article></div>'), None) == "a"


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_lines_are_a_longest_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        shared = html_text.common_lines(a, b)
        kept = [x for x, s in zip(a, shared) if s]
        assert len(kept) == lcs(a, b)
        rest = iter(b)
        assert all(any(y == x for y in rest) for x in kept)


def test_differencing_of_pages_without_an_article(spark):
    frame = "<p>Welcome to our site</p>{}<p>All about us</p>"
    pages = [(k, f"https://h.example/{d}/{k}", frame.format(f"<p>story {k}</p>")) for k, d in ((1, "a"), (2, "a"), (3, "b"))] + [
        (4, "https://alone.example/x", frame.format("<p>alone</p>")), (5, None, None), (6, "u", ""), (6, "u", ""), (7, "https://g.example/a/7", PAGE),
    ]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string").repartition(3)
    rows = sorted(html_text.extract(table).collect(), key=lambda r: r.page_id)
    assert [r.page_id for r in rows] == [1, 2, 3, 4, 5, 6, 6, 7]
    got = {r.page_id: r.text for r in rows}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        one = {r.page_id: r.text for r in html_text.extract(table.coalesce(1)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one[1] == "story 1" and one[2] == "story 2" and one[3].endswith("story 3")
    assert got[4] == "Welcome to our site\nalone\nAll about us" and got[5] == got[6] == ""
    assert got[7].startswith("Head & tail") and all(r.n_chars == len(r.text) for r in rows)
    assert html_text.extract(table.where("false")).collect() == []


def test_pairs_do_not_depend_on_ranges(spark):
    pages = [(k, f"https://h.example/{k // 5:02d}/{k}", f"<p>Welcome</p><p>story {k}</p><p>Section {k // 5}</p>") for k in range(60)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = []
    for n in ("1", "7", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found.append(sorted(tuple(r) for r in html_text.extract(table).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] == found[2] and len(found[0]) == 60
    assert all("Welcome" not in r[2] and "story" in r[2] for r in found[0])


def test_a_copy_does_not_empty_a_page(spark):
    page = "<p>Welcome</p><p>story {}</p>".format
    pages = [(1, "https://h.example/a/1", page(1)), (2, "https://h.example/a/1", page(1)), (3, "https://h.example/a/3", page(3))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(f"story {1 if k < 3 else 3}" in t for k, t in got.items()) and len(got) == 3


def test_media_round_trip(spark):
    texts = [*AWKWARD, "a" * 64, "b" * 63, "ü" * 32]
    rows = {r.doc_id: r for r in media.document_media(documents(spark, texts).repartition(3)).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        raw = (text or "").encode()
        full = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        stored = media.to_sound(full)
        assert media.from_sound(stored) == full
        r = rows[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(full), hashlib.sha256(full).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) == (zlib.crc32(full[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), media.feature(full))
    docs = documents(spark, ["x", "x"])
    assert media.document_media(docs.unionAll(docs)).count() == 4
    assert media.document_media(empty(spark)).collect() == []


def test_sequences_keep_order_positions_and_captions(spark):
    page = '<p>Before</p><figure><img src="media:d1" alt="x"><figcaption>First &amp; best</figcaption></figure><p>Between<img data-digest=d2 alt=second>after</p><img src="media:missing">'
    sequences = media.parse_sequences(spark.createDataFrame([(1, page), (2, None), (1, "only text")], "doc_id long, html string"))
    stored = spark.createDataFrame([("d1", 1), ("d2", 2)], "digest string, payload_bytes long")
    rows = media.gather(media.resolve(sequences, stored)).collect()
    got = [[(i.position, i.kind, i.text, i.caption, i.payload_bytes) for i in r["items"]] for r in rows]
    full = next(g for g in got if len(g) > 1)
    assert full == [
        (0, "text", "Before", None, None), (1, "media", None, "First & best", 1), (2, "text", "Between", None, None), (3, "media", None, "second", 2), (4, "text", "after", None, None), (5, "media", None, None, None),
    ]


def test_names_hide_no_text_of_an_article():
    """Ids are often slugs of headings; only known blocks go, whole."""
    shown = lambda page: html_text.main_text(html_text.blocks(page), None)
    slugs = '<article><h1>T</h1><h2 id="discussion">Discussion</h2><p>a</p><h2 id="related-links">Related</h2><p>b</p><h3 id="search">Search</h3><p>c</p></article>'
    assert shown(slugs) == "T\nDiscussion\na\nRelated\nb\nSearch\nc"
    named = '<article><p id="alert">x</p><p id="navigation">n</p><div class="discussion">d</div><section id="related">r</section><section id="comments">s</section><li class="menu">l</li></article>'
    assert shown(named) == "x\nn\nd\nr\ns\nl"
    for gone in ('<div class="comments">no</div>', '<div id="comments">no</div>', '<ul class="share-buttons"><li>no</ul>', '<section class="newsletter-signup">no</section>', '<div class="ad-slot">no</div>', "<form>no</form>", "<aside>no</aside>", "<nav>no</nav>"):
        assert shown(f"<article><p>yes</p>{gone}<p>too</p></article>") == "yes\ntoo"
    assert shown("<main><p>intro</p><article>body</article><p>end</p></main><p>no</p>") == "intro\nbody\nend"


def test_stray_end_tags_cost_no_more_than_their_number():
    import time

    html_text.blocks("<div>" * 100 + "</b>" * 100)
    began = time.perf_counter()
    html_text.blocks("<div>" * 40_000 + "</b>" * 40_000)
    assert time.perf_counter() - began < 5  # a scan of all open elements for each would take minutes


class _Plain(HTMLParser):
    """The article of a page by the standard library's parser: the text of `article`, less elements that hold no text of it."""

    DROP = frozenset("nav header footer aside form script style noscript button template svg head".split())
    LINES = frozenset("p div h1 h2 h3 h4 h5 h6 li ul ol table tr td th blockquote pre section article br figure figcaption hr dl dt dd tbody thead".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside = self.dropped = 0
        self.stack, self.lines = [], [""]

    def handle_starttag(self, tag, attrs):
        if tag in self.LINES:
            self.lines.append("")
        if tag in html_text.VOID:
            return
        names = dict(attrs).get("class") or ""
        drop = bool(self.dropped) or (tag in self.DROP and not (tag == "header" and self.inside)) or (tag in ("div", "section", "ul", "ol") and bool(re.search(r"comment|share|advert|newsletter|\bad\b|ad-|promo|cookie", names)))
        self.stack.append((tag, drop, tag == "article" and not drop))
        self.dropped += drop
        self.inside += self.stack[-1][2]

    def handle_endtag(self, tag):
        if tag in self.LINES:
            self.lines.append("")
        if any(t == tag for t, _, _ in self.stack):
            while self.stack:
                t, drop, article = self.stack.pop()
                self.dropped -= drop
                self.inside -= article
                if t == tag:
                    break

    def handle_data(self, data):
        if self.inside and not self.dropped:
            self.lines[-1] += data


def test_whole_pages_against_an_independent_parser(spark):
    """Words of the article, page by page, on all pages of the smallest tables."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    same = 0
    for r in rows.collect():
        p = _Plain()
        p.feed(r.html)
        p.close()
        want = "\n".join(line for x in p.lines if (line := " ".join(x.split())))
        same += got[r.page_id].split() == want.split()
    assert same == rows.count()


def test_only_hosts_with_undeclared_pages_are_sorted(spark):
    frame = "<p>menu one</p><p>menu two</p>"
    undeclared = [(k, f"http://a/x/{k}", f"<body>{frame}<p>text {k}</p></body>") for k in range(6)]
    declared = [(10 + k, f"http://{'ab'[k % 2]}/y/{k}", f"<body>{frame}<article>own {k}</article></body>") for k in range(6)]
    df = spark.createDataFrame(undeclared + declared, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    assert got == {**{k: f"text {k}" for k in range(6)}, **{10 + k: f"own {k}" for k in range(6)}}
    some = spark.createDataFrame(declared, "page_id long, url string, html string")
    assert "RANGE" not in html_text.extract(some)._jdf.queryExecution().optimizedPlan().toString().upper()


def test_every_page_is_differenced(spark, monkeypatch):
    """A declared article is checked against what its neighbour leaves of the page, it takes no way of its own."""
    page = "<nav><p>menu</p></nav><article><p>Author of the month</p></article><article><p>story {}</p><p>Read on</p></article><footer><p>us</p></footer>".format
    one, two = (html_text.page_lines(page(k)) for k in (1, 2))
    assert [s for s, m in one if m == html_text.FRAME_LINE] == ["menu", "us"]
    aligned, common_lines = [], html_text.common_lines
    monkeypatch.setattr(html_text, "common_lines", lambda a, b: aligned.append(a) or common_lines(a, b))
    # What both have of an article comes back with it, an article that both have does not.
    assert html_text.main_text(one, two) == "story 1\nRead on"
    assert aligned == [["menu", "Author of the month", "story 1", "Read on", "us"]]
    only, both = (html_text.page_lines(f"<p>top</p><article>A</article>{x}") for x in ("", "<article>B</article>"))
    # A page of that article alone doesn't make it frame; nor is an article lost that both have whole.
    assert html_text.main_text(only, both) == "A" and html_text.main_text(both, only) == "A\nB" == html_text.main_text(both, None)
    # Versions of a page, and an article in pieces that only classes name, stay whole.
    first, second = (html_text.page_lines(f"<article><p>a</p><p>b</p><p>c{k}</p></article><article>d</article>") for k in (1, 2))
    assert html_text.main_text(first, second) == "a\nb\nc1\nd"
    first, second = (html_text.page_lines(f'<div class="article-body">a{k}</div><p>x</p><div class="article-body">b</div>') for k in (1, 2))
    assert html_text.main_text(first, second) == "a1\nb"
    assert len(aligned) == 5
    table = spark.createDataFrame([(k, f"https://h.example/{k}", page(k)) for k in range(40)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extract(table.repartition(5)).collect()} == {k: f"story {k}\nRead on" for k in range(40)}


def test_a_copy_in_another_frame_does_not_empty_a_page(spark):
    page = "<p>Welcome</p><p>story {}</p><footer><p>seen {} times</p></footer>".format
    pages = [(1, "https://h.example/a/1", page(1, 8)), (2, "https://h.example/a/1", page(1, 9)), (3, "https://h.example/a/3", page(3, 8))]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(f"story {1 if k < 3 else 3}" in t and "seen" not in t for k, t in got.items()) and len(got) == 3


def test_common_lines_of_long_pages():
    rng = random.Random(2)
    for n, letters in ((150, "ab"), (200, "abcdefgh"), (129, "abcdefghijklmnopqrstuvwxyz")):
        a, b = ([rng.choice(letters) for _ in range(rng.randrange(n // 2, n))] for _ in range(2))
        a[::7] = [f"own {k}" for k in range(len(a[::7]))]
        kept = [x for x, s in zip(a, html_text.common_lines(a, b)) if s]
        rest = iter(b)
        assert len(kept) == lcs(a, b) and all(any(y == x for y in rest) for x in kept)
