import html
import random
import unicodedata
from urllib.parse import parse_qs, unquote, urlsplit

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import keys, styles, text, tokenizers, vectors
from quarry.operators import html_tree as tree


def one(spark, column, **values):
    names = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("value", ["  a\t b \n", "\x1ca\x1f", "", " x y", "plain"])
def test_white_space_as_python(spark, value):
    assert one(spark, text.trim_white("v"), v=value) == value.strip()
    assert one(spark, text.collapse_white("v"), v=value) == " ".join(value.split())


@pytest.mark.parametrize("url", ["//e.org/w/index.php?title=Email_marketing&amp;oldid=814071202", "http://x/?a=1&title=A%20B_C%2525&title=z", "http://x/?title=", "http://x/", "http://x/?title=a+b", "x?subtitle=q&title=Z"])
def test_url_title(spark, url):
    value = parse_qs(urlsplit(html.unescape(url)).query).get("title", [""])[0]
    expected = unquote(value).replace("_", " ")
    assert one(spark, text.url_title("u"), u=url) == expected
    assert one(spark, text.url_title_tolerant("u"), u=url) == expected


def test_broken_escapes_need_the_tolerant_form(spark):
    assert one(spark, text.url_title_tolerant("u"), u="http://x/?title=%zz a") == "%zz a"


SIMPLE = "<H1> T <b>x</b> </H1> <P> A </P> body <Ul> x </Ul> tail <Ul> y </Ul> end"


def reference_content(s):
    a = s.find("<P>")
    b = s.find("</P>", a + 3) if a >= 0 else -1
    if b < 0:
        return ""
    begin, last = b + 4, s.rfind("</Ul>")
    second = s.rfind("</Ul>", 0, last) if last >= 0 else -1
    end = second if second >= 0 else last if last >= 0 else len(s)
    return s[begin:end] if end > begin else ""


@pytest.mark.parametrize("s", [SIMPLE, SIMPLE.replace("<Ul> y </Ul>", ""), "<P> A </P> rest", "no marks", "</Ul></Ul><P>a</P>b", "<P>x", "<P>a</P></Ul>b</Ul>c</Ul>"])
def test_content_after_abstract(spark, s):
    assert one(spark, text.content_after_abstract("s"), s=s) == reference_content(s)


def test_styles(spark):
    df = spark.createDataFrame([(SIMPLE, "", "http://x/?title=U_T")], "document_text string, document_title string, document_url string")
    get = lambda name, split="train": df.select(styles.style_column(name, split).alias("x")).first()[0]
    assert get("simplified") == SIMPLE
    assert get("simplenorm") == "T x A body x tail y end"
    assert get("title-abstract-content") == "T x A body x"
    assert get("ncinorm", "validation").startswith("U T A ")
    with pytest.raises(ValueError):
        styles.style_column("other")


def test_keys(spark):
    df = spark.createDataFrame([("HTTP://X", "Abc", 7)], "document_url string, document_text string, pageid long")
    get = lambda m: df.select(keys.key_for(m, df.columns).alias("x")).first()[0]
    assert get("url") != get("url-cased") and get("text4k") == get("full-text") and get("pageid") == "7"
    assert keys.key_for("none", []) is None
    for method in keys.METHODS:
        assert get(method) is not None
    with pytest.raises(ValueError):
        keys.key_for("nothing", [])


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), st.text(st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30))
def test_first_difference(spark, a, b):
    expected = None if a == b else next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert one(spark, text.first_difference("a", "b"), a=a, b=b) == expected


def test_difference_window(spark):
    shown = one(spark, text.difference_window("a", "b", F.lit(3), 2, 3), a="abcXdef", b="abcYd\nf")
    assert shown == "A: bcXde\nB: bcYd\\n\n     ^"


def test_byte_tokenizer(spark):
    for value in ("", "aé漢", "x" * 100):
        ids = one(spark, tokenizers.encode_column(F.col("v")), v=value)
        assert ids == tokenizers.BYTES.encode(value)
        assert tokenizers.BYTES.decode(ids) == value
    words = tokenizers.WordTokenizer(("a", "b"))
    assert one(spark, tokenizers.encode_column(F.col("v"), words), v="b x a") == [4, 2, 3]
    assert one(spark, tokenizers.round_trip_column(F.col("v"), words), v="b x a") == "b <unk> a"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], ["a", "b", "a"])], "u array<float>, z array<float>, p array<string>")
    row = df.select(vectors.l2_normalise(F.col("u")), vectors.l2_normalise(F.col("z")), vectors.squared_distance(F.col("u"), F.col("z")), vectors.reciprocal_rank(F.col("p"), F.lit("b"), 2), vectors.reciprocal_rank(F.col("p"), F.lit("b"), 1)).first()
    assert list(row) == [[0.6, 0.8], [0.0, 0.0], 25.0, 0.5, 0.0]


def normal(page, **kw):
    return tree.normalise(page, tree.page_tokens(page), **kw)[2]


def test_html_sections_and_intro():
    page = "<h1>T</h1>loose<table class='x metadata'><tr><td>m</td></tr></table><p>Intro <b>bold</b> text [edit]</p><table><tr><th>Born</th><td>1900</td></tr></table><div>d</div><h2>Life</h2><p>L</p><h2>See also</h2><p>gone</p><h2>Empty</h2>"
    assert normal(page) == "T\nIntro bold text \n\nBorn: 1900\n\nd\n\nLife\nL"
    assert "gone" not in normal(page) and "Empty" not in normal(page) and "\nm" not in normal(page) and "loose" not in normal(page)
    assert "Born" not in normal(page, remove_infobox=True)
    for title in tree.DROPPED_SECTIONS:
        assert "zzz" not in normal(f"<h1>T</h1><p>a</p><h2>{title.title()}</h2><p>zzz</p>")


def test_html_lists():
    body = lambda x: normal(f"<h1>T</h1><h2>L</h2>{x}").removeprefix("L\n").strip("\n")
    assert body("<ol start='3'><li>a<ul><li>b</li></ul></li><li>c</li></ol>") == "3. a\n  - b\n4. c"
    assert body("<dl><dt>x</dt><dt>y</dt><dd>z</dd><dd>w</dd><dt>q</dt></dl>") == "x: z\ny: z\nw\nq"


def table(x):
    return normal(f"<h1>T</h1><h2>L</h2><table>{x}</table>").removeprefix("L\n").strip("\n")


def test_html_tables():
    assert table("<tr><th>K</th></tr><tr><td>v</td></tr><tr><th>A</th><td>b</td><td>c</td></tr>") == "K: v\nA: b ; c"
    head = "<tr><th>N</th><th>M</th><th>O</th></tr>"
    long = "one two three four five six seven eight"
    assert table(head + f"<tr><td>{long}</td><td>y</td><td>z</td></tr>" * 2) == "\n".join([f"N: {long} ; M: y ; O: z"] * 2)
    cells = f"<tr><td>{long}</td><td>y</td><td>z</td></tr>"
    assert table(cells * 2) == "\n".join([f"{long} ; y ; z"] * 2)
    assert table("<tr><td>a</td></tr><tr><td>b</td></tr>") == "a\nb"
    spans = f"<tr><td rowspan='2'>{long}</td><td>y</td><td>z</td></tr><tr><td>p</td><td colspan='2'>q r</td><td>s</td></tr>"
    assert table(spans).splitlines()[1].startswith(f"{long} ; p ; q r ; q r ; s")


def test_html_spread_flushes_spans():
    cell = lambda rows, columns=1: tree.Cell(False, "x", columns, rows, [])
    a, b = cell(3), cell(1)
    assert tree.spread([[b, a]]) == [[b, a], [None, a], [None, a]]
    assert tree.spread([]) == []


def test_html_unicode_gaps_and_pronunciation():
    assert tree.clean_unicode("a ​ﬁ\x07\nb") == "a fi\nb"
    assert [tree.gap_separator(g) for g in ("", " ", "  ", "<b>", "<b> ", "</p><b>", "\n")] == ["", " ", "", "", " ", "\n", ""]
    words = tokenizers.WordTokenizer(("(film)", "Name", "is"))
    assert tree.without_pronunciation("Name (film) (nɛɪm) is", words) == "Name (film) is"
    assert list(tree.parentheses("a (b (c)) ) (d")) == [(2, 9)]
    assert unicodedata.normalize("NFKC", "ﬁ") == "fi"


def test_bytes_are_decoded_natively(spark):
    """Whole characters, ones cut by a limit, stray bytes and special ids, against Python's decoder."""
    rng = random.Random(3)
    cases = [list("aé𝄞\ud7ff\ue000".encode()), list("aé𝄞".encode())[:-1], [0xE2, 0x82, 0x41], [0xF0, 0x80, 0x80], [0xC0, 0xAF], [0xED, 0xA0, 0x80], [0xF4, 0x90, 0x80, 0x80], [0xFF], [], [0, 10, 13]]
    cases += [[rng.choice([rng.randrange(256), rng.randrange(0x80, 0xC0), 0xE2, 0xF0, 0x41]) for _ in range(rng.randrange(1, 12))] for _ in range(300)]
    rows = [(k, [i + 3 for i in c] + [1] * (k % 2)) for k, c in enumerate(cases)] + [(len(cases), None)]
    df = spark.createDataFrame(rows, "k int, ids array<int>").repartition(2)
    decoded = df.select("k", tokenizers.decode_column(F.col("ids")).alias("t"))
    assert "Python" not in decoded._jdf.queryExecution().toString()
    got = {r.k: r.t for r in decoded.collect()}
    assert got == {k: None if ids is None else tokenizers.BYTES.decode(ids) for k, ids in rows}
    with pytest.raises(Exception, match="no byte"):
        spark.createDataFrame([([259],)], "ids array<int>").select(tokenizers.decode_column(F.col("ids"))).collect()


def test_pages_are_rendered_one_at_a_time():
    import tracemalloc

    import pyarrow as pa
    body = "<h1>T</h1>" + "<!--" + "x" * 50_000 + "-->" + "<h2>A</h2><p>é</p>"
    pages = pa.array([body] * 600 + [None])
    tracemalloc.start()
    rows = tree._packed(len(pages), lambda k: (None, None, None) if pages[k].as_py() is None else tree.normalise(pages[k].as_py(), tree.page_tokens(pages[k].as_py())))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(rows) == 601 and rows[0].as_py() == {"tag": "htmlnorm-v1-infobox-none", "title": "T", "text": "A\né"} and rows[600].as_py() == {"tag": None, "title": None, "text": None}
    assert most < 5_000_000 < 600 * len(body)


def test_pages_made_from_few_files_are_dealt_out(spark):
    from quarry.plans import catalogue_layouts

    for name in ("html_sections", "html_tables", "html_lists", "html_intro"):
        assert getattr(catalogue_layouts, name)(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bytes_are_encoded_without_a_pattern(spark):
    values = ["", "a", "\x00\x7f", "é\n ", "ÿ", "ﬁ😀", "\u0085 x", " " * 3]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v string").coalesce(1)
    made = rows.select(tokenizers.encode_column(F.col("v")).alias("ids"))
    assert [r.ids for r in made.collect()] == [[b + 3 for b in v.encode()] for v in values] + [None]
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString()
