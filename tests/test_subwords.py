"""Subword ids against a public WordPiece model, and the places that take a vocabulary."""

import random
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, decoders, models, normalizers, pre_tokenizers

from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, Corpus
from quarry.functions import keys
from quarry.functions.trie import DoubleArray
from quarry.operators import subwords, tokens
from quarry.operators.subwords import Vocabulary

WORDS = ["the", "un", "want", "able", "##able", "##ed", "##want", "run", "##ning", "##s", "cafe", "don", "t", "'", ",", ".", "!", "?", "-", "a", "##b", "##c", "b", "c", "漢", "字", "x", "##x"]
PIECES = ["[PAD]", "[UNK]", "[SEP]", *WORDS]
V = Vocabulary(tuple(PIECES), tuple(range(len(PIECES))))


def model():
    t = Tokenizer(models.WordPiece({p: k for k, p in enumerate(PIECES)}, unk_token="[UNK]", max_input_chars_per_word=100))
    t.normalizer = normalizers.BertNormalizer(clean_text=True, handle_chinese_chars=True, strip_accents=True, lowercase=True)
    t.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    t.decoder = decoders.WordPiece(prefix="##", cleanup=False)
    return t


def texts():
    rng = random.Random(1)
    parts = ["the", "unwanted", "runnings", "Café", "don't", "漢字", "xyz", "abc", "abx", ",", " ", "  ", "\n", "\t", "!", "-", "un", "é", "x" * 101, "xx", "​", "\x07", " ", "the,", "İ", "ß", "«a»"]
    return ["", " ", "The unwanted, don't!", *[" ".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(150)], *["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(150)]]


def test_ids_are_those_of_a_public_model(spark):
    given = [t for t in texts() if "İ" not in t]  # lower case of one letter as two, which libraries do differently
    df = spark.createDataFrame(list(enumerate(given)) + [(-1, None)], "k int, text string")
    got = {r["k"]: (r["ids"], r["text"]) for r in subwords.with_ids(df, "text", V, shown="shown").select("k", "ids", F.array_join("shown", " ").alias("text")).collect()}
    reference = model()
    assert got.pop(-1) == ([], "")
    for k, t in enumerate(given):
        ids = reference.encode(t, add_special_tokens=False).ids
        assert got[k][0] == ids, t
        if "[UNK]" not in got[k][1]:
            assert got[k][1] == reference.decode(ids, skip_special_tokens=False), t


def test_words_are_joined_to_texts(spark):
    df = spark.createDataFrame([(["don", "'", "t", ",", "the", "run", "."],), ([],), (["a", "'", "s", "?"],)], "w array<string>")
    assert [r[0] for r in df.select(subwords.shown_text("w")).collect()] == ["don't, the run.", "", "a's?"]


def test_whole_rows_and_short_ones_agree(spark):
    given = texts()
    df = spark.createDataFrame(list(enumerate(given)), "k int, text string").repartition(4)
    whole = {r["k"]: r["ids"] for r in subwords.encode(df.withColumn("w", V.words("text")), ["k"], "w", V).collect()}
    assert whole == {r["k"]: r["ids"] for r in subwords.with_ids(df, "text", V).collect()}
    cut = {r["k"]: r["ids"] for r in subwords.with_ids(df, "text", V, most=3).collect()}
    assert all(whole[k][: len(v)] == v and len(v) >= min(3, len(whole[k])) for k, v in cut.items() if "́" not in given[k])


def test_ends_of_words_cased_texts_and_broken_vocabularies(spark):
    pieces = ["<unk>", "</s>", "lo", "low</w>", "l", "o", "w</w>", "er</w>", "L"]
    v = Vocabulary(tuple(pieces), tuple(range(len(pieces))), unknown="<unk>", end="</s>", continuation="", word_end="</w>", lower=False)
    df = spark.createDataFrame([(0, "low lower Low q")], "k int, text string")
    assert subwords.with_ids(df, "text", v).first()["ids"] == [3, 0, 8, 5, 6, 0]  # no piece goes on after lo in `lower`
    pieces += ["w"]
    v = Vocabulary(tuple(pieces), tuple(range(len(pieces))), unknown="<unk>", end="</s>", continuation="", word_end="</w>", lower=False)
    row = subwords.with_text(subwords.with_ids(df, "text", v), "ids", v, "back").first()
    assert row["ids"] == [3, 2, 9, 7, 8, 5, 6, 0] and row["back"] == "low lower Low"
    with pytest.raises(ValueError):
        Vocabulary(("a",), (0,)).unk_id
    with pytest.raises(ValueError):
        V.encode("é")
    assert V.encode("The unwanted!") == model().encode("The unwanted!", add_special_tokens=False).ids


def test_vocabulary_from_a_file(spark, tmp_path):
    (tmp_path / "v.txt").write_text("\n".join(PIECES) + "\n")
    v = Vocabulary.read(spark, str(tmp_path / "v.txt"))
    assert v == V and v.eos_id == 2 and v.unk_id == 1 and v.vocab_size == len(PIECES)


def test_trie_holds_what_it_was_given():
    rng = random.Random(3)
    entries = {bytes(rng.choices(b"abc\xff\x00", k=rng.randint(1, 7))): k for k in range(3000)}
    entries = {k: n for n, k in enumerate(entries)}
    trie = DoubleArray.of(entries)
    import numpy as np

    for probe in list(entries)[:500] + [bytes(rng.choices(b"abcd\xff", k=9)) for _ in range(500)]:
        best = max((k for k in entries if probe.startswith(k)), key=len, default=None)
        value, end = trie.longest(np.frombuffer(probe, np.uint8), np.array([0]), np.array([len(probe)]), 0)
        assert (value[0], end[0]) == ((entries[best], len(best)) if best is not None else (-1, 0))
    assert DoubleArray.of({}).longest(np.array([1], np.uint8), np.array([0]), np.array([1]), 0)[0][0] == -1


def test_each_different_word_is_matched_once(spark):
    """The matcher sees a table of different words, whatever the number of texts."""
    df = spark.createDataFrame([(k, "the run the a") for k in range(500)], "k int, text string").repartition(4)
    plan = subwords.with_ids(df, "text", V)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert below.splitlines()[1].lstrip(" :+-").startswith("Aggregate [word")


def test_keys_and_token_columns(spark):
    rows = spark.createDataFrame([("The Unwanted <H1> Café </H1>", "http://x/?title=Don%27t", "t")] * 2 + [("the unwanted <H1> cafe </H1>", "http://x/?title=don%27t", "t")], "document_text string, document_url string, split string")
    for method in ("tokens-32", "ncititle", "nci-h1"):
        made = keys.with_subwords(rows, method, V)
        assert made.select(keys.key_for(method, made.columns, V).alias("k")).distinct().count() == 1
    with pytest.raises(ValueError, match="with_subwords"):
        keys.key_for("nci-h1", rows.columns, V)
    docs = spark.createDataFrame([("1", "document", "the unwanted run the a"), ("2", "document", "")], "docid string, kind string, text string")
    queries = spark.createDataFrame([("1", "query", "the run")], "docid string, kind string, text string")
    c = Corpus({DOCUMENTS: docs, TRAIN_QUERIES: queries})
    out = tokens.tokenise(c, V, document_max=3, query_max=2, rewrite_text=True, drop_text=False)
    got = {(r["docid"], r["kind"]): (r["text_tokens"], r["text"]) for s in out for r in out[s].collect()}
    the, un, want, run = (V.id_of(p) for p in ("the", "un", "##want", "run"))
    assert got == {("1", "document"): ([the, un, want, 2], "the unwant"), ("2", "document"): ([2], ""), ("1", "query"): ([the, run, 2], "the run")}
    with pytest.raises(Exception, match="more than 1 tokens"):
        tokens.tokenise(c, V, query_max=1)[TRAIN_QUERIES].collect()


def test_normalised_words_are_matched_without_accents():
    ids, shown = V.matcher().match(pa.array(["café", "́", "", "x" * 101, "abq"]))
    assert ids.to_pylist() == [[V.id_of("cafe")], [], [], [1], [1]] and shown.to_pylist() == ["cafe", None, None, "[UNK]", "[UNK]"]
    assert unicodedata.normalize("NFD", "é")[0] == "e"


def test_words_of_whole_texts_are_not_shuffled(spark):
    """The words of a batch are matched where their rows lie; rows that are empty or null have no ids."""
    texts = [("the unwanted run " * (k % 7) + ("zz é" if k % 3 else "")) if k % 5 else None for k in range(1203)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").withColumn("w", V.words("text"))
    got = subwords.encode(df.unionByName(df.where("k = 7").withColumns({"k": F.lit(-1), "w": F.lit(None).cast("array<string>")})), ["k"], "w", V)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r["k"]: (r["ids"], r["shown"]) for r in got.collect()}
    assert found.pop(-1) == ([], [])
    assert found == {r["k"]: (r["ids"], r["shown"]) for r in subwords._joined(df, ["k"], "w", V).collect()}
