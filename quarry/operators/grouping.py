"""Deduplication, counts and other aggregations of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.corpus import DOCUMENTS, TRAIN_QUERIES, VALIDATION_QUERIES, Corpus
from quarry.functions.ordinals import ORD, with_dense_order
from quarry.storage import materialise


def _number(groups: DataFrame, first: str) -> DataFrame:
    """docid = 0, 1, … as text in the order of each group's first row. Only the table of groups is ranked, in parallel."""
    return with_dense_order(groups, [first], "_n").withColumn("docid", F.col("_n").cast("string")).drop("_n")


def group_by_key(rows: DataFrame, key: Column, order: Column, source: Column, carry: list[str], sources: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, queries) of a stream of examples in which the first example of a key makes its document.

    documents: docid, n_examples, the first example's `carry` columns. queries: every example with the docid of its key. Large groups
    never gather their texts: only the first example's are picked, by a combiner. `sources=True` adds source_ids (distinct, in order
    of arrival) as a list in one row, for layouts that want it; `source_id_pages` has them for groups of any size.
    """
    keyed = rows.withColumn("_key", key).withColumn(ORD, order).withColumn("_source", source.cast("string"))
    listed = [F.array_sort(F.collect_list(F.struct(F.col(ORD).alias("o"), F.col("_source").alias("s")))).alias("_sources")] if sources else []
    groups = keyed.groupBy("_key").agg(F.min(ORD).alias("_first"), F.count("*").alias("n_examples"), F.min_by(F.struct(*carry), F.col(ORD)).alias("_row"), *listed)
    numbered = _number(groups, "_first")
    distinct = [F.array_distinct(F.transform("_sources", lambda s: s["s"])).alias("source_ids")] if sources else []
    documents = numbered.select("docid", *distinct, "n_examples", F.col("_row.*"))
    queries = keyed.join(numbered.select("_key", "docid"), "_key").drop("_key", ORD, "_source")
    return documents, queries


def source_id_pages(rows: DataFrame, key: list[str], order: str, source: str, size: int = 1000) -> DataFrame:
    """key, page (0, 1, ...), source_ids: the distinct sources of each key in the order of their first row, `size` to a page.

    A range sort over (key, order) numbers all sources; less the number of its key's first one, that is a source's place in its key.
    A hot key is so cut over many tasks, and no row holds more than a page.
    """
    if size < 1:
        raise ValueError("a page holds one source at least")
    distinct = rows.select(*key, F.col(source).cast("string").alias("_source"), F.col(order).alias("_o")).groupBy(*key, "_source").agg(F.min("_o").alias("_o"))
    placed = with_dense_order(distinct, [*key, "_o", "_source"], "_n")
    starts = placed.groupBy(*key).agg(F.min("_n").alias("_start"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    on = same[0]
    for more in same[1:]:
        on = on & more
    joined = placed.alias("a").join(starts.alias("b"), on).select(*[F.col(f"a.{k}").alias(k) for k in key], "_source", (F.col("_n") - F.col("_start")).alias("_place"))
    paged = joined.groupBy(*key, F.floor(F.col("_place") / size).cast("long").alias("page")).agg(F.array_sort(F.collect_list(F.struct("_place", "_source"))).alias("_all"))
    return paged.select(*key, "page", F.transform("_all", lambda x: x["_source"]).alias("source_ids"))


def split_order(split: Column, order: Column, first: str = "validation") -> Column:
    """Arrival order of prepared examples: one split wholly ahead of the other. Validation examples claim documents first."""
    return F.struct(F.when(split == first, 0).otherwise(1).alias("s"), order.alias("o"))


def number_without_grouping(train: DataFrame, validation: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Every example its own document: ordinals of train from 0, then those of validation, the opposite of the grouped order."""
    one = with_dense_order(train, order, "_n")
    offset = train.agg(F.count("*").alias("_offset"))
    two = with_dense_order(validation, order, "_n").join(F.broadcast(offset))  # one row
    return one.withColumn("docid", F.col("_n").cast("string")).drop("_n"), two.withColumn("docid", (F.col("_n") + F.col("_offset")).cast("string")).drop("_n", "_offset")


def corpus_stats(corpora: dict[str, Corpus]) -> DataFrame:
    """split_set, documents, train_pairs, validation_pairs."""
    out = None
    for name, corpus in corpora.items():
        counts = [corpus[s].agg(F.count("*").alias(c)) for s, c in ((DOCUMENTS, "documents"), (TRAIN_QUERIES, "train_pairs"), (VALIDATION_QUERIES, "validation_pairs"))]
        row = counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2])).select(F.lit(name).alias("split_set"), "*")  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def render_stats(stats: DataFrame) -> str:
    """The statistics as a framed table with thousands separators."""
    head = ["", "|D|", "train", "val"]
    body = [[r[0], *[f"{n:,}" for n in r[1:]]] for r in stats.collect()]  # one row for each split set
    width = [max(len(row[k]) for row in [head, *body]) for k in range(4)]
    line = lambda row: "│ " + " │ ".join(v.ljust(w) if k == 0 else v.rjust(w) for k, (v, w) in enumerate(zip(row, width))) + " │"
    rule = lambda a, b, c: a + b.join("─" * (w + 2) for w in width) + c
    return "\n".join([rule("┌", "┬", "┐"), line(head), rule("├", "┼", "┤"), *map(line, body), rule("└", "┴", "┘")])


def unique_counts(rows: DataFrame, keys: dict[str, Column], split: str = "split") -> DataFrame:
    """method, n_train, n_validation, n_union: distinct keys of each method, from one pass that expands rows by method."""
    named = F.array(*[F.struct(F.lit(m).alias("method"), k.alias("key")) for m, k in keys.items()])
    pairs = rows.select(split, F.inline(named)).distinct()
    sides = pairs.groupBy("method", "key").agg(F.max((F.col(split) == "train").cast("int")).alias("t"), F.max((F.col(split) == "validation").cast("int")).alias("v"))
    return sides.groupBy("method").agg(F.sum("t").cast("long").alias("n_train"), F.sum("v").cast("long").alias("n_validation"), F.count("*").alias("n_union"))


def keys_with_many_texts(rows: DataFrame, key: list[str], text: str, n: int) -> DataFrame:
    """The n keys with most different texts, at least two: key columns, n_texts, and the shortest and the longest text's length."""
    texts = rows.select(*key, F.md5(text).alias("_md5"), F.length(text).alias("_len")).distinct()
    found = texts.groupBy(*key).agg(F.count("*").alias("n_texts"), F.min("_len").cast("long").alias("shortest"), F.max("_len").cast("long").alias("longest"))
    return found.where("n_texts > 1").orderBy(F.desc("n_texts"), *key).limit(n)


def extreme_texts(rows: DataFrame, key: list[str], text: str, order: str, mode: str = "extremes", most_winners: int = 100_000) -> DataFrame:
    """Two texts of each key: the first two different ones, or the shortest and the longest (ties by the earlier).

    Winners are chosen by digest, length and place alone; only then their texts are fetched. Two rows a key are sent to all tasks as
    long as there are at most `most_winners`; beyond that they are joined by a shuffle. `order` tells the rows of a key apart.
    """
    slim = rows.select(*key, F.md5(text).alias("_digest"), F.length(text).alias("_n"), F.col(order).alias("_o"))
    first = slim.groupBy(*key, "_digest").agg(F.min_by("_n", "_o").alias("_n"), F.min("_o").alias("_o"))
    if mode == "extremes":
        best = first.groupBy(*key).agg(F.min_by("_o", F.struct("_n", "_o")).alias("_a"), F.min_by("_o", F.struct(-F.col("_n"), F.col("_o"))).alias("_b"))
    else:
        # The two least places of each key, by two aggregates with combiners.
        least = first.groupBy(*key).agg(F.min("_o").alias("_a"))
        same = [F.col(f"f.{k}").eqNullSafe(F.col(f"l.{k}")) for k in key]
        on = F.col("f._o") > F.col("l._a")
        for more in same:
            on = on & more
        best = first.alias("f").join(least.alias("l"), on).groupBy(*[F.col(f"f.{k}").alias(k) for k in key], "_a").agg(F.min("f._o").alias("_b"))
    numbered = materialise(best.withColumn("_row", F.monotonically_increasing_id()), "winners")
    sides = F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"_{s}").alias("o")) for s in ("a", "b")])
    winners = numbered.select("_row", *[F.col(k).alias(f"_of_{i}") for i, k in enumerate(key)], F.explode(sides).alias("_w"))
    winners = F.broadcast(winners) if numbered.count() <= most_winners else winners
    on = F.col(order) == F.col("_w.o")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_of_{i}"))
    found = rows.select(*key, order, text).join(winners, on).select("_row", F.col("_w.s").alias("_s"), F.col(text).alias("_t"))
    side = lambda s: F.max(F.when(F.col("_s") == s, F.col("_t"))).alias(f"text_{s}")
    return numbered.select("_row", *key).join(found.groupBy("_row").agg(side("a"), side("b")), "_row").drop("_row")


def judged_documents(qrels: DataFrame) -> DataFrame:
    """qid, docids: the relevant documents of each query, sorted."""
    return qrels.where("relevance > 0").groupBy("qid").agg(F.array_sort(F.collect_set("docid")).alias("docids"))


def queries_per_document(rows: DataFrame) -> DataFrame:
    """docid, n_documents, n_queries; a row of unknown kind counts as a query, but not for its docid."""
    return rows.groupBy("docid").agg(F.count_if(F.col("kind") == "document").alias("n_documents"), F.count_if(F.col("kind") == "query").alias("n_queries"))


def virtual_epoch(rows: DataFrame, repeat: int | str = 1) -> DataFrame:
    """One row n_samples: queries once and documents r times, or as often as they have queries, at least once (repeat 'query')."""
    per = rows.groupBy("docid").agg(F.count_if(F.col("kind") == "document").alias("d"), F.count_if(F.col("kind") == "query").alias("q"), F.count_if(~F.coalesce(F.col("kind") == "document", F.lit(False))).alias("other"))
    times = F.greatest(F.lit(1), F.col("q")) if repeat == "query" else F.lit(int(repeat))
    return per.agg(F.coalesce(F.sum(F.col("d") * times + F.col("other")), F.lit(0)).cast("long").alias("n_samples"))


def sampling_summary(rows: DataFrame) -> DataFrame:
    """One row: n_documents, n_queries, n_query_docids, n_samples = documents + docids with queries."""
    per = rows.groupBy("docid").agg(F.count_if(F.col("kind") == "document").alias("d"), F.count_if(F.col("kind") == "query").alias("q"))
    out = per.agg(F.sum("d").alias("n_documents"), F.sum("q").alias("n_queries"), F.count_if(F.col("q") > 0).alias("n_query_docids"))
    zero = out.select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in out.columns])
    return zero.withColumn("n_samples", F.col("n_documents") + F.col("n_query_docids"))


def seen_targets(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'query'").select(F.trim("docid").alias("target")).distinct()


def first_label_ids(rows: DataFrame, pad: int = -100) -> DataFrame:
    """Distinct first label ids of query rows, padding ignored."""
    ids = F.filter("labels", lambda x: x != pad)
    return rows.where("kind = 'query'").select(F.try_element_at(ids, F.lit(1)).alias("token_id")).where("token_id is not null").distinct()


def longest_label(tables: list[DataFrame]) -> DataFrame:
    """One row max_new_tokens: the largest number of labels, at least 1."""
    sizes = [t.select(F.size("labels").alias("n")) for t in tables]
    all_ = sizes[0]
    for s in sizes[1:]:
        all_ = all_.unionByName(s)
    return all_.agg(F.greatest(F.lit(1), F.coalesce(F.max("n"), F.lit(1))).cast("long").alias("max_new_tokens"))


def atomic_targets(rows: DataFrame, added: DataFrame, eos: int, pad: int = -100) -> DataFrame:
    """One row is_atomic: some label was checked, and each is one added token with nothing but end ids behind it."""
    kept = rows.select(F.filter("labels", lambda x: x != pad).alias("ids"))
    one = kept.select(F.try_element_at("ids", F.lit(1)).alias("token_id"), F.forall(F.slice("ids", F.lit(2), F.greatest(F.size("ids"), F.lit(1))), lambda x: x == eos).alias("rest"))
    known = added.select("token_id", F.lit(True).alias("_added")).distinct()
    checked = one.join(known, "token_id", "left").select((F.coalesce("_added", F.lit(False)) & F.col("rest")).alias("ok"))
    return checked.agg((F.coalesce(F.bool_and("ok"), F.lit(False)) & (F.count("*") > 0)).alias("is_atomic"))
