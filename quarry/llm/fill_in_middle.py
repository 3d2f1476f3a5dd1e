"""Fill-in-the-middle: texts cut in three at token borders and put in another order for training.

A text is a run of units, `[A-Za-z]+|[^A-Za-z]`. Two draws of a document's id choose two borders between units, which part the text
into prefix, middle and suffix; two more draws choose whether it stays as it is (`plain`) or is written with marks, prefix first
(`psm`) or suffix first (`spm`). All draws come from one digest of the id, so a text is cut alike wherever its row lies.

The work is SQL: each Arrow batch is registered in a DuckDB database in the task's memory, and the result goes back as Arrow. No
Python code runs for a row. Rows are registered in runs of about RUN_BYTES of text. A long text is never a list of all its units:
the pattern PIECE takes UNITS of them at once, and only pieces that hold a border are cut into single units. A task holds a few
copies of its longest text, and a list of a sixty-fourth as many pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Units in a piece.
UNITS = 64
PIECE = f"(?:{UNIT}){{1,{UNITS}}}"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents so many are cut, and of a hundred cut ones so many have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: Bytes of text in one registered table, one longer row aside.
RUN_BYTES = 4 << 20

_HEAD = "array_to_string(list_slice(pieces, 1, {at} // {units}), '') || array_to_string(list_slice(regexp_extract_all(coalesce(pieces[{at} // {units} + 1], ''), '{unit}'), 1, {at} % {units}), '')"


def statement(cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, salt: str = "1:") -> str:
    """The SQL that turns a table batch(doc_id, text) into doc_id, n, form, prefix_chars, middle_chars, output."""
    head = lambda at: _HEAD.format(at=at, units=UNITS, unit=UNIT)
    draw = lambda k: f"CAST('0x' || substr(digest, {8 * k - 7}, 8) AS BIGINT)"
    marked = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
    WITH pieces AS (
        SELECT row_number() OVER () AS place, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{PIECE}') AS pieces,
               sha256('{salt}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
        FROM batch),
    counted AS (
        SELECT *, CASE WHEN len(pieces) = 0 THEN 0 ELSE {UNITS} * (len(pieces) - 1) + len(regexp_extract_all(pieces[len(pieces)], '{UNIT}')) END AS n FROM pieces),
    drawn AS (
        SELECT *, least({draw(1)} % (n + 1), {draw(2)} % (n + 1)) AS a, greatest({draw(1)} % (n + 1), {draw(2)} % (n + 1)) AS b,
               CASE WHEN n = 0 OR {marked} OR {draw(3)} % 100 >= {cut_percent} THEN 'plain' WHEN {draw(4)} % 100 < {suffix_first_percent} THEN 'spm' ELSE 'psm' END AS form
        FROM counted),
    bordered AS (
        SELECT place, doc_id, text, n, form, CASE WHEN form <> 'plain' THEN length({head("a")}) END AS a, CASE WHEN form <> 'plain' THEN length({head("b")}) END AS b FROM drawn),
    parted AS (
        SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM bordered)
    SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(a AS BIGINT) AS prefix_chars, CAST(b - a AS BIGINT) AS middle_chars,
           CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                     ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output
    FROM parted ORDER BY place
    """


def _runs(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """The batch's rows in runs of at most RUN_BYTES of text, or of one longer row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).cumsum()
    lo = 0
    while lo < batch.num_rows:
        before = int(sizes[lo - 1]) if lo else 0
        hi = min(batch.num_rows, max(lo + 1, int(sizes.searchsorted(before + RUN_BYTES, side="right"))))
        yield pa.Table.from_batches([batch.slice(lo, hi - lo)])
        lo = hi


def rearrange(docs: DataFrame, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, salt: str = "1:") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (code points; null if plain), output. One row for each row of docs.

    A null text is empty; an empty text, and one that holds a mark, stays plain, so that every output can be turned back. A null
    doc_id draws as the empty text does. Repeated rows give repeated rows; an empty table an empty one. Other columns of docs are
    not read, whatever their names. A text of any length is cut as one; see above for the memory that it takes.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kept = rows.schema["doc_id"].dataType.simpleString()
    layout = f"doc_id {kept}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    sql = statement(cut_percent, suffix_first_percent, salt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        from quarry.llm.words import give_back

        with duckdb.connect(":memory:", config={"threads": 1}) as con:
            for batch in batches:
                for part in _runs(batch):
                    con.register("batch", part)
                    out = con.sql(sql).to_arrow_table()
                    con.unregister("batch")
                    yield from out.cast(pa.schema([pa.field("doc_id", batch.schema.field("doc_id").type), *[out.schema.field(k) for k in range(1, 5)], pa.field("output", pa.string())])).to_batches()
                    del out
                give_back()

    return rows.mapInArrow(run, layout)


def restored(output: Column | str, form: Column | str) -> Column:
    """The text that an output was made from. Texts with marks are plain, so every mark of another form is one of ours."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    part = lambda text, mark, k: F.split_part(text, F.lit(mark), F.lit(k))
    middle = part(output, MIDDLE, 2)
    by_prefix = F.concat(part(part(output, SUFFIX, 1), PREFIX, 2), middle, part(part(output, SUFFIX, 2), MIDDLE, 1))
    by_suffix = F.concat(part(part(output, PREFIX, 2), MIDDLE, 1), middle, part(part(output, SUFFIX, 2), PREFIX, 1))
    return F.when(form == "plain", output).when(form == "psm", by_prefix).otherwise(by_suffix)


def digests(docs: DataFrame) -> DataFrame:
    """The rearranged texts as digests of what was written and of what can be read back from it."""
    out = rearrange(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))
