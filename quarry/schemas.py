"""Declared layouts of every table that is read or written; nothing is inferred from data."""

from __future__ import annotations

SPAN = "STRUCT<start_token:BIGINT,end_token:BIGINT>"
CANDIDATES = "ARRAY<STRUCT<start_token:BIGINT,end_token:BIGINT,top_level:BOOLEAN>>"
ANNOTATIONS = (
    "ARRAY<STRUCT<annotation_id:DECIMAL(20,0),long_answer:STRUCT<candidate_index:BIGINT,start_token:BIGINT,end_token:BIGINT>,"
    f"short_answers:ARRAY<{SPAN}>,yes_no_answer:STRING>>"
)
TOKENS = "ARRAY<STRUCT<start_byte:BIGINT,end_byte:BIGINT,html_token:BOOLEAN,token:STRING>>"

QUESTIONS_FULL = (
    "example_id BIGINT, question_text STRING, question_tokens ARRAY<STRING>, document_url STRING, document_title STRING, document_html STRING, "
    f"document_tokens {TOKENS}, long_answer_candidates {CANDIDATES}, annotations {ANNOTATIONS}"
)
QUESTIONS_SIMPLE = f"example_id BIGINT, question_text STRING, document_url STRING, document_text STRING, long_answer_candidates {CANDIDATES}, annotations {ANNOTATIONS}"
QUESTIONS_COLUMNAR = (
    "id STRING, document STRUCT<title:STRING,url:STRING,html:STRING,tokens:STRUCT<token:ARRAY<STRING>,is_html:ARRAY<BOOLEAN>,start_byte:ARRAY<BIGINT>,end_byte:ARRAY<BIGINT>>>, "
    "question STRUCT<text:STRING,tokens:ARRAY<STRING>>, long_answer_candidates STRUCT<start_token:ARRAY<BIGINT>,end_token:ARRAY<BIGINT>,top_level:ARRAY<BOOLEAN>>, "
    "annotations STRUCT<id:ARRAY<STRING>,long_answer:ARRAY<STRUCT<start_token:BIGINT,end_token:BIGINT,candidate_index:BIGINT>>,"
    "short_answers:ARRAY<STRUCT<start_token:ARRAY<BIGINT>,end_token:ARRAY<BIGINT>>>,yes_no_answer:ARRAY<INT>>"
)
PREPARED = (
    "example_id BIGINT, question_text STRING, document_url STRING, document_text STRING, source STRING, document_url_title STRING, "
    "document_h1_title STRING, document_nq_title STRING, nci_dedup_title STRING, document_normalization STRING"
)
CANONICAL = "docid STRING, kind STRING, text STRING, title STRING, source_ids ARRAY<STRING>"
RANKING_DOCUMENTS = "docid STRING, url STRING, title STRING, body STRING"
RANKING_QUERIES = "kind STRING, query_id STRING, text STRING, docid STRING"
TOKENISED = "docid STRING, kind STRING, title STRING, text_tokens ARRAY<INT>, docid_tokens ARRAY<INT>"
TRAINING = "kind STRING, docid STRING, input_ids ARRAY<INT>, labels ARRAY<INT>"
TOKEN_TABLE = "base_vocab_size BIGINT, tokens ARRAY<STRING>, token STRING"
TOKEN_INIT = "token STRING, payload ARRAY<DOUBLE>"
REVISIONS = "oldid STRING, pageid BIGINT"

#: Column sets that tell the layouts of question collections apart, in the order in which they are tried.
SIMPLE_MARK = frozenset({"document_text"})
FULL_MARK = frozenset({"document_html", "document_tokens", "document_url", "question_text"})
COLUMNAR_MARK = frozenset({"id", "document", "question"})


def detect_layout(columns: list[str]) -> str:
    """simple, full or columnar; the first set that is there decides."""
    have = set(columns)
    for name, mark in (("simple", SIMPLE_MARK), ("full", FULL_MARK), ("columnar", COLUMNAR_MARK)):
        if mark <= have:
            return name
    raise ValueError(f"no known layout has the columns {sorted(have)}")
