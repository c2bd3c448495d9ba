import pytest

from tests.oracle import FOLDER, same
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name])


COLUMNS = {
    "op1_mixing": ["doc_id", "size", "source_size", "target", "taken"], "op2_topk": ["query_id", "rank", "vec_id", "score"],
    "op3_quality": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"], "op4_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"], "op6_licences": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op7_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"], "op8_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op9_passages": ["doc_id", "n_words", "n_removed", "kept_sha256"], "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    table = {"op2_topk": None, "op7_packing": None, "op10_warc": "pages"}.get(name, "documents")
    assert df.count() == (spark.read.parquet(f"{FOLDER}/{table}.parquet").count() if table else df.distinct().count()) > 0


def test_reruns_of_the_mix_agree(spark):
    runs = [sorted((r.doc_id, r.taken) for r in QUERIES["op1_mixing"](spark, FOLDER).collect()) for _ in range(2)]
    assert runs[0] == runs[1]
