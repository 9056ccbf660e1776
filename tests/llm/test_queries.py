"""The registered queries return their columns for every row of their table."""

import pytest

import __spark_entry__ as entry

COLUMNS = {
    "op1_ppm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_wrappers": "page_id url text n_chars",
    "op3_fertility": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5_private": "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    "op6_decontaminate": "doc_id item_id distance start end places",
    "op7_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op8_mixing": "doc_id text_hash n_tokens rows p_clean p_junk p_toxic domain rate copies",
    "op9_ring": "doc_id size text_crc32 law shard slot grown_shard",
    "op10_simhash": "doc_id fingerprint component_id",
    "op11_turns": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op12_centroids": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op13_packing": "doc_id piece start length ids_crc32 sequence_id offset",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, sf, name):
    found = entry.queries()[name](spark, sf)
    wanted = COLUMNS[name].split()
    assert found.columns[: len(wanted)] == wanted
    rows = found.collect()
    if name != "op6_decontaminate":
        table = {"op2_wrappers": "pages", "op11_turns": "conversations", "op12_centroids": "embeddings"}.get(name, "documents")
        given = spark.read.parquet(f"{sf}/{table}.parquet")
        if name == "op13_packing":
            rows = [r for r in rows if r.piece == 0]
        assert len(rows) == (given.select("conv_id").distinct() if name == "op11_turns" else given).count()
    assert rows


def test_all_are_registered():
    assert {*COLUMNS, "pipeline"} <= set(entry.queries())
