"""The corpus queries by name, and the SQL of those that SQL can express."""

from . import bpe, embeddings, licenses, mixing, near_dups, packing, pii, quality, ranked_search, sentence_pieces, substrings, suffixes, vector_codes

QUERIES = {
    "op1_embedding_near_dups": embeddings.op1,
    "op2_mixing": mixing.op2,
    "op3_pii": pii.op3,
    "op4_quality_rules": quality.op4,
    "quality_ablations": quality.quality_ablations,
    "op5_packing": packing.op5,
    "op6_license_scan": licenses.op6,
    "op7_super_kmers": substrings.op7,
    "op8_suffix_array": suffixes.op8,
    "op9_order_minhash": near_dups.op9,
    "op10_byte_bpe": bpe.op10,
    "op11_sentence_pieces": sentence_pieces.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_ranked_search": ranked_search.op13,
}

ORACLE_SQL = {
    "op1_embedding_near_dups": embeddings.OP1_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "quality_ablations": quality.ABLATIONS_SQL,
    "op7_super_kmers": substrings.OP7_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_ranked_search": ranked_search.OP13_SQL,
}
