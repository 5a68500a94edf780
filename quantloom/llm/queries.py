"""The registered queries of this subpackage and their SQL."""

from . import chat_format, decontaminate, embedding_dedup, language_id, line_dedup, minhash_dedup, mixing, periodic_runs, quality, secrets_scan, suffix_dedup, token_alignment, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_language_id": language_id.op2_language_id,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_mixing": mixing.op4_mixing,
    "op5_secrets": secrets_scan.op5_secrets,
    "op6_quality": quality.op6_quality,
    "op7_embedding_dedup": embedding_dedup.op7_embedding_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_minhash_dedup": minhash_dedup.op10_minhash_dedup,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}
#: Of the learned operators (2, 5, 6, 9) and of tokenizers (13) no SQL exists: tests hold them against labels and brute force.
SQL = {**chat_format.SQL, **decontaminate.SQL, **mixing.SQL, **embedding_dedup.SQL, **line_dedup.SQL, **minhash_dedup.SQL, **suffix_dedup.SQL, **periodic_runs.SQL}
