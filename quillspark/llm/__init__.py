"""Operators for large training corpora. Nothing else in the package imports these."""

from . import chunks, decontaminate, pii, quality, sharding, simhash, suffixes, tokenfile, toxicity, wfst

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_pii": pii.op2_pii,
    "op3_simhash": simhash.op3_simhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chunk_dedup": chunks.op5_chunk_dedup,
    "op6_sentencepiece": wfst.op6_sentencepiece,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_token_file": tokenfile.op9_token_file,
    "op10_suffix_array": suffixes.op10_suffix_array,
}
ORACLES: dict[str, str] = {"op7_quality_rules": quality.SQL, "op8_decontaminate": decontaminate.SQL}
