"""The registered queries of this subpackage and their DuckDB SQL, where SQL can say them."""

from palimpsest.llm import encoding, language, mixing, quality, sharding, simhash, substrings, token_counts, toxicity, versions

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_encoding": encoding.op2_encoding,
    "op3_language": language.op3_language,
    "op4_substrings": substrings.op4_substrings,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_mixing": mixing.op7_mixing,
    "op8_fingerprints": versions.op8_fingerprints,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sharding": sharding.op10_sharding,
}
ORACLE_SQL = {
    "op4_substrings": substrings.SQL,
    "op7_mixing": mixing.SQL,
    "op10_sharding": sharding.SQL,
}
