"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from weftgraph.llm.bpe import op1_bpe_automaton
from weftgraph.llm.langid import op9_crf_language
from weftgraph.llm.minhash import op5_weighted_minhash
from weftgraph.llm.mixing import op10_block_mix
from weftgraph.llm.mpeg import op3_mpeg_audio
from weftgraph.llm.neighbours import op7_collision_counting
from weftgraph.llm.pii import op2_pii_boosting
from weftgraph.llm.quality import op8_boosted_quality
from weftgraph.llm.sharding import OP6_SQL, op6_feistel_shards
from weftgraph.llm.substrings import op4_fingerprint_index

QUERIES = {
    "op1_bpe_automaton": op1_bpe_automaton,
    "op2_pii_boosting": op2_pii_boosting,
    "op3_mpeg_audio": op3_mpeg_audio,
    "op4_fingerprint_index": op4_fingerprint_index,
    "op5_weighted_minhash": op5_weighted_minhash,
    "op6_feistel_shards": op6_feistel_shards,
    "op7_collision_counting": op7_collision_counting,
    "op8_boosted_quality": op8_boosted_quality,
    "op9_crf_language": op9_crf_language,
    "op10_block_mix": op10_block_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op6_feistel_shards": OP6_SQL,
}
