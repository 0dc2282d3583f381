"""Queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from strandweave.llm.best_fit import op12_best_fit_packing
from strandweave.llm.bpe import op5_bpe_encode_decode
from strandweave.llm.chat import op4_chat_formatting
from strandweave.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from strandweave.llm.hnsw import op8_embedding_near_dedup
from strandweave.llm.importance import OP13_SQL, op13_importance_resampling
from strandweave.llm.line_dedup import op9_line_dedup
from strandweave.llm.packing import op2_packing
from strandweave.llm.quality import op1_quality_classifier
from strandweave.llm.simhash import op6_simhash_near_dedup
from strandweave.llm.token_counts import op10_token_counts
from strandweave.llm.toxicity import op3_toxicity
from strandweave.llm.vptree import op7_nearest_neighbours

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier, op2_packing, op3_toxicity, op4_chat_formatting, op5_bpe_encode_decode,
        op6_simhash_near_dedup, op7_nearest_neighbours, op8_embedding_near_dedup, op9_line_dedup, op10_token_counts,
        op11_hard_negatives, op12_best_fit_packing, op13_importance_resampling,
    )
}
#: The others aren't plain SQL on whole tables: scores are learned, ids are a tokenizer's, searches go by index; tests hold each against brute force.
ORACLES: dict[str, str] = {"op11_hard_negatives": OP11_SQL, "op13_importance_resampling": OP13_SQL}
