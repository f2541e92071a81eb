"""The driver's queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from codeloom.llm.embeddings import OP3_SQL, op3_embedding_near_dedup
from codeloom.llm.jaccard import OP7_SQL, op7_ngram_jaccard_join
from codeloom.llm.language import op9_language_id
from codeloom.llm.lines import OP1_SQL, op1_line_dedup
from codeloom.llm.media import op5_media_columns
from codeloom.llm.mixing import OP6_SQL, op6_source_mixing
from codeloom.llm.packing import op8_best_fit_packing
from codeloom.llm.quality import op2_quality_classifier
from codeloom.llm.rollups import op10_token_counts
from codeloom.llm.toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality_classifier, op3_embedding_near_dedup, op4_toxicity, op5_media_columns, op6_source_mixing, op7_ngram_jaccard_join, op8_best_fit_packing, op9_language_id, op10_token_counts)}
SQL = {"op1_line_dedup": OP1_SQL, "op3_embedding_near_dedup": OP3_SQL, "op6_source_mixing": OP6_SQL, "op7_ngram_jaccard_join": OP7_SQL}
