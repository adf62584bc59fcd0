"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .language_id import op3_language
from .near_dup import op4_near_dup
from .neighbours import op9_neighbours
from .packing import op7_packing
from .pii import op10_pii
from .piece_bpe import op8_sentencepiece
from .quality_model import op2_quality_model
from .quality_rules import op1_quality_rules
from .toxicity import op6_toxicity
from .url_filter import OP5_SQL, op5_url_filter



def pipeline(spark, sf_dir):
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_model": op2_quality_model,
    "op3_language": op3_language,
    "op4_near_dup": op4_near_dup,
    "op5_url_filter": op5_url_filter,
    "op6_toxicity": op6_toxicity,
    "op7_packing": op7_packing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_neighbours": op9_neighbours,
    "op10_pii": op10_pii,
    "pipeline": pipeline,
}

ORACLE_SQL: dict[str, str] = {"op5_url_filter": OP5_SQL}
