"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .exact_dedup import SQL as EXACT_DEDUP_SQL
from .exact_dedup import op2_exact_dedup
from .html import op1_main_text
from .mixing import op7_mix_sources
from .pieces import op5_sentencepiece
from .pii import op6_pii
from .quality import op8_quality
from .sharding import op9_shard
from .simhash import op10_simhash
from .token_counts import op3_token_counts
from .toxicity import op4_toxicity


def queries() -> dict:
    import corpus_pipeline

    ops = (op1_main_text, op2_exact_dedup, op3_token_counts, op4_toxicity, op5_sentencepiece, op6_pii, op7_mix_sources, op8_quality, op9_shard, op10_simhash)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": EXACT_DEDUP_SQL}
