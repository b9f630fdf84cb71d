"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op2_bpe
from .language import op4_language_id
from .linededup import OP6_SQL, op6_line_dedup
from .masked import op5_lm_scoring
from .mixing import OP10_SQL, op10_mixing
from .orderhash import op9_fingerprints
from .simhash import op1_simhash_near_dedup
from .topk import OP7_SQL, op7_topk_search
from .toxicity import op3_toxicity
from .warc import OP8_SQL, op8_warc

QUERIES = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_bpe, op3_toxicity, op4_language_id, op5_lm_scoring, op6_line_dedup, op7_topk_search, op8_warc, op9_fingerprints, op10_mixing)
}

ORACLE_SQL = {"op6_line_dedup": OP6_SQL, "op7_topk_search": OP7_SQL, "op8_warc": OP8_SQL, "op10_mixing": OP10_SQL}
