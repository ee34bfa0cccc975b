"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op8_nn_descent
from .langid import op2_unigram_langid
from .linededup import OP6_SQL, op6_bloom_lines
from .media import op9_media_archive
from .mixing import OP3_SQL, op3_curriculum_mix
from .ngramlm import OP4_SQL, op4_stupid_backoff
from .packing import op7_bm25_packing
from .quality import op10_ftrl_quality
from .rans import op1_rans_tokens
from .simhash import op5_simhash

QUERIES = {f.__name__: f for f in (op1_rans_tokens, op2_unigram_langid, op3_curriculum_mix, op4_stupid_backoff, op5_simhash, op6_bloom_lines, op7_bm25_packing, op8_nn_descent, op9_media_archive, op10_ftrl_quality)}
ORACLES = {"op3_curriculum_mix": OP3_SQL, "op4_stupid_backoff": OP4_SQL, "op6_bloom_lines": OP6_SQL}
