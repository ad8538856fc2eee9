"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .cohorts import OP13_SQL, op13_cohorts
from .decontamination import op1_decontamination
from .langid import op2_langid
from .line_dedup import OP5_SQL, op5_line_dedup
from .lmscore import op9_lmscore
from .merkle import OP11_SQL, op11_merkle
from .neighbours import op6_neighbours
from .ngram_join import op10_ngram_join
from .odd_sketches import op12_near_copies
from .packing import op4_packing
from .quality import op8_quality
from .secrets import op7_secrets
from .toxicity import op3_toxicity

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_langid": op2_langid,
    "op3_toxicity": op3_toxicity,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_neighbours": op6_neighbours,
    "op7_secrets": op7_secrets,
    "op8_quality": op8_quality,
    "op9_lmscore": op9_lmscore,
    "op10_ngram_join": op10_ngram_join,
    "op11_merkle": op11_merkle,
    "op12_near_copies": op12_near_copies,
    "op13_cohorts": op13_cohorts,
}

SQL: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op11_merkle": OP11_SQL, "op13_cohorts": OP13_SQL}
