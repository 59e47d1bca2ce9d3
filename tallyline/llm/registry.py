"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat_format import OP8_SQL, op8
from .exact_dedup import OP3_SQL, op3
from .fill_middle import OP12_SQL, op12
from .hard_negatives import OP11_SQL, op11
from .html_extract import op4
from .lm_scoring import op6
from .minhash_dedup import OP13_SQL, op13
from .mixing import op10
from .ngram_join import OP2_SQL, op2
from .packing import op5
from .quality import op1
from .url_filter import OP7_SQL, op7
from .vector_topk import OP9_SQL, op9

QUERIES = {
    "op1_quality": op1,
    "op2_ngram_join": op2,
    "op3_exact_dedup": op3,
    "op4_html_extract": op4,
    "op5_packing": op5,
    "op6_lm_scoring": op6,
    "op7_url_filter": op7,
    "op8_chat_format": op8,
    "op9_vector_topk": op9,
    "op10_mixing": op10,
    "op11_hard_negatives": op11,
    "op12_fill_middle": op12,
    "op13_minhash_dedup": op13,
}
ORACLES = {"op2_ngram_join": OP2_SQL, "op3_exact_dedup": OP3_SQL, "op7_url_filter": OP7_SQL, "op8_chat_format": OP8_SQL, "op9_vector_topk": OP9_SQL, "op11_hard_negatives": OP11_SQL, "op12_fill_middle": OP12_SQL, "op13_minhash_dedup": OP13_SQL}
