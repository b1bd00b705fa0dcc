"""The registered queries of this package, and the DuckDB SQL of those that SQL can express."""

from .bpe import op2_bpe
from .chat import OP6_SQL, op6_chat
from .lm import OP3_SQL, op3_lm_scoring
from .minhash import op13_minhash
from .negatives import OP12_SQL, op12_hard_negatives
from .packing import op1_packing
from .quality import op9_quality_rules
from .resampling import OP11_SQL, op11_importance_resampling
from .simhash import op7_simhash
from .spotsigs import op10_spotsigs, spotsigs_classes
from .substring import op5_substring_dedup
from .urls import OP8_SQL, op8_url_filter
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op10_spotsigs": op10_spotsigs,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_warc": op4_warc,
    "op6_chat": op6_chat,
    "op8_url_filter": op8_url_filter,
    "op5_substring_dedup": op5_substring_dedup,
    "op1_packing": op1_packing,
    "op7_simhash": op7_simhash,
    "op2_bpe": op2_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_minhash": op13_minhash,
    "spotsigs_classes": spotsigs_classes,
}

ORACLES: dict[str, str] = {
    "op3_lm_scoring": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op6_chat": OP6_SQL,
    "op8_url_filter": OP8_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
}
