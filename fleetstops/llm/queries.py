"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from .byte_bpe import op7_byte_bpe
from .chat import op1_chat_format
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .filter_audit import OP12_SQL, op12_filter_audit
from .licences import op5_license_scan
from .mixing import OP2_SQL, op2_mix_sources
from .neighbours import op8_neighbours
from .periodic import op13_periodic_runs
from .simhash import op4_simhash
from .suffix_dedup import op11_suffix_dedup
from .token_counts import op10_token_counts
from .token_files import op3_token_files
from .toxicity import op9_toxicity

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_mix_sources": op2_mix_sources,
    "op3_token_files": op3_token_files,
    "op4_simhash": op4_simhash,
    "op5_license_scan": op5_license_scan,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_neighbours": op8_neighbours,
    "op9_toxicity": op9_toxicity,
    "op10_token_counts": op10_token_counts,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_filter_audit": op12_filter_audit,
    "op13_periodic_runs": op13_periodic_runs,
}

SQL = {
    "op2_mix_sources": OP2_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op12_filter_audit": OP12_SQL,
}
