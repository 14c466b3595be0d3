"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from inkbasin.llm import op5_segments, op6_urlglob, op12_codes
from inkbasin.llm.op10_sigtree import op10_signature_trees
from inkbasin.llm.op11_html import op11_block_tree_text
from inkbasin.llm.op13_variants import op13_spelling_variants
from inkbasin.llm.op1_ctw import op1_ctw_scoring
from inkbasin.llm.op2_crossparse import op2_cross_parsing
from inkbasin.llm.op3_ivfpq import op3_ivf_pq
from inkbasin.llm.op4_apportion import op4_sainte_lague
from inkbasin.llm.op7_packing import op7_packing
from inkbasin.llm.op8_surrogates import op8_surrogates
from inkbasin.llm.op9_bwt import op9_interval_expansion

QUERIES = {
    "op1_ctw_scoring": op1_ctw_scoring,
    "op2_cross_parsing": op2_cross_parsing,
    "op3_ivf_pq": op3_ivf_pq,
    "op4_sainte_lague": op4_sainte_lague,
    "op5_segment_bounds": op5_segments.op5_segment_bounds,
    "op6_url_globs": op6_urlglob.op6_url_globs,
    "op7_packing": op7_packing,
    "op8_surrogates": op8_surrogates,
    "op9_interval_expansion": op9_interval_expansion,
    "op10_signature_trees": op10_signature_trees,
    "op11_block_tree_text": op11_block_tree_text,
    "op12_ball_tree_codes": op12_codes.op12_ball_tree_codes,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE_SQL: dict[str, str] = {
    "op5_segment_bounds": op5_segments.ORACLE_SQL,
    "op6_url_globs": op6_urlglob.ORACLE_SQL,
    "op12_ball_tree_codes": op12_codes.ORACLE_SQL,
}
