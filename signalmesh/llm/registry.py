"""Registered queries of the training-data operators, and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from signalmesh.llm import collocations, exact_dedup, mixing, projection_forest
from signalmesh.llm.collocations import op13_collocations
from signalmesh.llm.exact_dedup import op9_exact_dedup
from signalmesh.llm.lang_id import op4_lang_id
from signalmesh.llm.licenses import op7_license_scan
from signalmesh.llm.mixing import op10_mixing
from signalmesh.llm.near_dedup import op8_minhash_near_dedup
from signalmesh.llm.packing import op1_harmonic_packing
from signalmesh.llm.pii import op2_pii_bootstrap
from signalmesh.llm.projection_forest import op12_projection_forest
from signalmesh.llm.secrets import op5_secret_scan
from signalmesh.llm.suffix_dedup import op6_suffix_dedup
from signalmesh.llm.token_align import op11_token_align
from signalmesh.llm.vptree import op3_vp_tree

QUERIES = {f.__name__: f for f in (op1_harmonic_packing, op2_pii_bootstrap, op3_vp_tree, op4_lang_id, op5_secret_scan, op6_suffix_dedup,
                                   op7_license_scan, op8_minhash_near_dedup, op9_exact_dedup, op10_mixing, op11_token_align,
                                   op12_projection_forest, op13_collocations)}
ORACLE = {"op9_exact_dedup": exact_dedup.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL,
          "op12_projection_forest": projection_forest.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
