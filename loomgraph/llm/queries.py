"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from loomgraph.llm.decontamination import op9_simhash_windows
from loomgraph.llm import conversation_trie, fill_in_middle, suffix_index
from loomgraph.llm.language_id import op1_language_id
from loomgraph.llm.line_dedup import op10_fuzzy_lines
from loomgraph.llm.near_dups import op3_bottom_k
from loomgraph.llm.packing import op4_best_fit_packing
from loomgraph.llm.quality import op7_byte_cnn
from loomgraph.llm.secrets import op8_blob_ledger
from loomgraph.llm.sharding import op5_kd_shards
from loomgraph.llm.token_files import op2_token_files
from loomgraph.llm.vector_search import op6_anisotropic

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_bottom_k": op3_bottom_k,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_kd_shards": op5_kd_shards,
    "op6_anisotropic": op6_anisotropic,
    "op7_byte_cnn": op7_byte_cnn,
    "op8_blob_ledger": op8_blob_ledger,
    "op9_simhash_windows": op9_simhash_windows,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_suffix_family": suffix_index.op11_suffix_family,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_prefix_trie": conversation_trie.op13_prefix_trie,
}

ORACLES: dict[str, str] = {"op11_suffix_family": suffix_index.ORACLE, "op12_fill_in_middle": fill_in_middle.ORACLE, "op13_prefix_trie": conversation_trie.ORACLE}
