"""Queries of this subpackage, by name."""

from __future__ import annotations

from .ann import op1_ann
from .ball_tree import OP7_SQL, op7_ball_tree
from .bottom_k import OP13_SQL, op13_bottom_k
from .bpe import op2_bpe
from .collocations import OP11_SQL, op11_collocations
from .kn_quality import op10_kn_quality
from .line_templates import op9_line_templates
from .merkle import OP12_SQL, op12_merkle
from .near_join import op4_near_join
from .packing import op5_packing
from .shards import op3_sharding
from .token_files import op8_token_files
from .toxicity import op6_toxicity

QUERIES = {f.__name__: f for f in (
    op1_ann, op2_bpe, op3_sharding, op4_near_join, op5_packing, op6_toxicity, op7_ball_tree, op8_token_files, op9_line_templates, op10_kn_quality, op11_collocations, op12_merkle, op13_bottom_k)}
ORACLES = {"op7_ball_tree": OP7_SQL, "op11_collocations": OP11_SQL, "op12_merkle": OP12_SQL, "op13_bottom_k": OP13_SQL}
