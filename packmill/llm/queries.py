"""Registered queries of the subpackage and their SQL twins."""

from packmill.llm.context_tree import op6_context_tree
from packmill.llm.decontaminate import OP9_SQL, op9_wu_manber
from packmill.llm.hamming import OP5_SQL, op5_multi_index_hashing
from packmill.llm.hard_negatives import OP11_SQL, op11_slots
from packmill.llm.language import op1_crf
from packmill.llm.licenses import OP2_SQL, op2_prefix_filter
from packmill.llm.mixing import op4_entropy_balancing
from packmill.llm.multi_index import OP12_SQL, op12_multi_index
from packmill.llm.partenum import OP10_SQL, op10_partenum
from packmill.llm.personal import op7_boosted_trees
from packmill.llm.secret_scan import op8_randomness_tests
from packmill.llm.sharding import op3_hilbert
from packmill.llm.whitening import op13_bit_sliced

QUERIES = {
    "op1_crf": op1_crf,
    "op2_prefix_filter": op2_prefix_filter,
    "op3_hilbert": op3_hilbert,
    "op4_entropy_balancing": op4_entropy_balancing,
    "op5_multi_index_hashing": op5_multi_index_hashing,
    "op6_context_tree": op6_context_tree,
    "op7_boosted_trees": op7_boosted_trees,
    "op8_randomness_tests": op8_randomness_tests,
    "op9_wu_manber": op9_wu_manber,
    "op10_partenum": op10_partenum,
    "op11_slots": op11_slots,
    "op12_multi_index": op12_multi_index,
    "op13_bit_sliced": op13_bit_sliced,
}

# Models and hashes of the others are not for SQL; their tests compare them with brute force.
ORACLES = {
    "op2_prefix_filter": OP2_SQL,
    "op5_multi_index_hashing": OP5_SQL,
    "op9_wu_manber": OP9_SQL,
    "op10_partenum": OP10_SQL,
    "op11_slots": OP11_SQL,
    "op12_multi_index": OP12_SQL,
}
