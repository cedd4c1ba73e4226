"""The queries of this subpackage, by name, and the SQL they are held against."""

from __future__ import annotations

from . import arc_to_warc, conversation_repair, decontamination, embedding_neighbours, filter_audit, license_scan, main_text, mixing, near_duplicates, personal_data, quality, quality_rules, sharding

QUERIES = {
    "op1_winnowing": decontamination.op1_winnowing,
    "op2_boosted_spans": personal_data.op2_boosted_spans,
    "op3_host_paths": main_text.op3_host_paths,
    "op4_jump_hash": sharding.op4_jump_hash,
    "op5_arc_to_warc": arc_to_warc.op5_arc_to_warc,
    "op6_soft_membership": mixing.op6_soft_membership,
    "op7_ftrl": quality.op7_ftrl,
    "op8_diagonal_voting": license_scan.op8_diagonal_voting,
    "op9_p_stable": embedding_neighbours.op9_p_stable,
    "op10_minhash_forest": near_duplicates.op10_minhash_forest,
    "op11_earley_repair": conversation_repair.op11_earley_repair,
    "op12_permutation_trie": filter_audit.op12_permutation_trie,
    "op13_monotone_trees": quality_rules.op13_monotone_trees,
}

ORACLES = {
    "op1_winnowing": decontamination.ORACLE_SQL,
    "op4_jump_hash": sharding.ORACLE_SQL,
    "op5_arc_to_warc": arc_to_warc.ORACLE_SQL,
    "op8_diagonal_voting": license_scan.ORACLE_SQL,
    "op9_p_stable": embedding_neighbours.ORACLE_SQL,
    "op11_earley_repair": conversation_repair.ORACLE_SQL,
    "op12_permutation_trie": filter_audit.ORACLE_SQL,
}
