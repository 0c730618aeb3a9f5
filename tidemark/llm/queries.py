"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from tidemark.llm import (
    bpe_automaton,
    dart_minhash,
    decontamination,
    html_tree,
    importance,
    lattice_scores,
    lexical_search,
    line_spread,
    rule_ledger,
    sharding,
    source_audit,
    token_counts,
    tool_calls,
)

QUERIES = {
    f.__name__: f
    for f in (
        decontamination.op1_suffix_automaton,
        importance.op2_importance_resampling,
        token_counts.op3_two_tier_counts,
        tool_calls.op4_tool_call_linking,
        sharding.op5_rendezvous_shards,
        html_tree.op6_tree_marginals,
        rule_ledger.op7_rule_ledger,
        dart_minhash.op8_dart_minhash,
        bpe_automaton.op9_bpe_automaton,
        line_spread.op10_distinct_site_spread,
        lexical_search.op11_inverted_treaps,
        source_audit.op12_wide_term_vectors,
        lattice_scores.op13_subword_lattice,
    )
}
ORACLES = {
    "op1_suffix_automaton": decontamination.OP1_SQL,
    "op7_rule_ledger": rule_ledger.OP7_SQL,
    "op10_distinct_site_spread": line_spread.OP10_SQL,
    "op11_inverted_treaps": lexical_search.OP11_SQL,
    "op12_wide_term_vectors": source_audit.OP12_SQL,
}
