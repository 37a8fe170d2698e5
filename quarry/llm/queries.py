"""The queries of this package, and SQL for those that SQL can express."""

from quarry.llm import ann, bpe, divergence, jump_shard, lexical, license_scan, line_dedup, mixing, near_dedup, pii, quality_resample, quality_rules, training_order

QUERIES = {
    "op1_importance_resampling": quality_resample.op1_query,
    "op2_training_order": training_order.op2_query,
    "op3_line_neighbourhoods": line_dedup.op3_query,
    "op4_candidate_boosting": pii.op4_query,
    "op5_prefix_bpe": bpe.op5_query,
    "op6_entropy_balancing": mixing.op6_query,
    "op7_order_minhash": near_dedup.op7_query,
    "op8_multi_index": ann.op8_query,
    "op9_risk_controlled_rules": quality_rules.op9_query,
    "op10_jump_shards": jump_shard.op10_query,
    "op11_source_divergence": divergence.op11_query,
    "op12_license_templates": license_scan.op12_query,
    "op13_ball_tree_search": lexical.op13_query,
}
ORACLE = {
    "op3_line_neighbourhoods": line_dedup.ORACLE,
    "op9_risk_controlled_rules": quality_rules.ORACLE,
    "op10_jump_shards": jump_shard.ORACLE,
    "op11_source_divergence": divergence.ORACLE,
    "op12_license_templates": license_scan.ORACLE,
    "op13_ball_tree_search": lexical.ORACLE,
}
