"""Registered queries of the training-data operators and their SQL counterparts."""

from threadspark.llm import byte_bpe, chat_format, collocations, decontaminate, exact_topk, katz_lm, language_id, line_dedup, near_dedup, sharding, simhash, token_counts, whitening

QUERIES = {
    run.__name__: run
    for run in (
        sharding.op1_shard_documents,
        chat_format.op2_format_conversations,
        token_counts.op3_line_token_counts,
        decontaminate.op4_benchmark_hits,
        line_dedup.op5_drop_repeated_lines,
        exact_topk.op6_exact_topk,
        near_dedup.op7_near_duplicates,
        language_id.op8_language,
        katz_lm.op9_katz_scores,
        byte_bpe.op10_encode_documents,
        whitening.op11_whiten_embeddings,
        simhash.op12_simhash_groups,
        collocations.op13_mine_phrases,
    )
}
SQL = {
    "op2_format_conversations": chat_format.OP2_SQL,
    "op4_benchmark_hits": decontaminate.OP4_SQL,
    "op5_drop_repeated_lines": line_dedup.OP5_SQL,
    "op6_exact_topk": exact_topk.OP6_SQL,
    "op13_mine_phrases": collocations.OP13_SQL,
}
