"""Queries and SQL of the llm operators."""

from __future__ import annotations

from loomtext.llm import abuse, chunking, codetext, langid, mixing, mojibake, packing, pairs, tokens


def queries() -> dict:
    return {
        "p1_found": chunking.p1_found,
        "p1_pieces": chunking.p1_pieces,
        "p10_found": abuse.p10_found,
        "p10_rates": abuse.p10_rates,
        "p10_scores": abuse.p10_scores,
        "p2_found": pairs.p2_found,
        "p2_rates": pairs.p2_rates,
        "p3_found": mojibake.p3_found,
        "p3_restored": mojibake.p3_restored,
        "p4_found": langid.p4_found,
        "p4_labels": langid.p4_labels,
        "p4_segments": langid.p4_segments,
        "p6_batches": packing.p6_batches,
        "p6_examples": packing.p6_examples,
        "p6_fill": packing.p6_fill,
        "p7_found": codetext.p7_found,
        "p7_shares": codetext.p7_shares,
        "p8_ids": tokens.p8_ids,
        "p8_stats": tokens.p8_stats,
        "p9_mix": mixing.p9_mix,
        "p9_shares": mixing.p9_shares,
    }


def oracle_sql() -> dict:
    return {"p1_found": chunking.P1_SQL}
