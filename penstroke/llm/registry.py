"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import alignment, chat, fingerprints, idfiles, neardup, packing, pieces, search, secrets, tiers, toxicity, trie, warc


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_chat_format,
        "op2_warc": warc.op2_warc,
        "op3_near_duplicates": neardup.op3_near_duplicates,
        "op4_secrets": secrets.op4_secrets,
        "op5_search": search.op5_search,
        "op6_packing": packing.op6_packing,
        "op7_idfiles": idfiles.op7_idfiles,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_pieces": pieces.op9_pieces,
        "op10_fingerprints": fingerprints.op10_fingerprints,
        "op11_alignment": alignment.op11_alignment,
        "op12_tiered_packing": tiers.op12_tiered_packing,
        "op13_prefix_trie": trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.OP1_SQL, "op2_warc": warc.OP2_SQL, "op3_near_duplicates": neardup.OP3_SQL, "op5_search": search.OP5_SQL, "op13_prefix_trie": trie.OP13_SQL}
