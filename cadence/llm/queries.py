"""The registered queries of this subpackage, and the SQL of those that SQL expresses."""

from cadence.llm import (embedding_dedup, fill_middle, fingerprint, html_text, jaccard_join, merkle, mixing, packing, suffix_dedup,
                         token_counts, toxicity, url_filter, warc)

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_embedding_dedup": embedding_dedup.query,
    "op3_fingerprints": fingerprint.query,
    "op4_html_text": html_text.query,
    "op5_toxicity": toxicity.query,
    "op6_mixing": mixing.query,
    "op7_warc": warc.query,
    "op8_packing": packing.query,
    "op9_token_counts": token_counts.query,
    "op10_jaccard_join": jaccard_join.query,
    "op11_fill_in_middle": fill_middle.query,
    "op12_suffix_dedup": suffix_dedup.query,
    "op13_merkle_manifest": merkle.query,
}

ORACLE = {"op1_url_filter": url_filter.SQL, "op7_warc": warc.SQL, "op11_fill_in_middle": fill_middle.SQL,
          "op13_merkle_manifest": merkle.SQL}
