"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe_words, exact_dedup, fingerprints, interval_dedup, near_dedup, packing, secrets, token_files, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_arc_to_warc": warc.op2_arc_to_warc,
    "op3_token_files": token_files.op3_token_files,
    "op4_bpe_words": bpe_words.op4_bpe_words,
    "op5_interval_dedup": interval_dedup.op5_interval_dedup,
    "op6_packing": packing.op6_packing,
    "op7_odd_sketches": near_dedup.op7_odd_sketches,
    "op8_weighted_sampling": fingerprints.op8_weighted_sampling,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op2_arc_to_warc": warc.OP2_SQL,
}
