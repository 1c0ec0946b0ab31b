"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import centroids, decontamination, fill_in_middle, jaccard_join, sharding, warc
from .byte_bpe import op8_bpe_round_trip
from .centroids import op11_centroid_clusters
from .common import table
from .decontamination import op1_decontamination
from .fill_in_middle import op13_fill_in_middle
from .fingerprints import op7_imatch_fingerprints
from .hmm_scoring import op2_hmm_scores
from .html_extraction import op3_html_extraction
from .jaccard_join import op9_jaccard_join
from .language_id import op5_language_id
from .piece_bpe import op12_piece_round_trip
from .sharding import op4_sharding
from .token_counts import op6_token_counts
from .warc import op10_warc_archive


def _on(operator, *tables):
    return lambda spark, sf_dir: operator(*(table(spark, sf_dir, t) for t in tables))


QUERIES = {
    "op1_decontamination": _on(op1_decontamination, "documents", "benchmark"),
    "op2_hmm_scores": _on(op2_hmm_scores, "documents"),
    "op3_html_extraction": _on(op3_html_extraction, "pages"),
    "op4_sharding": _on(op4_sharding, "documents"),
    "op5_language_id": _on(op5_language_id, "documents"),
    "op6_token_counts": _on(op6_token_counts, "documents"),
    "op7_imatch_fingerprints": _on(op7_imatch_fingerprints, "documents"),
    "op8_bpe_round_trip": _on(op8_bpe_round_trip, "documents"),
    "op9_jaccard_join": _on(op9_jaccard_join, "documents"),
    "op10_warc_archive": _on(op10_warc_archive, "pages"),
    "op11_centroid_clusters": _on(op11_centroid_clusters, "embeddings"),
    "op12_piece_round_trip": _on(op12_piece_round_trip, "documents"),
    "op13_fill_in_middle": _on(op13_fill_in_middle, "documents"),
}

ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": decontamination.ORACLE,
    "op4_sharding": sharding.ORACLE,
    "op9_jaccard_join": jaccard_join.ORACLE,
    "op10_warc_archive": warc.ORACLE,
    "op11_centroid_clusters": centroids.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
