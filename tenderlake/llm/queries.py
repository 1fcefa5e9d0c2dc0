"""The corpus queries and the SQL that some are checked against."""

from __future__ import annotations

from . import centroids, classifier, fertility, language, licenses, lines, minhash, mixing, packing, repeats, secrets, spelling, vectors


def queries() -> dict:
    return {
        "op1_minhash_dedup": minhash.op1_minhash_dedup,
        "op2_quality_classifier": classifier.op2_quality_classifier,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_packing": packing.op4_packing,
        "op5_line_dedup": lines.op5_line_dedup,
        "op6_language_id": language.op6_language_id,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_quality_rules": fertility.op8_quality_rules,
        "op9_mixing": mixing.op9_mixing,
        "op10_embedding_dedup": vectors.op10_embedding_dedup,
        "op11_centroid_clustering": centroids.op11_centroid_clustering,
        "op12_suffix_array_dedup": repeats.op12_suffix_array_dedup,
        "op13_spelling_variants": spelling.op13_spelling_variants,
        "secret_rescan": secrets.secret_rescan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_secret_scan": secrets.ORACLE,
        "op5_line_dedup": lines.ORACLE,
        "op7_license_scan": licenses.ORACLE,
        "op9_mixing": mixing.ORACLE,
        "op11_centroid_clustering": centroids.ORACLE,
        "op13_spelling_variants": spelling.ORACLE,
        "secret_rescan": secrets.RESCAN_ORACLE,
    }
