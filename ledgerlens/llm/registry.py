"""Queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import align, decontaminate, licenses, lines, mixing, near, periodic, pieces, quality, secret_scan, sharding, suffix, warc


def queries() -> dict:
    return {
        "op1_qgram_decontamination": decontaminate.op1_qgram_decontamination,
        "op2_forest_secret_scan": secret_scan.op2_forest_secret_scan,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_hash_tree_sharding": sharding.op4_hash_tree_sharding,
        "op5_run_length_dedup": suffix.op5_run_length_dedup,
        "op6_bayes_minhash": near.op6_bayes_minhash,
        "op7_license_compression": licenses.op7_license_compression,
        "op8_streaming_pieces": pieces.op8_streaming_pieces,
        "op9_seekable_warc": warc.op9_seekable_warc,
        "op10_line_join": lines.op10_line_join,
        "op11_lockstep_alignment": align.op11_lockstep_alignment,
        "op12_periodic_runs": periodic.op12_periodic_runs,
        "op13_water_filling": mixing.op13_water_filling,
    }


def oracle_sql() -> dict:
    return {"op3_quality_rules": quality.ORACLE, "op9_seekable_warc": warc.ORACLE, "op13_water_filling": mixing.ORACLE}
