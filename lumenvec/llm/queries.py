"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import class_lm, decontaminate, flac, licenses, near_dup, prefix_trie, quality, quotes, records, tree_bpe, url_tree, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_flac_columns": flac.op1_flac_columns,
    "op2_fourier_ridge_quality": quality.op2_fourier_ridge_quality,
    "op3_tree_bpe": tree_bpe.op3_tree_bpe,
    "op4_odd_sketch_dedup": near_dup.op4_odd_sketch_dedup,
    "op5_warc_revisits": warc.op5_warc_revisits,
    "op6_license_rules": licenses.op6_license_rules,
    "op7_positional_index": decontaminate.op7_positional_index,
    "op8_length_delimited_records": records.op8_length_delimited_records,
    "op9_quotation_links": quotes.op9_quotation_links,
    "op10_template_tree": url_tree.op10_template_tree,
    "op11_euler_tour_trie": prefix_trie.op11_euler_tour_trie,
    "op12_cholesky_jacobi_whitening": whitening.op12_cholesky_jacobi_whitening,
    "op13_brown_class_lm": class_lm.op13_brown_class_lm,
}

ORACLE_SQL: dict[str, str] = {
    "op4_odd_sketch_dedup": near_dup.OP4_SQL,
    "op5_warc_revisits": warc.OP5_SQL,
    "op7_positional_index": decontaminate.OP7_SQL,
    "op9_quotation_links": quotes.OP9_SQL,
    "op11_euler_tour_trie": prefix_trie.OP11_SQL,
}
