"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

import corpus_pipeline
from barloom.llm import bpe, centroids, exact_dedup, license_scan, near_dedup, packing, phrases, pii, quality, secret_scan, sharding, simhash, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op4_warc": warc.op4_warc,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_pii": pii.op7_pii,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_phrases": phrases.op11_phrases,
    "op12_centroids": centroids.op12_centroids,
    "op13_simhash": simhash.op13_simhash,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op4_warc": warc.SQL,
    "op5_near_dedup": near_dedup.SQL,
    "op8_quality_rules": quality.SQL,
    "op9_license_scan": license_scan.SQL,
    "op11_phrases": phrases.SQL,
    "op12_centroids": centroids.sql(),
}
