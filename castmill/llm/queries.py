"""Registered queries of this subpackage, and their SQL where SQL expresses them."""

from . import licenses, media, negatives, packing, passages, pieces, pipeline, quality, rules, secrets, simhash, spelling, tokens, toxicity

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_simhash": simhash.op2_simhash,
    "op3_packing": packing.op3_packing,
    "op4_secrets": secrets.op4_secrets,
    "op5_nbest": pieces.op5_nbest,
    "op6_audio": media.op6_audio,
    "op7_rules": rules.op7_rules,
    "op8_token_files": tokens.op8_token_files,
    "op9_quality": quality.op9_quality,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_spelling": spelling.op11_spelling,
    "op12_negatives": negatives.op12_negatives,
    "op13_passages": passages.op13_passages,
    "pipeline": pipeline.run,
}
ORACLE_SQL = {"op1_licenses": licenses.ORACLE_SQL, "op11_spelling": spelling.ORACLE_SQL, "op12_negatives": negatives.ORACLE_SQL}
