"""Registered queries of the training-data operators and their SQL counterparts."""

from . import (
    chat, collocations, decontamination, fingerprint, hnsw, lexical, licenses, lm, mixing, quality, simhash, suffixes, toxicity,
)

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality": quality.op4_quality,
    "op5_simhash": simhash.op5_simhash,
    "op6_suffixes": suffixes.op6_suffixes,
    "op9_hnsw": hnsw.op9_hnsw,
    "op10_licenses": licenses.op10_licenses,
    "op7_lm": lm.op7_lm,
    "op8_decontamination": decontamination.op8_decontamination,
    "op11_lexical": lexical.op11_lexical,
    "op12_fingerprint": fingerprint.op12_fingerprint,
    "op13_collocations": collocations.op13_collocations,
}
ORACLE = {
    "op10_licenses": licenses.ORACLE, "op1_chat": chat.ORACLE, "op2_mixing": mixing.ORACLE,
    "op11_lexical": lexical.ORACLE, "op12_fingerprint": fingerprint.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
