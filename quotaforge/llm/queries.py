"""Queries and oracle SQL of the training-data operators."""

from quotaforge.llm import bpe, chat, decontam, importance, language, matroska, maxent, mixing, negatives, pii, secrets, simhash, suffixes

QUERIES = {
    "op1_maxent": maxent.op1_maxent,
    "op2_matroska": matroska.op2_matroska,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_language": language.op4_language,
    "op5_secrets": secrets.op5_secrets,
    "op6_pii": pii.op6_pii,
    "op7_chat": chat.op7_chat,
    "op8_simhash": simhash.op8_simhash,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_mixing": mixing.op10_mixing,
    "op11_importance": importance.op11_importance,
    "op12_bpe": bpe.op12_bpe,
    "op13_negatives": negatives.op13_negatives,
}

ORACLE_SQL = {
    "op7_chat": chat.chat_sql(),
    "op9_decontamination": decontam.decontamination_sql(),
    "op10_mixing": mixing.mixing_sql(),
    "op11_importance": importance.importance_sql(),
    "op13_negatives": negatives.negatives_sql(),
}
