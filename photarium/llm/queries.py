"""Queries and SQL of this subpackage."""

from photarium.llm import conversations, decontamination, embeddings, language, merkle, outliers, packing, pii, secrets, sharding, simhash, token_files, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        sharding.op1_sharding, simhash.op2_simhash, decontamination.op3_decontamination, secrets.op4_secrets, toxicity.op5_toxicity, embeddings.op6_embeddings, pii.op7_pii,
        token_files.op8_token_files, packing.op9_packing, language.op10_language, outliers.op11_quality, conversations.op12_conversations, merkle.op13_merkle,
    )
}

ORACLES = {"op3_decontamination": decontamination.ORACLE, "op12_conversations": conversations.ORACLE, "op13_merkle": merkle.ORACLE}
