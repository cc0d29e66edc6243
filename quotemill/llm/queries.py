"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from quotemill.llm import chat, decontaminate, quality_rules
from quotemill.llm.langid import langid_query
from quotemill.llm.packing import packing_query
from quotemill.llm.quality_classifier import quality_query
from quotemill.llm.simhash import simhash_query
from quotemill.llm.suffix_dedup import suffix_dedup_query
from quotemill.llm.token_binary import token_files_query
from quotemill.llm.toxicity import toxicity_query


def queries() -> dict:
    return {
        "op1_lexicon_toxicity": toxicity_query,
        "op2_typed_chat": chat.chat_query,
        "op3_line_quality": quality_rules.line_quality_query,
        "op4_spaced_seeds": decontaminate.decontamination_query,
        "op5_cotrained_quality": quality_query,
        "op6_runindex_dedup": suffix_dedup_query,
        "op7_hilbert_packing": packing_query,
        "op8_mixture_langid": langid_query,
        "op9_token_files": token_files_query,
        "op10_simhash_neardup": simhash_query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_typed_chat": chat.ORACLE_SQL, "op3_line_quality": quality_rules.ORACLE_SQL, "op4_spaced_seeds": decontaminate.ORACLE_SQL}
