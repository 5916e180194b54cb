"""Operations of a training-data pipeline; nothing else in the package imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .bpe import op10_bpe
    from .collocations import op12_collocations
    from .decontaminate import op2_decontaminate
    from .conversation_repair import op11_conversation_repair
    from .host_rules import op8_host_rules
    from .jaccard_join import op5_jaccard_join
    from .langid import op3_langid
    from .pii import op1_pii, op1_pii_any_support
    from .quality_fm import op7_quality_fm
    from .simhash import op13_simhash
    from .token_counts import op9_token_counts
    from .tool_calls import op6_tool_calls
    from .url_filter import op4_url_filter

    found = [op1_pii, op2_decontaminate, op3_langid, op4_url_filter, op5_jaccard_join, op6_tool_calls, op7_quality_fm, op8_host_rules, op9_token_counts, op10_bpe, op11_conversation_repair, op12_collocations, op13_simhash, op1_pii_any_support]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import collocations, conversation_repair, decontaminate, host_rules, jaccard_join, pii, tool_calls, url_filter

    return {
        "op1_pii": pii.ORACLE_SQL,
        "op1_pii_any_support": pii.ANY_SUPPORT_SQL,
        "op11_conversation_repair": conversation_repair.ORACLE_SQL,
        "op12_collocations": collocations.ORACLE_SQL,
        "op2_decontaminate": decontaminate.ORACLE_SQL,
        "op4_url_filter": url_filter.ORACLE_SQL,
        "op5_jaccard_join": jaccard_join.ORACLE_SQL,
        "op6_tool_calls": tool_calls.ORACLE_SQL,
        "op8_host_rules": host_rules.ORACLE_SQL,
    }
