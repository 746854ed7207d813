"""The corpus operators' queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillmill.llm.bitcodes import op9_bit_codes
from quillmill.llm.bpe import op1_bpe
from quillmill.llm.fim import op11_fill_in_middle
from quillmill.llm.kneser import op10_kneser_ney
from quillmill.llm.langid import op8_langid
from quillmill.llm.mixing import op6_mixing
from quillmill.llm.multiindex import op3_multi_index
from quillmill.llm.namejoin import op13_name_join
from quillmill.llm.packing import op12_packing
from quillmill.llm.pii import op7_pii
from quillmill.llm.secrets import op4_secrets
from quillmill.llm.simhash import op2_simhash
from quillmill.llm.substring import op5_substring


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_simhash": op2_simhash,
        "op3_multi_index": op3_multi_index,
        "op4_secrets": op4_secrets,
        "op5_substring": op5_substring,
        "op6_mixing": op6_mixing,
        "op7_pii": op7_pii,
        "op8_langid": op8_langid,
        "op9_bit_codes": op9_bit_codes,
        "op10_kneser_ney": op10_kneser_ney,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_packing": op12_packing,
        "op13_name_join": op13_name_join,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    from quillmill.llm import sql

    out = dict(sql.ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
