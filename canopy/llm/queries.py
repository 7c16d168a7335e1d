"""The queries of this subpackage, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from canopy.llm.ann import op6_ann
from canopy.llm.avi import op1_avi
from canopy.llm.bpe import op9_bpe
from canopy.llm.jaccard import op2_jaccard
from canopy.llm.mixing import op5_mixing
from canopy.llm.secret_scan import op8_secrets
from canopy.llm.sharding import op10_sharding
from canopy.llm.token_counts import op7_token_counts
from canopy.llm.toxicity import op4_toxicity
from canopy.llm.warc import OP3_SQL, op3_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_avi": op1_avi,
    "op2_jaccard": op2_jaccard,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_ann": op6_ann,
    "op7_token_counts": op7_token_counts,
    "op8_secrets": op8_secrets,
    "op9_bpe": op9_bpe,
    "op10_sharding": op10_sharding,
}

#: The others cannot be written in the SQL at hand (checksums, codecs, automata, models); tests hold them to brute force.
ORACLES: dict[str, str] = {"op3_warc": OP3_SQL}
