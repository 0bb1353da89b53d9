"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from ..session import shipped
from .ann import op9_ann
from .exact_dedup import OP10_SQL, op10_exact_dedup
from .langid import op5_language_id
from .line_dedup import OP1_SQL, op1_line_dedup
from .packing import op6_packing
from .quality import op2_quality
from .sentencepieces import op7_sentencepiece
from .simhash import op4_simhash
from .warc import OP8_SQL, op8_warc
from .wavelet import op3_token_shards

QUERIES = {
    name: shipped(query)
    for name, query in {
        "op1_line_dedup": op1_line_dedup,
        "op2_quality": op2_quality,
        "op3_token_shards": op3_token_shards,
        "op4_simhash": op4_simhash,
        "op5_language_id": op5_language_id,
        "op6_packing": op6_packing,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_warc": op8_warc,
        "op9_ann": op9_ann,
        "op10_exact_dedup": op10_exact_dedup,
        "pipeline": corpus_pipeline.run,
    }.items()
}

ORACLE_SQL = {"op1_line_dedup": OP1_SQL, "op8_warc": OP8_SQL, "op10_exact_dedup": OP10_SQL}
