"""Registered queries of the numbered operators, with their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickerlake.llm import op3_warc as warc
from tickerlake.llm import op8_url_filters as urls
from tickerlake.llm import op12_filter_audit as filters
from tickerlake.llm import op13_vector_codes as codes
from tickerlake.llm.op1_fingerprints import op1_fingerprints
from tickerlake.llm.op2_sentencepiece import op2_sentencepiece
from tickerlake.llm.op4_bitplanes import op4_bitplanes
from tickerlake.llm.op5_ann import op5_ann
from tickerlake.llm.op6_pii import op6_pii
from tickerlake.llm.op7_simhash import op7_simhash
from tickerlake.llm.op9_langid import op9_langid
from tickerlake.llm.op10_packing import op10_packing
from tickerlake.llm.op11_sharding import op11_sharding


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_fingerprints, op2_sentencepiece, warc.op3_warc, op4_bitplanes, op5_ann, op6_pii, op7_simhash, urls.op8_url_filters, op9_langid, op10_packing, op11_sharding, filters.op12_filter_audit, codes.op13_vector_codes)}


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.ORACLE, "op8_url_filters": urls.ORACLE, "op12_filter_audit": filters.ORACLE, "op13_vector_codes": codes.ORACLE}
