"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import decontamination, grammar, language, licenses, media, packing, repeats, sharding, simhash, warc

QUERIES = {
    f.__name__: f
    for f in (
        licenses.op1_license_scan,
        media.op2_media_avi,
        sharding.op3_extendible_sharding,
        simhash.op4_simhash_components,
        warc.op5_warc_roundtrip,
        grammar.op6_token_grammar,
        language.op7_language_id,
        decontamination.op8_benchmark_decontamination,
        packing.op9_packing,
        repeats.op10_suffix_dedup,
    )
}
ORACLES = {
    "op3_extendible_sharding": sharding.ORACLE,
    "op5_warc_roundtrip": warc.ORACLE,
    "op8_benchmark_decontamination": decontamination.ORACLE,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
