"""The queries of this subpackage, by the names that the driver uses."""

from __future__ import annotations

from leafmill.llm import bpe, chat, collocations, langid, mpeg, quality, rollups, simhash, templates, tiling, toxicity, variants, warc

QUERIES = {
    "op1_chat": chat.query,
    "op2_bpe": bpe.query,
    "op3_simhash": simhash.query,
    "op4_langid": langid.query,
    "op5_quality": quality.query,
    "op6_templates": templates.query,
    "op7_mpeg": mpeg.query,
    "op8_tiling": tiling.query,
    "op9_warc": warc.query,
    "op10_rollups": rollups.query,
    "op11_toxicity": toxicity.query,
    "op12_collocations": collocations.query,
    "op13_variants": variants.query,
}

ORACLE_SQL: dict[str, str] = {
    "op6_templates": templates.SQL,
    "op9_warc": warc.SQL,
    "op10_rollups": rollups.SQL,
    "op12_collocations": collocations.SQL,
}
