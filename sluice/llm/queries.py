"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, decontam, embed, html, langid, linededup, lmscore, minhash, pii, warc

QUERIES = {
    "op1_html": html.op1_html,
    "op2_warc": warc.op2_warc,
    "op3_lmscore": lmscore.op3_lmscore,
    "op4_lines": linededup.op4_lines,
    "op5_minhash": minhash.op5_minhash,
    "op6_langid": langid.op6_langid,
    "op7_pii": pii.op7_pii,
    "op8_bpe": bpe.op8_bpe,
    "op9_decontam": decontam.op9_decontam,
    "op10_embeddings": embed.op10_embeddings,
}

ORACLES: dict[str, str] = {"op2_warc": warc.ORACLE, "op4_lines": linededup.ORACLE, "op7_pii": pii.ORACLE, "op9_decontam": decontam.ORACLE}
