"""The queries of this subpackage, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from quillgrid.llm.bpe import op1_bpe
from quillgrid.llm.chat import OP9_SQL, op9_chat
from quillgrid.llm.linededup import OP2_SQL, op2_linededup
from quillgrid.llm.lm import op7_suffixtree
from quillgrid.llm.mixing import TARGETS_SQL, mixing_targets, op6_mixing
from quillgrid.llm.quality import op10_quality
from quillgrid.llm.repetition import BASE_SQL, op4_repetition, repetition_base
from quillgrid.llm.simhash import op5_simhash
from quillgrid.llm.topk import OP8_SQL, op8_topk
from quillgrid.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_linededup": op2_linededup,
    "op3_warc": op3_warc,
    "op4_repetition": op4_repetition,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_suffixtree": op7_suffixtree,
    "op8_topk": op8_topk,
    "op9_chat": op9_chat,
    "op10_quality": op10_quality,
    # the parts of operators 4 and 6 that SQL expresses
    "repetition_base": repetition_base,
    "mixing_targets": mixing_targets,
}

ORACLES: dict[str, str] = {"op2_linededup": OP2_SQL, "op3_warc": OP3_SQL, "op8_topk": OP8_SQL, "op9_chat": OP9_SQL, "repetition_base": BASE_SQL, "mixing_targets": TARGETS_SQL}
