"""Queries of the operators over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from gridfuse.llm.bpe_lexicon import op11_bpe
from gridfuse.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from gridfuse.llm.importance import op4_importance
from gridfuse.llm.language import op5_language
from gridfuse.llm.language_model import op2_language_model
from gridfuse.llm.packed_ids import op1_token_ids
from gridfuse.llm.packing import op10_packing
from gridfuse.llm.quality_rules import ABLATIONS_SQL, OP9_SQL, op9_quality_rules, quality_ablations
from gridfuse.llm.simhash import op3_simhash
from gridfuse.llm.suffix import op8_suffix_dedup
from gridfuse.llm.warc import op7_warc
from gridfuse.llm.whitening import op13_whitening
from gridfuse.llm.winnowing import op6_decontamination

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_ids,
        op2_language_model,
        op3_simhash,
        op4_importance,
        op5_language,
        op6_decontamination,
        op7_warc,
        op8_suffix_dedup,
        op9_quality_rules,
        op10_packing,
        op11_bpe,
        op12_hard_negatives,
        op13_whitening,
        quality_ablations,
    )
}

ORACLES = {"op12_hard_negatives": OP12_SQL, "op9_quality_rules": OP9_SQL, "quality_ablations": ABLATIONS_SQL}
