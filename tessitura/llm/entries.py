"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from .alignment import op11_cross_tokenizer_alignment
from .ann import op2_additive_quantisation
from .chat_formatting import ORACLE_OP8, op8_chat_formatting
from .decontamination import ORACLE_OP4, op4_decontamination
from .html_extraction import op3_html_extraction
from .importance import ORACLE_OP13, op13_importance_resampling
from .jaccard_join import ORACLE_OP1, op1_ngram_jaccard
from .packing import op7_best_fit_packing
from .quality import op9_quality
from .secret_scan import op6_secret_scan
from .suffix_dedup import ORACLE_OP12, op12_suffix_dedup
from .toxicity import op10_toxicity
from .warc import ORACLE_OP5, op5_warc

QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_additive_quantisation": op2_additive_quantisation,
    "op3_html_extraction": op3_html_extraction,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_secret_scan": op6_secret_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL = {"op1_ngram_jaccard": ORACLE_OP1, "op4_decontamination": ORACLE_OP4, "op5_warc": ORACLE_OP5, "op8_chat_formatting": ORACLE_OP8, "op12_suffix_dedup": ORACLE_OP12, "op13_importance_resampling": ORACLE_OP13}
