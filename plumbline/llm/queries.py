"""The operators' queries over their whole tables, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from . import chat, codes, decontaminate, negatives, quality
from .chat import op7_chat
from .codes import op13_vector_codes
from .decontaminate import op4_decontaminate
from .licenses import op2_license_scan
from .lm_score import op10_lm_score
from .minhash import op11_minhash
from .mixing import op5_mixing
from .negatives import op12_hard_negatives
from .pii import op1_pii
from .quality import op8_quality
from .simhash import op3_simhash
from .substrings import op6_substrings
from .tokens import op9_token_counts

QUERIES = {
    "op1_pii": op1_pii,
    "op2_license_scan": op2_license_scan,
    "op3_simhash": op3_simhash,
    "op4_decontaminate": op4_decontaminate,
    "op5_mixing": op5_mixing,
    "op6_substrings": op6_substrings,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_token_counts": op9_token_counts,
    "op10_lm_score": op10_lm_score,
    "op11_minhash": op11_minhash,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op4_decontaminate": decontaminate.ORACLE,
    "op7_chat": chat.ORACLE,
    "op8_quality": quality.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_vector_codes": codes.ORACLE,
}
