"""Registry of this subpackage's queries and their SQL."""

from __future__ import annotations

from .chat import OP2_SQL, op2_chat_format
from .decontaminate import op9_decontaminate
from .language import op3_language_id
from .mixing import OP5_SQL, op5_mix_sources
from .near_dup import OP6_SQL, op6_near_dup
from .neighbours import OP4_SQL, op4_nearest
from .quality import op10_quality
from .secrets import op8_secret_scan
from .suffix_dedup import OP7_SQL, op7_suffix_dedup
from .urls import op1_url_filter

QUERIES = {f.__name__: f for f in (op1_url_filter, op2_chat_format, op3_language_id, op4_nearest, op5_mix_sources, op6_near_dup, op7_suffix_dedup, op8_secret_scan, op9_decontaminate, op10_quality)}
#: The others' results are learned or found by tolerance: tests/llm holds them against brute force or held-out rows.
ORACLES: dict[str, str] = {"op2_chat_format": OP2_SQL, "op4_nearest": OP4_SQL, "op5_mix_sources": OP5_SQL, "op6_near_dup": OP6_SQL, "op7_suffix_dedup": OP7_SQL}
