"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from quadsync.llm.byte_bpe import op11_byte_bpe
from quadsync.llm.decontaminate import op9_decontaminate
from quadsync.llm.html_main import op3_html_main
from quadsync.llm.jaccard_join import op8_jaccard_join
from quadsync.llm.language import op10_language
from quadsync.llm.lexical_search import OP12_SQL, op12_lexical_search
from quadsync.llm.line_dedup import OP7_SQL, op7_line_dedup
from quadsync.llm.mixing import OP4_SQL, op4_mixing
from quadsync.llm.nearest import op6_nearest
from quadsync.llm.pii import op1_pii
from quadsync.llm.toxicity import op2_toxicity
from quadsync.llm.warc import OP5_SQL, op5_warc
from quadsync.llm.whitening import op13_whitening

QUERIES = {
    "op1_pii": op1_pii,
    "op2_toxicity": op2_toxicity,
    "op3_html_main": op3_html_main,
    "op4_mixing": op4_mixing,
    "op5_warc": op5_warc,
    "op6_nearest": op6_nearest,
    "op7_line_dedup": op7_line_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_language": op10_language,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_whitening": op13_whitening,
}

#: Queries without SQL are held against brute force in tests/llm.
SQL = {
    "op4_mixing": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op7_line_dedup": OP7_SQL,
    "op12_lexical_search": OP12_SQL,
}
