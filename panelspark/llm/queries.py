"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from .conversations import OP12_SQL, op12_conversation_repair
from .fingerprint import op6_fingerprint
from .language import op9_language
from .mixing import op4_mixing
from .neighbours import op2_neighbours
from .pieces import op5_sentencepiece
from .ranked_search import OP13_SQL, op13_ranked_search
from .secrets import op8_secrets
from .sharding import op10_sharding
from .simhash import op7_simhash
from .token_files import op11_token_files
from .toxicity import op3_toxicity
from .url_filter import OP1_SQL, op1_url_filter

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_neighbours": op2_neighbours,
    "op3_toxicity": op3_toxicity,
    "op4_mixing": op4_mixing,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_fingerprint": op6_fingerprint,
    "op7_simhash": op7_simhash,
    "op8_secrets": op8_secrets,
    "op9_language": op9_language,
    "op10_sharding": op10_sharding,
    "op11_token_files": op11_token_files,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ranked_search": op13_ranked_search,
}
ORACLES = {"op1_url_filter": OP1_SQL, "op12_conversation_repair": OP12_SQL, "op13_ranked_search": OP13_SQL}
