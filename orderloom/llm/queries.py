"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from .chat import op5_chat
from .divergence import OP12_SQL, op12_divergence
from .language import op2_language_id
from .media import op9_media
from .mixing import OP3_SQL, op3_mix_sources
from .ngram_join import OP10_SQL, op10_ngram_join
from .packing import op6_pack
from .quality import OP1_SQL, op1_line_frequency
from .repeats import op11_repeats
from .sharding import op8_shards
from .spelling import OP13_SQL, op13_spelling
from .url_reputation import OP7_SQL, op7_url_reputation
from .warc import OP4_SQL, op4_warc

QUERIES = {
    "op1_line_frequency": op1_line_frequency,
    "op2_language_id": op2_language_id,
    "op3_mix_sources": op3_mix_sources,
    "op4_warc": op4_warc,
    "op5_chat": op5_chat,
    "op6_pack": op6_pack,
    "op7_url_reputation": op7_url_reputation,
    "op8_shards": op8_shards,
    "op9_media": op9_media,
    "op10_ngram_join": op10_ngram_join,
    "op11_repeats": op11_repeats,
    "op12_divergence": op12_divergence,
    "op13_spelling": op13_spelling,
}
ORACLES = {
    "op1_line_frequency": OP1_SQL,
    "op3_mix_sources": OP3_SQL,
    "op4_warc": OP4_SQL,
    "op7_url_reputation": OP7_SQL,
    "op10_ngram_join": OP10_SQL,
    "op12_divergence": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
