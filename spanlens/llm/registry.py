"""The queries of this subpackage, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from spanlens.llm.audit import OP11_SQL, op11_filter_audit
from spanlens.llm.blockmax import OP12_SQL, op12_search
from spanlens.llm.decontam import op5_decontam
from spanlens.llm.embdedup import op3_embedding_dedup
from spanlens.llm.linededup import OP8_SQL, op8_line_dedup
from spanlens.llm.lm import op10_lm_score
from spanlens.llm.minhash import op4_minhash
from spanlens.llm.oracles import OP3_SQL, OP4_SQL, OP5_SQL
from spanlens.llm.packing import op2_packing
from spanlens.llm.pii import op13_pii
from spanlens.llm.sharding import op6_sharding
from spanlens.llm.tokenfile import op7_token_file
from spanlens.llm.toxicity import op9_toxicity
from spanlens.llm.urlfilter import op1_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_packing, op3_embedding_dedup, op4_minhash, op5_decontam, op6_sharding, op7_token_file,
        op8_line_dedup, op9_toxicity, op10_lm_score, op11_filter_audit, op12_search, op13_pii,
    )
}
ORACLES = {"op3_embedding_dedup": OP3_SQL, "op4_minhash": OP4_SQL, "op5_decontam": OP5_SQL, "op8_line_dedup": OP8_SQL, "op11_filter_audit": OP11_SQL, "op12_search": OP12_SQL}
