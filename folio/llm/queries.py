"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from folio.llm.bpe import op8_bpe
from folio.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from folio.llm.line_dedup import OP3_SQL, op3_line_dedup
from folio.llm.media import op1_media
from folio.llm.packing import op4_best_fit_packing
from folio.llm.pii import op7_personal_data
from folio.llm.secrets import OP5_SQL, op5_secret_scan
from folio.llm.simhash import op9_simhash
from folio.llm.toxicity import op6_toxicity
from folio.llm.url_filter import OP10_SQL, op10_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_media, op2_exact_dedup, op3_line_dedup, op4_best_fit_packing, op5_secret_scan, op6_toxicity, op7_personal_data, op8_bpe, op9_simhash, op10_url_filter)
}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op3_line_dedup": OP3_SQL, "op5_secret_scan": OP5_SQL, "op10_url_filter": OP10_SQL}
