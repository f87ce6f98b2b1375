"""Named queries of this subpackage: ``name -> fn(spark, sf_dir)``. Those without an
equivalent in plain SQL (tokenizers, trained models, hashes DuckDB lacks) are
held by ``tests/llm`` against brute force, round trips or held-out rows."""

from iolens.llm.alignment import op13_token_alignment
from iolens.llm.filter_audit import OP11_SQL, op11_filter_audit
from iolens.llm.langid import op4_language_id
from iolens.llm.licenses import op10_license_scan
from iolens.llm.line_dedup import OP12_SQL, op12_line_dedup
from iolens.llm.multi_index import op3_multi_index
from iolens.llm.packing import op1_best_fit_packing
from iolens.llm.pieces import op5_sentencepiece
from iolens.llm.pii import op7_pii
from iolens.llm.quality import op6_quality_rules
from iolens.llm.secrets import op2_secret_scan
from iolens.llm.simhash import op9_simhash_near_dedup
from iolens.llm.tokenfile import op8_token_id_output

QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_secret_scan, op3_multi_index, op4_language_id, op5_sentencepiece,
    op6_quality_rules, op7_pii, op8_token_id_output, op9_simhash_near_dedup, op10_license_scan,
    op11_filter_audit, op12_line_dedup, op13_token_alignment)}
SQL = {"op11_filter_audit": OP11_SQL, "op12_line_dedup": OP12_SQL}
